"""Awkward column names, repeated ids, long texts, and executors that lack the package."""

import random
import re
import subprocess
import sys
import textwrap
from collections import Counter
from pathlib import Path

import pytest

from sojourn.llm import decontaminate, line_dedup, mixing, quality_rules, repeated_windows, secret_ledger, simhash

ROOT = Path(__file__).resolve().parents[2]
NAMES = ["__words", "__key", "__id", "__removed", "__hits", "a.b", "row", "id", "version", "removed", "c0", "copies", "key", "weird `name`"]


@pytest.fixture(scope="module")
def wide(spark):
    rng = random.Random(2)
    rows = []
    for i in range(40):
        text = " ".join(rng.choice("one two three four five six seven".split()) + str(rng.randint(0, 40)) for _ in range(30)) + "\nshared last line of all texts"
        rows.append((i, text, rng.choice(["a", "b"]), *[i * 100 + k for k in range(len(NAMES))]))
    schema = "doc_id long, text string, source string, " + ", ".join("`" + n.replace("`", "``") + "` long" for n in NAMES)
    return spark.createDataFrame(rows, schema).repartition(3)


def _kept(out, rows):
    got = [tuple(r) for r in out.collect()]
    known = {r[0]: tuple(r) for r in rows}
    assert got and out.columns == ["doc_id", "text", "source", *NAMES]
    for r in got:
        assert r[2:] == known[r[0]][2:]
    return got


def test_other_columns_stay_as_they_are(spark, wide):
    rows = wide.collect()
    copies = Counter(r[0] for r in _kept(mixing.apply_mix(wide), rows))
    assert max(copies.values()) <= 2
    assert all(r[1] == {x[0]: x[1] for x in rows}[r[0]] for r in _kept(simhash.keep_one(wide), rows))
    lines = {r[0]: r[1] for r in _kept(line_dedup.dedup_lines(wide), rows)}
    assert "shared last line" in lines[0] and not any("shared last line" in t for i, t in lines.items() if i)
    bench = spark.createDataFrame([("q", {r[0]: r[1] for r in rows}[3].split("\n")[0]), ("r", "one1")], "item_id string, text string")
    whole = _kept(decontaminate.remove(wide, bench, "documents"), rows)
    assert 3 not in {r[0] for r in whole}
    assert _kept(decontaminate.remove(wide, bench, "documents", block_bytes=200), rows) and sorted(whole) == sorted(map(tuple, decontaminate.remove(wide, bench, "documents", block_bytes=200).collect()))
    spans = {r[0]: r[1] for r in _kept(decontaminate.remove(wide, bench, "spans"), rows)}
    assert len(spans) == 40 and spans[3].strip() == "shared last line of all texts"


def test_sift_keeps_what_its_rules_keep(spark, wide):
    noisy = [(100 + i, "# $ % & " * 20 + f"tail {i}", "c", *[0] * len(NAMES)) for i in range(30)]
    plain = [(200 + i, " ".join(f"w{i}x{k}" for k in range(60)), None, *[1] * len(NAMES)) for i in range(30)]
    awkward = [(None, None, None, *[None] * len(NAMES)), (200, "too short", "c", *[2] * len(NAMES)), (None, plain[0][1], "d", *[3] * len(NAMES))]
    docs = wide.unionByName(spark.createDataFrame(noisy + plain + awkward, wide.schema))
    labels = spark.createDataFrame([(r[0], 0) for r in noisy] + [(r[0], 1) for r in plain] + [(None, 0), (7, None)], "doc_id long, quality int")
    out = quality_rules.sift(docs, labels)
    want = quality_rules.keep_good(docs, quality_rules.learn_from(docs, labels))
    order = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert out.columns == docs.columns and order(out) == order(want)
    kept = [r.doc_id for r in out.collect()]
    assert sorted(i for i in kept if i is not None and i >= 100) == [200 + i for i in range(30)] and kept.count(None) == 1
    assert quality_rules.sift(docs.limit(0), labels).columns == docs.columns and quality_rules.sift(docs.limit(0), labels).count() == 0


def _near(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_lines_of_rows_that_repeat_an_id(spark):
    rows = [(1, "shared boilerplate line"), (5, "something quite unique here"), (5, "shared boilerplate line"), (5, "zebra\nshared boilerplate line"), (None, "zebra"), (None, "another\nzebra"), (5, "something quite unique here"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.id, r.n_lines, tuple(r.removed)) for r in line_dedup.report(docs).collect())
    assert got == Counter([(1, 1, ()), (5, 1, ()), (5, 1, (0,)), (5, 2, (1,)), (None, 1, (0,)), (None, 2, (1,)), (5, 1, ()), (7, 1, ())])
    texts = Counter(tuple(r) for r in line_dedup.dedup_lines(docs).collect())
    assert texts == Counter([(1, "shared boilerplate line"), (5, "something quite unique here"), (5, ""), (5, "zebra"), (None, ""), (None, "another"), (5, "something quite unique here"), (7, None)])


def test_repeated_ids_against_all_pairs(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta"]
    rows = [(rng.choice([None, 1, 2, 3, 4]), "\n".join(rng.choice(words) + str(rng.randint(1, 99)) for _ in range(rng.randint(1, 4)))) for _ in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    places = {(i is None, i or 0, n, line) for i, t in rows for n, line in enumerate(t.split("\n"))}

    def gone(i, n, line):
        here = (i is None, i or 0, n)
        return any(p[:3] < here and _near(p[3], line) for p in places)

    got = line_dedup.report(docs)
    text = {(r.id, tuple(r.removed)) for r in got.collect()}
    for i, t in rows:
        sure = {n for n, line in enumerate(t.split("\n")) if gone(i, n, line)}
        unsure = {n for n, line in enumerate(t.split("\n")) if any(p[:3] == (i is None, i or 0, n) and p[3] != line and _near(p[3], line) for p in places)}
        assert any(key == i and sure <= set(found) <= sure | unsure for key, found in text)


def test_smallest_row_of_equal_ids_and_texts(spark):
    rows = [(1, "a b c d", "y", 2), (1, "a b c d", "x", 9), (1, "a b c d", None, 1), (2, "p q r s t", "z", 0)]
    for part in (1, 3):
        kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(part))
        assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(1, "a b c d", "x", 9), (2, "p q r s t", "z", 0)], key=repr)


@pytest.mark.parametrize("matches", [0, 1, 127, 128, 129, 700])
def test_many_secrets_in_one_text(spark, matches):
    text = " ".join(f"k{i} " + "0123456789abcdef" * 2 for i in range(matches)) + " password=abcdefg"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = [(s["start"], s["end"]) for s in secret_ledger.scan(docs).first().spans if s["name"] == "hex"]
    assert found == [m.span() for m in re.finditer("[0-9a-f]{24,}", text)]


def test_blob_shared_by_many_paths(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'token = abcdefgh' WHEN id % 3 = 0 THEN '' END AS text").repartition(6)
    got = secret_ledger.scan(docs).collect()
    assert len(got) == 3000 and all([(s["start"], s["end"]) for s in r.spans] == ([(0, 16)] if r.id % 2 == 0 else []) for r in got)


BARE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.warehouse.dir", {folder!r}).getOrCreate()
import pyarrow as pa

def missing(batches):
    for batch in batches:
        try:
            import sojourn
            yield pa.RecordBatch.from_arrays([pa.array(["there"])], ["s"])
        except ModuleNotFoundError:
            yield pa.RecordBatch.from_arrays([pa.array(["missing"])], ["s"])

assert spark.range(1).mapInArrow(missing, "s string").first().s == "missing"
from sojourn.llm import decontaminate, dual_tree_search, quality_classifier, toxicity, simhash, repeated_windows, line_dedup, conversation_trie
from sojourn.stats import tableone
docs = spark.createDataFrame([(i, "some words of text number %d to look at" % i) for i in range(40)], "doc_id long, text string")
bench = spark.createDataFrame([("q", "words of text number 7 to look")], "item_id string, text string")
labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
turns = spark.createDataFrame([(i % 9, i, "user", "hi %d" % (i % 3)) for i in range(40)], "conv_id long, turn long, role string, text string")
print("rows", decontaminate.report(docs, bench).where("n_hit > 0").count(), decontaminate.remove(docs, bench).count(),
      quality_classifier.score(docs, quality_classifier.fit(docs, labels)).count(), toxicity.score(docs, toxicity.fit(docs, labels)).count(),
      dual_tree_search.search(docs, bench, 3).count(), simhash.keep_one(docs).count() > 0, repeated_windows.repeated_spans(docs).count(), line_dedup.report(docs).count(),
      conversation_trie.prefix_nodes(conversation_trie.whole(conversation_trie.ordered_turns(turns))).count() > 9,
      tableone.fisher(labels.selectExpr("quality", "CAST(toxic AS STRING) AS t"), ["t"], "quality", [0, 1]).count())
"""


def test_executors_without_the_package(tmp_path):
    script = tmp_path / "bare.py"
    script.write_text(textwrap.dedent(BARE.format(root=str(ROOT), folder=str(tmp_path / "warehouse"))))
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "rows 1 39 40 40 3 True 40 40 True 1" in done.stdout, done.stderr[-3000:]


@pytest.mark.parametrize("segment", [200, 1111])
def test_long_texts_go_in_segments(spark, monkeypatch, segment):
    rng = random.Random(7)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(700))
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (3000, 10, 2500)]
    texts = [texts[0][:900] + passage + texts[0][900:], texts[1] + passage[100:400], texts[2] + passage + texts[2][:300], texts[0][50:2100]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = sorted(map(tuple, repeated_windows.repeated_spans(docs).collect()))
    monkeypatch.setattr(repeated_windows, "CHUNK_BYTES", 64)
    monkeypatch.setattr(repeated_windows, "SEGMENT_BYTES", segment)
    assert sorted(map(tuple, repeated_windows.repeated_spans(docs).collect())) == whole
    assert [r[2] for r in whole] == [0, 300, 700, 2050]
