"""The registered queries without SQL, and every stage of the pipeline, against plain Python on whole tables."""

from collections import Counter, defaultdict
from pathlib import Path
from zlib import crc32

import numpy as np
import pytest
from test_llm_operators import _contaminated, _counts, _fingerprint, _groups, _line_repeats, _repeats, _targets, _words

import corpus_pipeline
import test_llm_operators as helpers
from sojourn.llm import quality_rules, token_store
from sojourn.llm.queries import QUERIES, tokenizer_path

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test data not present")


@pytest.fixture(scope="module")
def table(spark):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source").collect()]


@pytest.fixture(scope="module")
def tokenizer():
    return token_store.Encoder(tokenizer_path()).tokenizer


def _run(spark, name):
    return QUERIES[name](spark, str(DATA)).collect()


def _base_failed(text):
    c = _counts(text)
    return c[0] < 50 or 100 * c[4] > 50 * c[0]


def _rejected(text, rules):
    """The learned list on plain counts, for features that these counts hold."""
    names = dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), _counts(text)))
    names |= {"n_lines": len((text or "").split("\n"))}

    def holds(condition):
        over, under = quality_rules.FEATURES[condition.feature]
        value = names[over] / (max(names[under], 1) if under else 1)
        return value >= condition.cut if condition.above else value < condition.cut

    return any(all(holds(c) for c in rule.conditions) for rule in rules.rules)


def test_mix(spark, table):
    rows, sizes = _run(spark, "op1_mix_sources"), defaultdict(int)
    for _, t, s in table:
        sizes[s] += len(_words(t))
    want, source, taken = _targets(sizes), {i: s for i, _, s in table}, defaultdict(int)
    assert sorted((r.doc_id, r["size"]) for r in rows) == sorted((i, len(_words(t))) for i, t, _ in table)
    for r in rows:
        assert r.source_size == sizes[source[r.doc_id]] and abs(r.target - want[source[r.doc_id]]) < 1e-6
        assert r.taken % max(r["size"], 1) == 0 and r.taken <= 2 * r["size"]
        taken[source[r.doc_id]] += r.taken
    longest = max(len(_words(t)) for _, t, _ in table)
    assert all(abs(taken[s] - want[s]) <= longest for s in want)


def test_rules(spark, table):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    rules = quality_rules.learn_from(docs, labels)
    rows = {r.doc_id: r for r in _run(spark, "op3_quality_rules")}
    assert len(rows) == len(table)
    for i, t, _ in table:
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (*_counts(t), _base_failed(t))
        assert r.kept == (not _base_failed(t) and not _rejected(t, rules))


def test_windows(spark, table):
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in _run(spark, "op4_repeated_windows"))
    assert got == sorted(_repeats([(i, t) for i, t, _ in table]))


def _tokens(tokenizer, ids_texts):
    start, out = 0, []
    for i, t in ids_texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((i, start, len(ids), crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_store(spark, table, tokenizer):
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in _run(spark, "op6_token_store"))
    assert got == _tokens(tokenizer, sorted((i, t) for i, t, _ in table))


def test_lines(spark, table):
    want = _line_repeats(sorted((i, t) for i, t, _ in table), 1)
    got = {r.doc_id: r.removed_lines for r in _run(spark, "op8_line_dedup")}
    assert got == {i: ",".join(map(str, want.get(i, []))) for i, _, _ in table}


def _components(rows):
    prints = {i: _fingerprint(t) for i, t in rows}
    groups, first = _groups(set(prints.values()), 3), {}
    for i in sorted(prints):
        first.setdefault(groups[prints[i]], i)
    return prints, {i: first[groups[p]] for i, p in prints.items()}


def test_simhash(spark, table):
    prints, first = _components([(i, t) for i, t, _ in table])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in _run(spark, "op10_simhash_near_dedup")}
    assert got == {i: (f"{p:016x}", first[i]) for i, p in prints.items()}


@pytest.mark.parametrize("name", ["op5_quality_classifier", "op13_toxicity"])
def test_scores(spark, table, name):
    rows, share = _run(spark, name), 4 if name.startswith("op5") else 3
    assert sorted(r.doc_id for r in rows) == sorted(i for i, *_ in table)
    for r in rows:
        assert r.held_out == (crc32(str(r.doc_id).encode()) % share == (2 if share == 4 else 1)) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)


def test_every_stage_of_the_pipeline(spark, table, tokenizer, tmp_path, monkeypatch):
    bench = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    monkeypatch.setattr(helpers, "ITEMS", bench)
    docs, held = spark.read.parquet(f"{DATA}/documents.parquet"), [(i, t) for i, t, _ in table]
    source, whole = {i: s for i, _, s in table}, {tuple(r) for r in docs.collect()}
    rules = quality_rules.learn_from(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(DATA))
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = docs.collect()
        if k == 4:
            assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows) == _tokens(tokenizer, held)
            break
        assert {tuple(r) for r in rows} <= whole, name
        got = Counter((r.doc_id, r.text) for r in rows)
        if k == 0:
            want = [(i, t) for i, t in held if not _base_failed(t) and not _rejected(t, rules)]
        elif k == 1:
            first = _components(held)[1]
            want = [(i, t) for i, t in held if first[i] == i]
        elif k == 2:
            want = [(i, t) for i, t in held if not _contaminated(t)[4]]
        else:
            sizes, taken = defaultdict(int), defaultdict(int)
            for i, t in held:
                sizes[source[i]] += len(_words(t))
            for (i, t), n in got.items():
                assert n <= 2 and (i, t) in held
                taken[source[i]] += n * len(_words(t))
            longest, target = max(len(_words(t)) for _, t in held), _targets(sizes)
            assert all(abs(taken[s] - target[s]) <= longest for s in target)
            want = list(got.elements())
        assert got == Counter(want), name
        held = sorted(got.elements())
