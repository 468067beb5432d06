"""Levenshtein automata against edit distances, context and pieces, and held-out accuracy."""

import random
import re
from zlib import crc32

import numpy as np
import pytest

from sojourn.llm import toxicity

SCHEMA = "doc_id long, text string, score double, held_out string, lang string, `a.b` int, y int, w string"


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_finds_exactly_what_is_within_reach():
    rng = random.Random(5)
    entries = [("abcab", False), ("abc", False), ("bbcabcabc", False), ("cab", True), ("aacc", True), ("éabcb", False), ("bcabbcaabc", False)]
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 12))) for _ in range(4000)]
    for text, _ in entries:
        for _ in range(150):
            chars = list(text)
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(chars) + 1)
                chars[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "d", "z"])
            words.append("".join(chars) or "a")
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(w) for w in words])
    automaton = toxicity.Automaton(entries)
    entry, edits = automaton.match(automaton.classes(codes), np.cumsum(sizes) - sizes, sizes)
    for word, e, d in zip(words, entry.tolist(), edits.tolist()):
        near = {k: _distance(word, t) for k, (t, s) in enumerate(entries) if not s and _distance(word, t) <= toxicity.edits_allowed(t)}
        stems = [k for k, (t, s) in enumerate(entries) if s and word.startswith(t)]
        if e < 0:
            assert not near and not stems, word
        elif e in near:
            assert d == near[e] == min(near.values()), word
        else:
            assert e in stems and 0 not in near.values(), word


def test_no_entries():
    automaton = toxicity.Automaton([])
    entry, _ = automaton.match(automaton.classes(np.array([97, 98])), np.array([0, 1]), np.array([1, 1]))
    assert entry.tolist() == [-1, -1]


def _held(context=0.0):
    rng = np.random.default_rng(1)
    return {
        "entries": [("wretch", False), ("scoundrel", False), ("vile", True)], "weight": np.array([3.0, 2.0, 1.5]), "is_stem": np.array([False, False, True]),
        "surfaces": {"wrench": 0.0}, "context": rng.normal(0, context, toxicity.SLOTS),
        "model": (np.zeros(toxicity.INPUTS), np.ones(toxicity.INPUTS), np.r_[2.0, 1.5, 1.0, -1.0, np.zeros(5)], -2.0),
    }


def test_mentions(spark):
    texts = ["You wretch!", "a WRETTCH, a w*etch and a wrench", 'he said "you wretch" today', 'he said "so" you wretch', "vilest Vileness evil", "«scoundrl» sc0undre1\n\" scoundrel", None, "", "🙂 wretch"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(r) for r in toxicity.mentions(docs, _held()).orderBy("id", "start").collect()]
    assert got == [
        (0, 4, 10, "wretch", "wretch", 0, False),
        (1, 2, 9, "wrettch", "wretch", 1, False), (1, 13, 19, "w*etch", "wretch", 1, False), (1, 26, 32, "wrench", "wretch", 1, False),
        (2, 13, 19, "wretch", "wretch", 0, True), (3, 17, 23, "wretch", "wretch", 0, False),
        (4, 0, 6, "vilest", "vile", 0, False), (4, 7, 15, "vileness", "vile", 0, False),
        (5, 1, 9, "scoundrl", "scoundrel", 1, True), (5, 11, 20, "sc0undre1", "scoundrel", 2, False), (5, 23, 32, "scoundrel", "scoundrel", 0, False),
        (8, 2, 8, "wretch", "wretch", 0, False),
    ]


def test_ordinary_surfaces_and_quotation_weigh_less():
    held = _held()
    texts = ["you wretch", "you wrettch", "you wrench", 'the word "wretch" is old', None, ""]
    x = toxicity.features(held, toxicity.Automaton(held["entries"]), texts)
    assert x[0, 0] > 0 and x[1, 1] > 0 and x[2, 1] == 0 and x[3, 0] == 0 and x[3, 3] > 0
    assert not x[4].any() and not x[5].any()


def test_pieces_change_nothing(monkeypatch):
    rng = random.Random(6)
    words = ["wretch", "wrettch", '"', "viler", "plain", "and", "Ünd", "x" * 90, "\n", "scoundrels,"]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (4000, 10, 700)]
    held = _held(0.3)
    whole = toxicity.features(held, toxicity.Automaton(held["entries"]), texts)
    monkeypatch.setattr(toxicity, "PIECE", 501)
    monkeypatch.setattr(toxicity, "CHUNK", 3000)
    assert np.allclose(toxicity.features(held, toxicity.Automaton(held["entries"]), texts), whole)


def _corpus():
    rng = random.Random(9)
    plain = [f"{a}{b}{c}" for a in ("ba", "ko", "li") for b in ("ne", "ru", "mo") for c in ("ta", "si", "vo", "")]
    rows, labels = [], []
    for i in range(1500):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 90))]
        if toxic := i % 6 == 0:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["scoundrel", "wretched", "blighter", "vermin", "scoundrell", "wretchd"]))
        elif i % 7 == 0:
            words.insert(rng.randrange(len(words)), 'the word "' + rng.choice(["scoundrel", "wretched"]) + '" means')
        rows.append((i, " ".join(words), 1.0, "h", "xx", 1, 0, "w"))
        labels.append((i, int(toxic)))
    return rows, [*labels, (None, 1), (3, None), (12, 0)]


def test_held_out_accuracy(spark):
    rows, labels = _corpus()
    docs = spark.createDataFrame([*rows, (None, None, None, None, None, None, None, None), (5000, "", 0.0, "", "", 0, 0, ""), rows[4]], SCHEMA).repartition(4)
    held = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {("scoundrel", False), ("wretched", False)} <= set(held["entries"])
    got = toxicity.score(docs, held).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.id is not None and crc32(str(r.id).encode()) % 3 == 1) for r in got)
    judged = [(r.predicted, r.id % 6 == 0) for r in got if r.held_out and r.id < 1500]
    assert sum(p == t for p, t in judged) >= 0.97 * len(judged)
    quoting = {i for i, text, *_ in rows if re.search('"', text)}
    assert sum(r.predicted for r in got if r.id in quoting) <= 0.05 * len(quoting)


@pytest.mark.parametrize("labels, want", [([], 0.5), ([(i, 0) for i in range(30)], 0.0), ([(i, 1) for i in range(30)], 1.0)])
def test_labels_of_one_kind(spark, labels, want):
    docs = spark.createDataFrame(_corpus()[0][:40], SCHEMA)
    held = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert all(abs(r.score - want) < 1e-3 for r in toxicity.score(docs, held).collect())


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    held = toxicity.fit(empty, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert toxicity.score(empty, held).collect() == [] and toxicity.mentions(empty, held).collect() == []
