"""Dual-tree search against scoring every pair."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sojourn.llm import dual_tree_search as search

SCHEMA = "doc_id long, text string, item int, score string, n string, `a.b` int, terms string"


def _texts():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["the", "The", "éa", "ñU", "x-y", "don't", "ß"]
    make = lambda n: " ".join(words[min(int(rng.expovariate(0.06)), 66)] for _ in range(n))
    texts = [None, "", " .,; ", "the", make(5000), "Ééaİ " * 3] + [make(rng.randint(1, 60)) for _ in range(150)]
    texts += [make(25)] * 30
    items = [("a", make(12)), ("b", make(4)), ("b", make(3)), (None, make(5)), ("c", ""), ("d", None), ("e", "nowhere else"), ("f", texts[-1]), ("g", "THE, éA!")]
    return texts, items + [(f"i{k}", make(rng.randint(1, 30))) for k in range(25)]


TEXTS, ITEMS = _texts()
ROWS = [*enumerate(TEXTS), (7, TEXTS[7]), (None, TEXTS[-1]), (None, TEXTS[20])]


def _terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def _all_pairs(rows, items, k):
    docs = [(i, Counter(_terms(t)), len(_terms(t))) for i, t in rows]
    docs = [d for d in docs if d[2]]
    total, df = sum(d[2] for d in docs), Counter(t for d in docs for t in d[1])
    own = {}
    for name, text in items:
        own.setdefault(name, set()).update(_terms(text))
    out = []
    for name, terms in own.items():
        scores = []
        for i, counts, n in docs:
            m = 100 - 90 + (90 * n * len(docs)) // total
            s = sum(math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 8 * m)) for t in terms if t in counts)
            if s:
                scores.append((-s, i is None, i or 0, i))
        out += [(name, r, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "s", "n", 2, "t") for i, t in ROWS], SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(n, t, 5, "x") for n, t in ITEMS], "item_id string, text string, term int, id string").repartition(2)


def _got(found):
    return sorted(repr((r.item_id, r["rank"], r.id, r.score)) for r in found.collect())


@pytest.mark.parametrize("k, settings", [(10, {}), (3, {"block_items": 6, "block_terms": 70, "seed_docs": 20})])
def test_every_pair(docs, items, monkeypatch, k, settings):
    if settings:
        for name, value in (("FAN", 2), ("CHUNK_DOCS", 16), ("PIECE_BYTES", 200)):
            monkeypatch.setattr(search, name, value)
    assert _got(search.search(docs, items, k, **settings)) == _all_pairs(ROWS, ITEMS, k)


def test_empty_tables(docs, items, spark):
    none, no_items = spark.createDataFrame([], SCHEMA), items.where("1 = 0")
    assert search.search(none, items).collect() == [] and search.search(docs, no_items).collect() == []


def test_text_ids(docs, items):
    found = search.search(docs.selectExpr("concat('d', doc_id) AS doc_id", "text"), items, 4)
    want = _all_pairs([(i, t) for i, t in ROWS], ITEMS, 4)
    assert len(found.collect()) == len(want)


def test_pieces_end_between_terms():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["ab", " ", "é", ".", "7"]) for _ in range(rng.randint(0, 60))).encode()
        parts = list(search.pieces(text, rng.randint(1, 9)))
        assert b"".join(parts) == text and [t for p in parts for t in search.TERM.findall(p)] == search.TERM.findall(text)


def test_batches_are_pruned():
    """With one close group of documents, most of the others are never scored."""
    rng = np.random.default_rng(4)
    values = np.zeros((512, 40))
    values[:, 20:] = rng.integers(1, 9, (512, 20))
    values[100:116, :20] = 500
    tree = search.ItemTree([[1, 2, 25]], np.full(40, 10), np.float64)
    seen, kth = [], np.array([8000])

    def scores_of(item, found, scores):
        seen.extend(found.tolist())

    search.search_chunk(tree, values, kth, scores_of)
    assert sorted(seen) == list(range(100, 116))
