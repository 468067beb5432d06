"""The prefix trie against a plain version, with components and blocks small enough to be split."""

import hashlib
import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest

from sojourn.llm import conversation_trie as trie

SCHEMA = "conv_id long, turn int, role string, text string, node string, pos int, comp string, `a.b` int"


def _rows():
    rng = random.Random(3)
    rows = []
    for c in range(60):
        for t in range(rng.randint(0, 7)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["hi", "hello there", "a  b\tc", "x"]) if rng.random() < 0.8 else f"own {c}"))
    rows += [(7, None, "system", "first of all"), (8, 0, None, None), (8, 0, None, None), (9, 0, "b", "tie"), (9, 0, "a", "tie"), (9, 0, "a", "a tie"), (None, 0, "user", "nobody's")]
    rows += [(1000, t, "user", "same words") for t in range(90)] + [(1001, t, "user", "same words") for t in range(95)] + [(1002, t, "user", f"step {t}") for t in range(40)]
    rows += [(-5, 0, "user", "below zero"), (2000, 0, "", ""), (2041, 0, "user", "x"), (2041, 1, "user", "long " * 3000)]
    rng.shuffle(rows)
    return rows


def _ordered(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            turns[c].append((t is not None, t or 0, r, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest(), x))
    return {c: [(v[2], v[4]) for v in sorted(ts)] for c, ts in turns.items()}


def _rebuilt(own):
    out = {}
    for c, turns in own.items():
        h, base = crc32(str(c).encode()) % 4, c - int(np.fmod(c, 20))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def _nodes(sequences):
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    out = []
    for key, convs in members.items():
        below = [k for k in members if k[: len(key)] == key]
        saved = sum((len(members[k]) - 1) * len(k[-1][1].split()) for k in below if k)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[key]))).encode()).hexdigest()
        parent = min(members[key[:-1]]) if key else None
        out.append((min(convs), len(key), parent, len(convs), len(kids[key]), sum(not kids[k] for k in below), saved, digest))
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*r, "n", 1, "c", 2) for r in _rows()], SCHEMA).repartition(5)


@pytest.mark.parametrize("bound, block", [(trie.BOUND, trie.BLOCK), (5, 4)])
def test_spliced_trie(table, bound, block):
    nodes = trie.prefix_nodes(trie.spliced(trie.ordered_turns(table), 20, 4), bound, block)
    got = nodes.select("conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256").collect()
    assert sorted(repr(tuple(r)) for r in got) == _nodes(_rebuilt(_ordered(_rows())))


def test_plain_trie(table):
    got = trie.prefix_nodes(trie.whole(trie.ordered_turns(table)), 30).drop("node").collect()
    assert sorted(repr(tuple(r)) for r in got) == _nodes(_ordered(_rows()))


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_nodes(trie.spliced(trie.ordered_turns(empty), 20, 4)).collect() == []


@pytest.mark.parametrize("shape", ["chain", "star", "random", "comb"])
def test_centroid_sums(shape):
    rng, n = np.random.default_rng(2), 700
    at = np.arange(n)
    parent = {"chain": at - 1, "star": np.where(at > 0, 0, -1), "random": np.array([-1, *(rng.integers(max(0, i - 9), i) for i in range(1, n))]), "comb": np.where(at % 2 == 0, at - 2, at - 1)}[shape]
    parent = np.where((parent < 0) | ((shape == "random") & (at % 97 == 0)), -1, parent)
    values = rng.integers(0, 1 << 55, (n, 2))
    want, weight = values.copy(), rng.integers(1, 9, n)
    for i in range(n - 1, -1, -1):
        if parent[i] >= 0:
            want[parent[i]] += want[i]
            weight[parent[i]] += weight[i]
    assert np.array_equal(trie.centroid_sums(parent, weight, values), want)


def test_digest_of_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE_BYTES", 100)
    ends = spark.range(1000).selectExpr("if(id % 3 = 0, 'a', concat('b', id % 2)) AS node", "id * 7 AS conv").repartition(7)
    got = {r.node: r.digest for r in trie.ends_digest(ends).collect()}
    name = lambda i: "a" if i % 3 == 0 else f"b{i % 2}"
    assert got == {k: hashlib.sha256(",".join(str(i * 7) for i in range(1000) if name(i) == k).encode()).hexdigest() for k in ("a", "b0", "b1")}
