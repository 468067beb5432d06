"""Numpy routines that run inside Spark tasks, on Arrow batches.

They are pickled by value, and what is broadcast are plain arrays and dicts, so executors need
numpy and pyarrow (and xxhash for SimHash, tokenizers for the token store) but not this package.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, limit: int):
    """(first, last) row ranges of about ``limit`` bytes; a longer row is alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def scramble(x: np.ndarray) -> np.ndarray:
    """Mix 64-bit values (new array)."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_POWERS: dict[str, np.ndarray] = {}
_BASE = 0x2545F4914F6CDD1D


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        n = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of true bytes; runs stop at row ends."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[edge[:n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[edge[1:]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def run_hashes(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run's bytes."""
    up, down = _powers(len(folded) + 1)
    sums = np.zeros(len(folded) + 1, np.uint64)
    np.cumsum((folded.astype(np.uint64) + np.uint64(1)) * up[: len(folded)], out=sums[1:])
    return scramble((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def link_labels(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of ``n`` points over the links a-b."""
    labels = np.arange(n) if labels is None else labels.copy()
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return labels
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            further = labels[labels]
            if np.array_equal(further, labels):
                break
            labels = further


def trie_links(values: np.ndarray, bounds, depth: int, budget: int, limit: int = 1 << 18):
    """Labels that join values within ``budget`` differing bits, by joint trie traversal.

    ``values``: unsigned 64-bit, in cells. ``bounds`` holds (lo, hi, lo2, hi2, used) per cell:
    two index ranges, each sorted and sharing its first ``depth`` bits, and the bits in
    which those prefixes differ; equal ranges ask for pairs inside one range. A node of the
    trie is an index range. Node pairs go down together, differing bits add up, and a pair
    is given up when it exceeds the budget or when both nodes already carry one common
    label. Budgets rise from 1, so dense clusters merge while traversal is still cheap.
    """
    n = len(values)
    labels = np.arange(n)
    start = np.array(bounds, np.int64).reshape(-1, 5)
    ones: dict[int, np.ndarray] = {}

    def upto(bit: int) -> np.ndarray:
        if bit not in ones:
            out = np.zeros(n + 1, np.int32)
            np.cumsum((values >> np.uint64(63 - bit)) & np.uint64(1), out=out[1:])
            ones[bit] = out
        return ones[bit]

    for allowed in range(1, budget + 1):
        change = np.zeros(n + 1, np.int64)
        change[1:n] = labels[1:] != labels[:-1]
        change = np.cumsum(change)
        stack, found = [(depth, start[start[:, 4] <= allowed])], []
        while stack:
            bit, pairs = stack.pop()
            alo, ahi, blo, bhi, used = pairs.T
            single = (ahi - alo == 1) & (bhi - blo == 1)
            leaf = single & (alo != blo)
            if leaf.any():
                x, y = alo[leaf], blo[leaf]
                near = np.bitwise_count(values[x] ^ values[y]) <= allowed
                found.append(np.stack([x[near], y[near]]))
            joined = (change[ahi - 1] == change[alo]) & (change[bhi - 1] == change[blo]) & (labels[alo] == labels[blo])
            go = ~single & ~joined
            if not go.any() or bit == 64:
                continue
            alo, ahi, blo, bhi, used = (c[go] for c in (alo, ahi, blo, bhi, used))
            count = upto(bit)
            amid = ahi - (count[ahi] - count[alo])
            bmid = bhi - (count[bhi] - count[blo])
            own = alo == blo
            parts = [
                (alo, amid, blo, bmid, used),
                (amid, ahi, bmid, bhi, used),
                (alo, amid, bmid, bhi, used + 1),
                tuple(c[~own] for c in (amid, ahi, blo, bmid, used + 1)),
            ]
            nxt = np.concatenate([np.stack(p, 1) for p in parts])
            nxt = nxt[(nxt[:, 0] < nxt[:, 1]) & (nxt[:, 2] < nxt[:, 3]) & (nxt[:, 4] <= allowed)]
            for i in range(0, len(nxt), limit):
                stack.append((bit + 1, nxt[i : i + limit]))
        if found:
            a, b = np.concatenate(found, 1)
            labels = link_labels(n, a, b, labels)
    return labels
