"""Removal of repeated byte windows by depth-limited radix passes over suffixes.

Two documents repeat each other where they share ``DEPTH`` bytes. Suffixes therefore need
an order only through their first ``DEPTH`` bytes: most-significant-digit passes split
them into groups by 8 bytes at a time, a suffix alone in its group leaves at once, and
the groups left after the last digit are exactly the repeated windows.

Sorting every suffix of a corpus would move many times its size, so suffixes are dealt
before they are sorted, by content alone:

1. *First digit.* Every window has an anchor, the 16 bytes in it of least hash; a stretch
   of windows with one anchor is kept together. Tasks send the hashes of their anchors, each
   once; an anchor that only one document has cannot belong to a repeated window, and all
   its windows leave. What comes back is a flag per anchor.
2. *Remaining digits.* Stretches with a shared anchor are sent with their bytes, equal
   ones once per task with the smallest document, to the bucket of their anchor, and there
   sorted by ``radix_groups``. What comes back is a bit per window: whether a smaller
   document has it.
3. The bits become byte ranges, and each document is cut.

Texts are packed once into compressed batches, written to shared storage; each pass reads
those. An anchor that a large share of all documents has meets at most one record per
task in pass 1. In pass 2 it is dealt by window instead of by anchor when more than
``HOT_DOCS`` documents have it, so no bucket holds an unbounded group. Buckets grow in
number with the corpus, not in size.

Defined results. Null and empty texts have no bytes and nothing to remove. A document
shorter than the depth keeps everything. Only a strictly smaller id removes, so rows that
share an id do not remove from each other; a null id counts as larger than all others and
two null ids as equal. Texts may be of any length; one text is held by one task, at about
ten bytes of memory a byte. Extra columns never matter.
"""

from __future__ import annotations

import hashlib
import sys
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm import kernels
from sojourn.operators.work import settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DEPTH, GRAM = 50, 16
BATCH_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
CHUNK_BYTES = 1 << 20
#: Part of a long document that is cut into stretches at a time; at most 2^28.
SEGMENT_BYTES = 32 << 20
HOT_DOCS = 10_000
KEY_BITS = 48
SORT_ROWS = 1 << 19
NO_ID = np.iinfo(np.int64).max


def _squeeze(values: np.ndarray) -> bytes:
    """Compressed bytes of an array, its byte planes apart."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()
    return pa.compress(raw, "zstd", asbytes=True) if raw else b""


def _unsqueeze(blob: bytes, kind, n: int) -> np.ndarray:
    kind = np.dtype(kind)
    if n == 0:
        return np.zeros(0, kind)
    raw = pa.decompress(blob, n * kind.itemsize, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T).view(kind).ravel()


def digits(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one number that sorts like them; zeros follow the end."""
    n = len(data)
    raw = np.concatenate([data, np.zeros(DEPTH + 64, np.uint8)]).tobytes()
    out = np.empty(n + DEPTH + 48, np.uint64)
    for k in range(8):
        part = out[k::8]
        part[:] = np.frombuffer(raw, ">u8", len(part), k)
    return out


def span_hashes(at: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are shorter than 2 * DEPTH."""
    out = size.astype(np.uint64)
    for offset in range(0, int(size.max()) if len(size) else 0, 8):
        left = np.clip(size - offset, 0, 8)
        digit = at[np.where(left > 0, start + offset, 0)] >> (8 * np.minimum(8 - left, 7)).astype(np.uint64)
        out = kernels.scramble(out + np.where(left > 0, digit + np.uint64(1), np.uint64(0)))
    return out


def radix_groups(at: np.ndarray, starts: np.ndarray, depth: int = DEPTH):
    """Groups of starts whose ``depth`` bytes are equal, by most-significant-digit passes.

    Returns the indices of grouped starts, ordered by group, and the first position of each
    group among them. ``at`` are the ``digits`` of the text.
    """
    index, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for offset in range(0, depth, 8):
        digit = at[starts[index] + offset]
        if depth - offset < 8:
            digit = digit >> np.uint64(8 * (8 - (depth - offset)))
        order = np.lexsort((digit, group)) if offset else np.argsort(digit, kind="stable")
        index, group, digit = index[order], group[order], digit[order]
        fresh = np.ones(len(index) + 1, bool)
        fresh[1:-1] = (digit[1:] != digit[:-1]) | (group[1:] != group[:-1])
        together = ~(fresh[:-1] & fresh[1:])
        group = np.cumsum(fresh[:-1])[together]
        index = index[together]
    if not len(index):
        return index, index
    return index, np.flatnonzero(np.r_[True, group[1:] != group[:-1]])


def _stretches(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int):
    """Start, document, number of windows and anchor key of the stretches of documents lo to hi.

    Anchors have small hashes, so their keys are mixed once more to fill the buckets evenly.
    """
    base = int(offsets[lo])
    at = digits(data[base : offsets[hi]])
    n = int(offsets[hi]) - base
    grams = kernels.scramble(kernels.scramble(at[: n + DEPTH]) + at[GRAM // 2 : n + DEPTH + GRAM // 2])
    del at
    low = np.uint64((1 << 28) - 1)
    # Equal hashes: the leftmost gram is the anchor, as position fills the low bits.
    best = grams & ~low
    best |= np.arange(len(grams), dtype=np.uint64)
    width, span = 1, DEPTH - GRAM + 1
    while 2 * width <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    best = np.minimum(best[: len(best) - (span - width)], best[span - width :])[:n]
    sizes = np.diff(offsets[lo : hi + 1])
    windows = _spread(offsets[lo:hi] - base, np.maximum(sizes - DEPTH + 1, 0))
    doc = np.repeat(np.arange(lo, hi), np.maximum(sizes - DEPTH + 1, 0))
    anchor = (best[windows] & low).astype(np.int64)
    del best
    fresh = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]) if len(windows) else np.zeros(0, np.int64)
    return windows[fresh] + base, doc[fresh], np.diff(np.r_[fresh, len(windows)]), kernels.scramble(grams[anchor[fresh]]) >> np.uint64(64 - KEY_BITS)


def _segments(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int):
    """``_stretches`` of documents lo to hi; a longer document goes in segments that overlap by
    DEPTH - 1 bytes, as every window, and so its anchor, lies whole in one of them."""
    if offsets[hi] - offsets[lo] <= SEGMENT_BYTES or hi - lo > 1:
        yield _stretches(data, offsets, lo, hi)
        return
    for at in range(int(offsets[lo]), int(offsets[hi]), SEGMENT_BYTES):
        part = data[at : min(at + SEGMENT_BYTES + DEPTH - 1, int(offsets[hi]))]
        start, doc, count, key = _stretches(part, np.array([0, len(part)]), 0, 1)
        yield start + at, doc + lo, count, key


class Stretches:
    """The stretches of windows with one anchor, of all documents of a batch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        parts = [part for lo, hi in kernels.row_chunks(offsets, CHUNK_BYTES) for part in _segments(data, offsets, lo, hi)]
        self.start, self.doc, self.count, self.key = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, t) for t in (int, int, int, np.uint64))

    @cached_property
    def digits(self) -> np.ndarray:
        return digits(self.data)

    def classes(self, chosen: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes of each chosen stretch."""
        return span_hashes(self.digits, self.start[chosen], self.count[chosen] + DEPTH - 1)


def _unpack(row):
    """(ids, offsets, bytes) of a batch."""
    n = row["n_docs"]
    ids, sizes = _unsqueeze(row["ids"], np.int64, n), _unsqueeze(row["sizes"], np.int64, n)
    offsets = np.r_[0, np.cumsum(sizes)]
    raw = pa.decompress(row["texts"], int(offsets[-1]), "zstd", asbytes=True) if offsets[-1] else b""
    return ids, offsets, np.frombuffer(raw, np.uint8)


def _rows(batch):
    """Rows of an Arrow batch as dicts, one at a time."""
    return (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows))


PACKED = "batch long, n_docs long, n_bytes long, ids binary, sizes binary, texts binary"


def _pack(batches):
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    ids, texts, held = [], [], 0

    def flush():
        raw = b"".join(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        row = {"batch": number, "n_docs": len(ids), "n_bytes": len(raw), "ids": _squeeze(np.array(ids, np.int64)), "sizes": _squeeze(sizes), "texts": pa.compress(raw, "zstd", asbytes=True) if raw else b""}
        return pa.RecordBatch.from_pylist([row], pa.schema([(c, pa.int64() if c[:2] in ("ba", "n_") else pa.binary()) for c in row]))

    for batch in batches:
        for key, text in zip(batch.column("id").fill_null(NO_ID).to_pylist(), batch.column("text").to_pylist()):
            text = text or b""
            if ids and held + len(text) > BATCH_BYTES:
                yield flush()
                number, ids, texts, held = number + 1, [], [], 0
            ids.append(key)
            texts.append(text)
            held += len(text)
    if ids:
        yield flush()


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys // np.uint64(-(-(1 << KEY_BITS) // buckets))).astype(np.int64)


def _anchor_counts(found: Stretches):
    """Distinct anchor keys in order, and how many documents of the batch have each."""
    order = np.lexsort((found.doc, found.key))
    key, doc = found.key[order], found.doc[order]
    new_key = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    new_doc = new_key | np.r_[True, doc[1:] != doc[:-1]] if len(key) else new_key
    at = np.flatnonzero(new_key)
    return key[at], np.minimum(np.add.reduceat(new_doc, at) if len(at) else at, 65535)


def _cut(keys: np.ndarray, buckets: int):
    """(bucket, first, last) of the buckets that sorted keys touch."""
    bucket = _bucket(keys, buckets)
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return zip(bucket[at].tolist(), at.tolist(), np.r_[at[1:], len(keys)].tolist())


def _send_anchors(buckets: int):
    def scan(batches):
        for batch in batches:
            for row in _rows(batch):
                keys, counts = _anchor_counts(Stretches(*_unpack(row)[:0:-1]))
                out = [
                    {"bucket": b, "batch": row["batch"], "n": hi - lo, "keys": _squeeze(np.diff(keys[lo:hi], prepend=np.uint64(0))), "counts": _squeeze(counts[lo:hi].astype(np.uint16))}
                    for b, lo, hi in _cut(keys, buckets)
                ]
                yield pa.RecordBatch.from_pylist(out, pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))

    return scan


ANSWER = pa.schema([("batch", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("answer", pa.binary())])


def _shared_anchors(hot_docs: int):
    """Flags per sent anchor: 1 if another document has it, 2 if very many have."""

    def reduce(key, table):
        rows = table.select(["batch", "n", "keys", "counts"]).to_pylist()
        keys = np.concatenate([np.cumsum(_unsqueeze(r["keys"], np.uint64, r["n"])) for r in rows])
        counts = np.concatenate([_unsqueeze(r["counts"], np.uint16, r["n"]) for r in rows]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        at = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
        total = np.add.reduceat(counts[order], at)
        flags = np.empty(len(keys), np.uint8)
        flags[order] = np.repeat((total > 1).astype(np.uint8) + (total > hot_docs), np.diff(np.r_[at, len(keys)]))
        ends = np.cumsum([r["n"] for r in rows])
        out = [{"batch": r["batch"], "bucket": key[0].as_py(), "n": r["n"], "answer": _squeeze(flags[e - r["n"] : e])} for r, e in zip(rows, ends)]
        return pa.Table.from_pylist(out, ANSWER)

    return reduce


class Flagged:
    """Stretches with a shared anchor, equal ones of a batch together.

    ``first`` are the representatives (smallest id) in record order, ``same`` the record of
    every flagged stretch, ``own`` whether its document has the representative's id.
    """

    def __init__(self, found: Stretches, ids: np.ndarray, answers):
        keys, _ = _anchor_counts(found)
        flags = np.zeros(len(keys), np.uint8)
        buckets = {a["bucket"]: _unsqueeze(a["answer"], np.uint8, a["n"]) for a in answers or []}
        at = 0
        for b in sorted(buckets):
            flags[at : at + len(buckets[b])] = buckets[b]
            at += len(buckets[b])
        mark = flags[np.searchsorted(keys, found.key)] if len(keys) else np.zeros(0, np.uint8)
        chosen = np.flatnonzero(mark > 0)
        kind = found.classes(chosen)
        order = np.lexsort((ids[found.doc[chosen]], found.count[chosen], kind, found.key[chosen]))
        chosen, kind = chosen[order], kind[order]
        key, count, owner = found.key[chosen], found.count[chosen], ids[found.doc[chosen]]
        fresh = np.r_[True, (key[1:] != key[:-1]) | (kind[1:] != kind[:-1]) | (count[1:] != count[:-1])] if len(chosen) else np.zeros(0, bool)
        first = np.flatnonzero(fresh)
        self.chosen, self.same = chosen, np.cumsum(fresh) - 1
        self.first, self.key, self.hot = chosen[first], key[first], mark[chosen[first]] == 2
        self.owner = owner[first]
        self.own = owner == self.owner[self.same] if len(chosen) else np.zeros(0, bool)


def _records(found: Stretches, flagged: Flagged):
    """Start, bytes and dealing key of what is sent: stretches, or windows of hot anchors.

    ``record`` and ``shift`` say to which representative, and to which of its windows, a
    sent piece's bits belong.
    """
    cold, hot = np.flatnonzero(~flagged.hot), np.flatnonzero(flagged.hot)
    per = found.count[flagged.first[hot]]
    shift = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) if len(hot) else np.zeros(0, np.int64)
    starts = np.repeat(found.start[flagged.first[hot]], per) + shift
    keys = span_hashes(found.digits, starts, np.full(len(starts), DEPTH)) >> np.uint64(64 - KEY_BITS)
    start = np.r_[found.start[flagged.first[cold]], starts]
    count = np.r_[found.count[flagged.first[cold]], np.ones(len(starts), np.int64)]
    key, record = np.r_[flagged.key[cold], keys], np.r_[cold, np.repeat(hot, per)]
    order = np.argsort(key, kind="stable")
    return start[order], count[order], key[order], record[order], np.r_[np.zeros(len(cold), np.int64), shift][order]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + sizes[i] - 1, one range after the other."""
    first = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) - np.repeat(first - starts, sizes)


def _send_stretches(buckets: int):
    def scan(batches):
        for batch in batches:
            for row in _rows(batch):
                ids, offsets, data = _unpack(row)
                found = Stretches(data, offsets)
                flagged = Flagged(found, ids, row["anchors"])
                start, count, key, record, _ = _records(found, flagged)
                owner, out = flagged.owner[record], []
                for b, lo, hi in _cut(key, buckets):
                    raw = data[_spread(start[lo:hi], count[lo:hi] + DEPTH - 1)].tobytes()
                    out.append({"bucket": b, "batch": row["batch"], "n": hi - lo, "counts": _squeeze(count[lo:hi].astype(np.uint8)), "owners": _squeeze(owner[lo:hi]), "texts": pa.compress(raw, "zstd", asbytes=True)})
                yield pa.RecordBatch.from_pylist(out, pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("n", pa.int64()), ("counts", pa.binary()), ("owners", pa.binary()), ("texts", pa.binary())]))

    return scan


def repeated_bits(data: np.ndarray, start: np.ndarray, count: np.ndarray, owner: np.ndarray, sort_rows: int = SORT_ROWS) -> np.ndarray:
    """For each piece a bit per window: whether a piece of a smaller owner has that window."""
    full = (np.uint64(1) << count.astype(np.uint64)) - np.uint64(1)
    at = digits(data)
    kind = span_hashes(at, start, count + DEPTH - 1)
    order = np.lexsort((owner, count, kind))
    fresh = np.r_[True, (kind[order][1:] != kind[order][:-1]) | (count[order][1:] != count[order][:-1])]
    lead = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
    bits = np.zeros(len(start), np.uint64)
    bits[order] = np.where(owner[order] > owner[lead], full[order], 0)
    # Only the first of equal pieces is sorted by windows; the others of its owner follow it.
    firsts = order[fresh]
    windows, piece = _spread(start[firsts], count[firsts]), np.repeat(firsts, count[firsts])
    least = owner[piece]
    rounds = -(-len(windows) // sort_rows)
    part = (kernels.scramble(at[windows]) % np.uint64(max(1, rounds))).astype(np.int64) if rounds > 1 else None
    for k in range(rounds):
        mine = np.flatnonzero(part == k) if rounds > 1 else np.arange(len(windows))
        index, heads = radix_groups(at, windows[mine])
        if len(index):
            index = mine[index]
            low = np.minimum.reduceat(least[index], heads)
            least[index] = np.repeat(low, np.diff(np.r_[heads, len(index)]))
    shift = (windows - start[piece]).astype(np.uint64)
    np.bitwise_or.at(bits, piece, np.where(least < owner[piece], np.uint64(1) << shift, np.uint64(0)))
    bits[order] = np.where(owner[order] == owner[lead], bits[lead], bits[order])
    return bits


def _sort_stretches(key, table):
    rows = table.select(["batch", "n", "counts", "owners", "texts"]).to_pylist()
    count = np.concatenate([_unsqueeze(r["counts"], np.uint8, r["n"]) for r in rows]).astype(np.int64)
    owner = np.concatenate([_unsqueeze(r["owners"], np.int64, r["n"]) for r in rows])
    ends = np.cumsum([r["n"] for r in rows])
    sizes = [int((count[e - r["n"] : e] + DEPTH - 1).sum()) for r, e in zip(rows, ends)]
    raw = b"".join(pa.decompress(r["texts"], s, "zstd", asbytes=True) for r, s in zip(rows, sizes))
    start = np.cumsum(count + DEPTH - 1) - (count + DEPTH - 1)
    bits = repeated_bits(np.frombuffer(raw, np.uint8), start, count, owner)
    out = [{"batch": r["batch"], "bucket": key[0].as_py(), "n": r["n"], "answer": _squeeze(bits[e - r["n"] : e])} for r, e in zip(rows, ends)]
    return pa.Table.from_pylist(out, ANSWER)


def removed_bytes(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, bytes, removed mask) of a batch with both answers."""
    ids, offsets, data = _unpack(row)
    found = Stretches(data, offsets)
    flagged = Flagged(found, ids, row["anchors"])
    _, count, key, record, shift = _records(found, flagged)
    bits = np.zeros(len(flagged.first), np.uint64)
    answers = sorted(row["windows"] or [], key=lambda a: a["bucket"])
    if answers:
        got = np.concatenate([_unsqueeze(a["answer"], np.uint64, a["n"]) for a in answers])
        np.bitwise_or.at(bits, record, got << shift.astype(np.uint64))
    count, start = found.count[flagged.chosen], found.start[flagged.chosen]
    full = (np.uint64(1) << count.astype(np.uint64)) - np.uint64(1)
    own = np.where(flagged.own, bits[flagged.same], full) if len(flagged.chosen) else full
    change = np.zeros(len(data) + 1, np.int32)
    whole = own == full
    np.add.at(change, start[whole], 1)
    np.add.at(change, (start + count - 1 + DEPTH)[whole], -1)
    part = np.flatnonzero(~whole & (own > 0))
    windows, bit = _spread(start[part], count[part]), _spread(np.zeros(len(part), np.int64), count[part]).astype(np.uint64)
    windows = windows[((np.repeat(own[part], count[part]) >> bit) & np.uint64(1)) > 0]
    np.add.at(change, windows, 1)
    np.add.at(change, windows + DEPTH, -1)
    return ids, offsets, data, np.cumsum(change[:-1]) > 0


def _digest(batches):
    for batch in batches:
        for row in _rows(batch):
            ids, offsets, data, gone = removed_bytes(row)
            first, last, owner = kernels.runs(gone, offsets)
            cut = np.searchsorted(owner, np.arange(len(ids) + 1))
            out = []
            for k, key in enumerate(ids.tolist()):
                lo, hi = offsets[k], offsets[k + 1]
                kept = data[lo:hi][~gone[lo:hi]] if cut[k] < cut[k + 1] else data[lo:hi]
                spans = [{"start": int(a - lo), "end": int(b - lo)} for a, b in zip(first[cut[k] : cut[k + 1]], last[cut[k] : cut[k + 1]])]
                out.append({"id": None if key == NO_ID else key, "n_bytes": int(hi - lo), "n_removed": int(hi - lo) - len(kept), "n_spans": len(spans), "kept_sha256": hashlib.sha256(kept.tobytes()).hexdigest(), "spans": spans})
            yield pa.RecordBatch.from_pylist(out, REPORT_ARROW)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
REPORT_ARROW = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", SPANS)])
REPORT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>"


def _by_batch(answers: DataFrame, name: str) -> DataFrame:
    return settle(answers.groupBy("batch").agg(F.collect_list(F.struct("bucket", "n", "answer")).alias(name)))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, hot_docs: int = HOT_DOCS) -> DataFrame:
    """Per document: id, n_bytes, the byte spans to remove and their number, the SHA-256 of the rest."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    packed = settle(rows.mapInArrow(_pack, PACKED))
    buckets = max(1, -(-(packed.agg(F.sum("n_bytes")).first()[0] or 0) // bucket_bytes))
    answer = "batch long, bucket long, n long, answer binary"

    sent = packed.mapInArrow(_send_anchors(buckets), "bucket long, batch long, n long, keys binary, counts binary")
    anchors = _by_batch(sent.groupBy("bucket").applyInArrow(_shared_anchors(hot_docs), answer), "anchors")
    flagged = packed.join(anchors.hint("shuffle_hash"), "batch", "left")
    sent = flagged.mapInArrow(_send_stretches(buckets), "bucket long, batch long, n long, counts binary, owners binary, texts binary")
    windows = _by_batch(sent.groupBy("bucket").applyInArrow(_sort_stretches, answer), "windows")
    return flagged.join(windows.hint("shuffle_hash"), "batch", "left").mapInArrow(_digest, REPORT)
