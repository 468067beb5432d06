"""Benchmark decontamination with a broadcast hash set of word windows.

Texts are lower-cased (A-Z), cut into words, and every run of ``WINDOW`` words of a
benchmark item is one window; a shorter item is one window of its own length. The hashes
of the distinct windows go to all tasks. A task hashes every window of its documents,
looks the hashes up, and verifies each hit word by word, so a hash collision changes
nothing. Documents are read once and never shuffled.

The broadcast set is bounded: windows are dealt by hash into blocks of at most
``BLOCK_BYTES`` (measured first), and a benchmark of several blocks is scanned block by
block, the hits of earlier blocks riding along in a column.

Defined results. Null, empty and wordless texts have no words, are hit by nothing and
are clean. Items without words have no window. Items that repeat an id count once; a
null id counts as the empty string. Repeated documents are judged each on its own.
Extra columns are carried through unread.
"""

from __future__ import annotations

import hashlib
import pickle
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm import kernels
from sojourn.llm.columns import column
from sojourn.operators.work import settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
ONE_IN = 20
BLOCK_BYTES = 32 << 20
CHUNK_BYTES = 1 << 20

#: Byte -> its folded value inside a word, 0 outside. Bytes from 0x80 on belong to
#: multi-byte characters, which are all word characters.
FOLD = np.zeros(256, np.uint8)
FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
FOLD[0x80:] = np.arange(0x80, 0x100)


def _place_values(n: int) -> np.ndarray:
    return kernels.scramble(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(2)) | np.uint64(1)


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each position on."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j, place in enumerate(_place_values(length)):
        total += words[j : j + n] * place
    return kernels.scramble(total + np.uint64(length))


def words_of(data: np.ndarray, offsets: np.ndarray):
    folded = FOLD[data]
    starts, ends, row = kernels.runs(folded != 0, offsets)
    return folded, starts, ends, row


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(window, n, items): distinct windows as space-joined words, their length, sorted item ids."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("binary").alias("text"))

    def scan(batches):
        for batch in batches:
            items, out = batch.column("item").to_pylist(), []
            for item, text in zip(items, batch.column("text").to_pylist()):
                data = np.frombuffer(text or b"", np.uint8)
                folded, starts, ends, _ = words_of(data, np.array([0, len(data)]))
                words = [folded[s:e].tobytes() for s, e in zip(starts, ends)]
                n = min(window, len(words))
                out += [(item, b" ".join(words[i : i + n]), n) for i in range(len(words) - n + 1) if n]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in ((0, pa.string()), (1, pa.binary()), (2, pa.int32()))], ["item", "window", "n"])

    found = rows.mapInArrow(scan, "item string, window binary, n int")
    return found.groupBy("window", "n").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _blocks(windows: DataFrame, limit: int):
    """The windows in collected blocks of bounded size."""
    windows = settle(windows)
    size = F.octet_length("window") + 64 + F.expr("aggregate(items, 0, (a, x) -> a + octet_length(x) + 8)")
    total = windows.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-total // limit))
    for k in range(n):
        yield k == n - 1, windows.where(F.pmod(F.xxhash64("window"), F.lit(n)) == k).collect()


def window_set(rows) -> dict:
    """What ``WindowSet`` holds, as plain dicts and arrays: these are broadcast, so that
    executors need not have this package to read them."""
    windows = {bytes(r["window"]): tuple(r["items"]) for r in rows}
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for length in sorted({r["n"] for r in rows}):
        texts = [bytes(r["window"]) for r in rows if r["n"] == length]
        data = np.frombuffer(b" ".join(texts), np.uint8)
        folded, starts, ends, _ = words_of(data, np.array([0, len(data)]))
        hashes = window_hashes(kernels.run_hashes(folded, starts, ends), length)[::length]
        seen = np.zeros(1 << 20, bool)
        seen[hashes >> np.uint64(44)] = True
        by_length[length] = (np.unique(hashes), seen)
    return {"windows": windows, "by_length": by_length}


class WindowSet:
    """Hash set of windows: sorted hashes, and the windows to verify against."""

    def __init__(self, windows: dict, by_length: dict):
        self.windows, self.by_length = windows, by_length

    def hits(self, data: np.ndarray, offsets: np.ndarray):
        """Word bounds, and verified (first word, length, items) hits."""
        folded, starts, ends, row = words_of(data, offsets)
        found = []
        if len(starts):
            words = kernels.run_hashes(folded, starts, ends)
            for length, (known, seen) in self.by_length.items():
                hashes = window_hashes(words, length)
                at = np.flatnonzero(seen[hashes >> np.uint64(44)])
                if len(at):
                    at = at[row[at] == row[at + length - 1]]
                    place = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
                    at = at[known[place] == hashes[at]]
                for i in at.tolist():
                    text = b" ".join([folded[s:e].tobytes() for s, e in zip(starts[i : i + length], ends[i : i + length])])
                    if (items := self.windows.get(text)) is not None:
                        found.append((i, length, items))
        return starts, ends, row, found


def _judge(n_words: int, hits, starts, ends, one_in: int):
    """(n_hit, items, spans) of one document; spans are byte ranges of maximal hit word runs."""
    if not hits:
        return 0, [], []
    change = np.zeros(n_words + 1, np.int64)
    for i, length in hits[0]:
        change[i] += 1
        change[i + length] -= 1
    hit = np.cumsum(change[:-1]) > 0
    edge = np.diff(np.r_[0, hit.astype(np.int8), 0])
    spans = [(int(starts[a]), int(ends[b - 1])) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
    return int(hit.sum()), sorted(hits[1]), spans


def _scan(shared, text_col: str, carry: bool, last: bool, out, one_in: int):
    """Task function for one block of windows. ``out`` makes the final batch."""

    def scan(batches):
        windows = WindowSet(**shared.value)
        for batch in batches:
            data, offsets = kernels.utf8(batch.column(text_col))
            earlier = [pickle.loads(h) if h else None for h in batch.column("__hits").to_pylist()] if carry else [None] * batch.num_rows
            verdicts = []
            for lo, hi in kernels.row_chunks(offsets, CHUNK_BYTES):
                own = offsets[lo : hi + 1] - offsets[lo]
                starts, ends, row, found = windows.hits(data[offsets[lo] : offsets[hi]], own)
                first = np.searchsorted(row, np.arange(hi - lo + 1))
                hits: list = [earlier[lo + k] for k in range(hi - lo)]
                for i, length, items in found:
                    k = int(row[i])
                    hits[k] = hits[k] or ([], set())
                    hits[k][0].append((i - int(first[k]), length))
                    hits[k][1].update(items)
                for k in range(hi - lo):
                    a, b = int(first[k]), int(first[k + 1])
                    if last:
                        verdicts.append((b - a, *_judge(b - a, hits[k], starts[a:b] - own[k], ends[a:b] - own[k], one_in)))
                    else:
                        verdicts.append(pickle.dumps(hits[k]) if hits[k] else None)
            yield out(batch, verdicts)

    return scan


def _dirty(verdict, one_in: int) -> bool:
    return verdict[1] > 0 and one_in * verdict[1] >= verdict[0]


def _report(one_in: int):
    def out(batch, verdicts):
        digest = [hashlib.sha256(",".join(v[2]).encode()).hexdigest() for v in verdicts]
        columns = [
            batch.column("id"), pa.array([v[0] for v in verdicts], pa.int64()), pa.array([v[1] for v in verdicts], pa.int64()),
            pa.array([len(v[2]) for v in verdicts], pa.int64()), pa.array(digest, pa.string()), pa.array([_dirty(v, one_in) for v in verdicts], pa.bool_()),
            pa.array([v[2] for v in verdicts], pa.list_(pa.string())),
            pa.array([[{"start": a, "end": b} for a, b in v[3]] for v in verdicts], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ]
        return pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"])

    return out


REPORT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start: long, end: long>>"


def _documents(one_in: int, names):
    def out(batch, verdicts):
        clean = pa.array([not _dirty(v, one_in) for v in verdicts], pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column(n) for n in names], names).filter(clean)

    return out


def _spans(names, text_col: str):
    def out(batch, verdicts):
        texts = batch.column(text_col).to_pylist()
        for k, v in enumerate(verdicts):
            if v[3]:
                raw, at, kept = texts[k].encode(), 0, []
                for a, b in v[3]:
                    kept.append(raw[at:a])
                    at = b
                texts[k] = b"".join([*kept, raw[at:]]).decode()
        columns = [pa.array(texts, batch.column(n).type) if n == text_col else batch.column(n) for n in names]
        return pa.RecordBatch.from_arrays(columns, names)

    return out


def _run(docs: DataFrame, benchmark: DataFrame, text_col: str, out, schema, one_in: int, window: int, block_bytes: int) -> DataFrame:
    spark, current, carry = docs.sparkSession, docs, False
    for last, rows in _blocks(benchmark_windows(benchmark, window=window), block_bytes):
        shared = spark.sparkContext.broadcast(window_set(rows))
        if last:
            return current.mapInArrow(_scan(shared, text_col, carry, True, out, one_in), schema)
        names = docs.columns

        def pass_on(batch, hits, names=names):
            return pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(hits, pa.binary())], [*names, "__hits"])

        kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["__hits binary"])
        current, carry = settle(current.mapInArrow(_scan(shared, text_col, carry, False, pass_on, one_in), kinds)), True
    raise AssertionError("there is always a last block")


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, one_in: int = ONE_IN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: id, word and hit counts, items with occurring windows, byte spans, verdict."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return _run(rows, benchmark, "text", _report(one_in), f"id {rows.schema['id'].dataType.simpleString()}, {REPORT}", one_in, window, block_bytes)


def remove(docs: DataFrame, benchmark: DataFrame, what: str = "documents", text_col: str = "text", window: int = WINDOW, one_in: int = ONE_IN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without the contaminated ones, or (``what="spans"``) all documents
    with the hit words, and what stands between them, cut out. Other columns stay."""
    others = [c for c in docs.columns if c != text_col]
    row = F.struct(F.lit(0).alias("none"), *[column(c).alias(f"c{i}") for i, c in enumerate(others)])
    packed = docs.select(row.alias("row"), column(text_col).alias("text"))
    outs = {"documents": _documents(one_in, packed.columns), "spans": _spans(packed.columns, "text")}
    found = _run(packed, benchmark, "text", outs[what], packed.schema, one_in, window, block_bytes)
    return found.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(f"c{others.index(c)}").alias(c) for c in docs.columns])
