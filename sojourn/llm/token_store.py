"""Token ids in raw binary shards, found through a minimal perfect hash index.

Layout under one folder: ``ids-NNNNNN.bin`` holds the ids of a range of documents, end id
included, as little-endian unsigned integers of ``width`` bytes (2 if the vocabulary
allows), in ascending document order; ``shards/`` lists each shard's first token number
and token count; ``index/`` has one row per index bucket: pilots of a minimal perfect
hash over the bucket's keys, and per slot a fingerprint, shard, offset and length. A key
is a document id with a copy number (0 unless ids repeat). Looking up a key hashes it to a
bucket, its pilot gives the slot, and the fingerprint tells a foreign key.

Writing: texts are encoded where they lie, ids are shuffled to their shard, and a task
writes a shard to a temporary name and renames it when complete, so a repeated task
replaces the file by an equal one. Shard bounds are id quantiles, one per
``SHARD_BYTES`` of text; index buckets hold about ``BUCKET_KEYS`` keys.

Defined results. Null and empty texts have only the end id. Ids must be integers; rows
repeating one are copies 0, 1, ... in the order of their token ids; a null id comes last.
An empty table gives no shard and an empty index. Extra columns never matter.
"""

from __future__ import annotations

import re
import sys
import uuid
from array import array
from dataclasses import dataclass
from types import ModuleType
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sojourn.llm import kernels
from sojourn.operators.work import scratch_path, settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHARD_BYTES = 16 << 20
BUCKET_KEYS = 4096
CACHE_PIECES = 400_000
END_ID = 0

#: Byte-level pre-tokenisation always starts a new token at a blank between two characters
#: that are certainly no white space, and keeps a line feed between two such characters for
#: itself, so the parts encode independently.
SAFE = re.compile(r"[\w!-~]")
SAFE_BLANK = re.compile(r" (?<=[\w!-~] )(?=[\w!-~])")
SAFE_LINE = re.compile(r"(?<=[\w!-~])\n(?=[\w!-~])")
#: Letters, then ASCII punctuation: two pre-tokens.
SHAPE = re.compile(r"([^\W\d_]*)([!-/:-@\[-`{-~]*)")
#: Letters of the Latin blocks, whose kind no version of Unicode has changed.
LAST_LATIN = "\u024f"
#: The common piece: such letters, then ASCII punctuation.
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-/:-@\[-`{-~]*)")


#: What stands for a blank in a byte-level vocabulary.
BLANK = chr(256 + 0x20)


def _byte_letters() -> dict[int, str]:
    """Byte -> the printable character that stands for it in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Encodes whole texts with a tokenizer file.

    For a byte-level tokenizer the pieces between safe blanks are encoded once and
    remembered, frequent ones longest; a piece of letters is one pre-token and goes to the
    model directly. Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.width = array(self.code).itemsize
        self.end = array(self.code, [END_ID]).tobytes()
        self.model = self.tokenizer.model
        before = self.tokenizer.pre_tokenizer
        self.by_piece = self.tokenizer.normalizer is None and type(before).__name__ == "ByteLevel" and before.use_regex and not before.add_prefix_space
        self.recent: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}
        self.table = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.marks: dict[str, bytes] = {}
        self.line = self._whole("\n") if self.by_piece else b""

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _token(self, text: str) -> bytes:
        """Ids of one pre-token: a blank or nothing, then characters that are no white space."""
        if text.isascii():
            letters = BLANK + text[1:] if text[0] == " " else text
        else:
            letters = text.encode().decode("latin-1").translate(self.table)
        return array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _marks(self, text: str) -> bytes:
        if text not in self.marks:
            if len(self.marks) >= 10_000:
                self.marks.clear()
            self.marks[text] = self._token(text)
        return self.marks[text]

    def _part(self, lead: str, body: str) -> bytes:
        shape = SHAPE.fullmatch(body)
        if shape is None or max(body) > LAST_LATIN:
            return self._whole(lead + body)
        if shape[1] and shape[2]:
            return self._token(lead + shape[1]) + self._marks(shape[2])
        return self._token(lead + body)

    def _piece(self, piece: str) -> bytes | None:
        """Ids of a blank and ``piece``, now among the recent ones; None unless it begins and ends safely."""
        ids = self.earlier.get(piece)
        if ids is None:
            if plain := PLAIN.fullmatch(piece):
                letters, marks = plain.groups()
                if marks:
                    # the letters are mostly known as a piece of their own
                    ids = self.recent.get(letters) or self.earlier.get(letters) or self._token(" " + letters)
                    ids += self.marks.get(marks) or self._marks(marks)
                else:
                    ids = self._token(" " + letters)
            elif not piece or not SAFE.match(piece[0]) or not SAFE.match(piece[-1]):
                return None
            elif "\n" in piece:
                first, *rest = SAFE_LINE.split(piece)
                ids = self._part(" ", first) + b"".join([self.line + self._part("", r) for r in rest])
            else:
                ids = self._part(" ", piece)
        if len(piece) <= 64:
            if len(self.recent) >= CACHE_PIECES:
                self.earlier, self.recent = self.recent, {}
            self.recent[piece] = ids
        return ids

    def _blanks(self, text: str) -> bytes:
        """Ids of a text, split at safe blanks only."""
        first, *rest = SAFE_BLANK.split(text)
        return b"".join([self._whole(first), *[self._whole(" " + r) for r in rest]])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return self.end
        if not self.by_piece:
            return self._whole(text) + self.end
        first, *rest = text.split(" ")
        ids = list(map(self.recent.get, rest))
        if None in ids:
            for i, known in enumerate(ids):
                if known is None and (piece := self._piece(rest[i])) is not None:
                    ids[i] = piece
        if None in ids or not first or not SAFE.match(first[-1]):
            return self._blanks(text) + self.end
        return b"".join([self._whole(first), *ids, self.end])


def encoder(path: str) -> Encoder:
    """The process's encoder for a file; workers keep it, and what it remembers, between tasks."""
    held = sys.modules.setdefault("sojourn_encoders", ModuleType("sojourn_encoders"))
    if path not in held.__dict__:
        held.__dict__[path] = Encoder(path)
    return held.__dict__[path]


@dataclass(frozen=True)
class Store:
    """A written store. ``rows``: id, copy, shard, pos, n of every document."""

    path: str
    width: int
    buckets: int
    rows: DataFrame
    shards: DataFrame
    index: DataFrame


def _uri(spark: SparkSession, path: str) -> str:
    """The path as a full URI, as the file system library reads it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()
    return re.sub(r"^file:/+", "file:///", full)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _encode(tokenizer_path: str, cuts: np.ndarray):
    def scan(batches):
        encode = encoder(tokenizer_path).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = pa.array([encode(t) for t in part.column("text").to_pylist()], pa.large_binary())
                known = part.column("id")
                shard = np.searchsorted(cuts, known.fill_null(0).to_numpy())
                shard[known.is_null().to_numpy(zero_copy_only=False)] = len(cuts) + 1
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), known, ids.cast(pa.binary())], ["shard", "id", "ids"])

    return scan


def shard_name(shard: int) -> str:
    return f"ids-{shard:06d}.bin"


def _write(uri: str, width: int):
    def scan(batches):
        fs, base = _open(uri)
        shard = out = temporary = last = None
        pos = copy = 0

        def finish():
            if out is not None:
                out.close()
                fs.move(temporary, f"{base}/{shard_name(shard)}")

        for batch in batches:
            rows = []
            for s, key, ids in zip(*[batch.column(c).to_pylist() for c in ("shard", "id", "ids")]):
                if s != shard:
                    finish()
                    shard, pos, last = s, 0, object()
                    temporary = f"{base}/_{shard_name(s)}.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(temporary)
                copy = copy + 1 if key == last else 0
                last = key
                out.write(ids)
                rows.append((s, key, copy, pos, len(ids) // width))
                pos += len(ids) // width
            kinds = (pa.int32(), batch.schema.field("id").type, pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["shard", "id", "copy", "pos", "n"])
        finish()

    return scan


def _slots(h1: np.ndarray, h2: np.ndarray, pilot: np.ndarray, m: int) -> np.ndarray:
    return (kernels.scramble(h1 ^ kernels.scramble(h2 + pilot.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(m)).astype(np.int64)


def perfect_hash(h1: np.ndarray, h2: np.ndarray, per_group: int = 3, tries: int = 1 << 22) -> np.ndarray:
    """Pilots of a minimal perfect hash: keys fall into small groups by ``h1``; large groups
    first, each takes the first pilot that sends its keys to free slots. A group of one key
    names its slot outright (negative pilot)."""
    m = len(h1)
    groups = max(1, -(-m // per_group))
    group = (kernels.scramble(h1) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    sizes = np.bincount(group, minlength=groups)
    starts = np.r_[0, np.cumsum(sizes)]
    pilots, taken = np.zeros(groups, np.int64), np.zeros(m, bool)
    ranked = np.argsort(-sizes, kind="stable")
    for g in ranked[sizes[ranked] > 1]:
        keys = order[starts[g] : starts[g + 1]]
        a, b = h1[keys][None, :], h2[keys][None, :]
        first, step = 0, 8
        while True:
            trial = np.arange(first, first + step)[:, None]
            at = np.sort(_slots(a, b, trial, m), axis=1)
            good = ~taken[at].any(1) & (at[:, 1:] != at[:, :-1]).all(1)
            if good.any():
                k = int(np.argmax(good))
                pilots[g] = first + k
                taken[at[k]] = True
                break
            first, step = first + step, min(step * 2, 4096)
            if first > tries:
                raise ValueError("two keys have the same 128-bit hash")
    lone = ranked[sizes[ranked] == 1]
    pilots[lone] = -1 - np.flatnonzero(~taken)[: len(lone)]
    return pilots


def slots_of(h1: np.ndarray, h2: np.ndarray, pilots: np.ndarray, m: int) -> np.ndarray:
    pilot = pilots[(kernels.scramble(h1) % np.uint64(len(pilots))).astype(np.int64)]
    return np.where(pilot < 0, -1 - pilot, _slots(h1, h2, np.maximum(pilot, 0), m))


INDEX = "bucket long, m long, pilots binary, fingerprints binary, shards binary, positions binary, lengths binary"


def _build(key, table):
    h1, h2 = (table[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
    pilots = perfect_hash(h1, h2)
    slot = slots_of(h1, h2, pilots, len(h1))
    place = np.empty(len(slot), np.int64)
    place[slot] = np.arange(len(slot))
    columns = [(h2 >> np.uint64(32)).astype("<u4"), *[table[c].to_numpy().astype(k) for c, k in (("shard", "<u4"), ("pos", "<u8"), ("n", "<u4"))]]
    blobs = [pilots.astype("<i4").tobytes(), *[c[place].tobytes() for c in columns]]
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "m": pa.array([len(slot)], pa.int64()), **{n: pa.array([b], pa.binary()) for n, b in zip(("pilots", "fingerprints", "shards", "positions", "lengths"), blobs)}})


def look_up(h1: np.ndarray, h2: np.ndarray, row: dict):
    """Found mask, shard, offset and length of hashed keys in one index row."""
    m = row["m"]
    slot = slots_of(h1, h2, np.frombuffer(row["pilots"], "<i4").astype(np.int64), m)
    found = np.frombuffer(row["fingerprints"], "<u4")[slot] == (h2 >> np.uint64(32)).astype(np.uint32)
    return found, *[np.frombuffer(row[c], k)[slot] for c, k in (("shards", "<u4"), ("positions", "<u8"), ("lengths", "<u4"))]


def _find(id_type):
    def find(key, keys, index):
        h1, h2 = (keys[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
        if index.num_rows == 0:
            found, shard, pos, n = np.zeros(len(h1), bool), *[np.zeros(len(h1), np.int64)] * 3
        else:
            found, shard, pos, n = look_up(h1, h2, index.to_pylist()[0])
        columns = {"id": keys["id"], "copy": keys["copy"], "shard": pa.array(shard.astype(np.int32)), "pos": pa.array(pos.astype(np.int64)), "n": pa.array(n.astype(np.int64))}
        return pa.table(columns).filter(pa.array(found))

    return find


def _read(uri: str, width: int):
    def scan(batches):
        fs, base = _open(uri)
        shard = source = None
        for batch in batches:
            sums, at = [], [batch.column(c).to_pylist() for c in ("shard", "pos", "n")]
            for s, pos, n in zip(*at):
                if s != shard:
                    shard, source = s, fs.open_input_file(f"{base}/{shard_name(s)}")
                ids = np.frombuffer(source.read_at(n * width, pos * width), f"<u{width}")
                sums.append(crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "copy", "shard", "pos", "n")], pa.array(sums, pa.int64())], ["id", "copy", "shard", "pos", "n", "ids_crc32"])

    return scan


def _hashed(keys: DataFrame, buckets: int) -> DataFrame:
    hashes = {"h1": F.xxhash64("id", "copy"), "h2": F.xxhash64(F.lit("second"), "copy", "id")}
    return keys.withColumns(hashes).withColumn("bucket", F.pmod("h1", F.lit(buckets)))


def write_store(docs: DataFrame, tokenizer_path: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, bucket_keys: int = BUCKET_KEYS) -> Store:
    """Encode all documents and write shards and index below ``path`` (default: shared scratch)."""
    spark = docs.sparkSession
    path = path or scratch_path(spark)
    uri = _uri(spark, path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
    width = Encoder(tokenizer_path).width
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // shard_bytes))
    cuts = rows.agg(F.percentile_approx("id", [k / n for k in range(1, n)], max(10_000, 20 * n))).first()[0] if n > 1 else []
    cuts = np.unique(np.array(cuts or [], np.int64))
    encoded = rows.mapInArrow(_encode(tokenizer_path, cuts), "shard int, id long, ids binary")
    dealt = encoded.repartition("shard").sortWithinPartitions("shard", F.col("id").asc_nulls_last(), "ids")
    written = settle(dealt.mapInArrow(_write(uri, width), "shard int, id long, copy long, pos long, n long"))
    totals = written.groupBy("shard").agg(F.sum("n").alias("tokens"))
    first = F.sum("tokens").over(Window.orderBy("shard")) - F.col("tokens")
    totals.withColumn("first_token", first).write.parquet(f"{path}/shards")
    keys = written.count()
    buckets = max(1, -(-keys // bucket_keys))
    built = _hashed(written, buckets).select("bucket", "h1", "h2", "shard", "pos", "n").groupBy("bucket").applyInArrow(_build, INDEX)
    built.write.parquet(f"{path}/index")
    return Store(path, width, buckets, written, spark.read.parquet(f"{path}/shards"), spark.read.schema(INDEX).parquet(f"{path}/index"))


def find_keys(store: Store, keys: DataFrame) -> DataFrame:
    """(id, copy, shard, pos, n) of those ``keys`` (id, copy) that the index knows."""
    hashed = _hashed(keys.select(F.col("id").cast("long"), F.col("copy").cast("long")), store.buckets)
    return hashed.groupBy("bucket").cogroup(store.index.groupBy("bucket")).applyInArrow(_find(None), "id long, copy long, shard int, pos long, n long")


def read_store(store: Store, keys: DataFrame | None = None) -> DataFrame:
    """Per key, from the files: id, copy, start (tokens before it in the store), n_tokens, ids_crc32."""
    spark = store.index.sparkSession
    found = find_keys(store, store.rows.select("id", "copy") if keys is None else keys)
    dealt = found.repartition("shard").sortWithinPartitions("shard", "pos")
    read = dealt.mapInArrow(_read(_uri(spark, store.path), store.width), "id long, copy long, shard int, pos long, n long, ids_crc32 long")
    return read.join(store.shards, "shard").select("id", "copy", (F.col("first_token") + F.col("pos")).alias("start"), F.col("n").alias("n_tokens"), "ids_crc32")
