"""SimHash near-duplicates: fingerprints, trie self-join, components.

A fingerprint has a bit set where more than half of the document's word shingles have it
set in their hash. Equal fingerprints are one node from the start, so a group of copies,
however large, is one row in everything that follows.

The join finds nodes within ``max_bits`` differing bits. With four blocks of 16 bits and
three errors one block is always equal, so four tries are built, each over the bits
rotated to bring another block to the front; in the first 16 levels only equal nodes
pair. Each (trie, first block) is a cell, and a task traverses its cells' node pairs
together, adding up differing bits and giving up a pair beyond the budget
(``kernels.trie_links``). A cell with too many nodes is dealt to tasks as node pairs four
levels down, again as long as needed, so no task holds an unbounded cell. Only links of
a spanning tree leave a task: never all pairs of a cluster, and no link between classes
is lost.

Defined results. Null, empty and blank texts have no shingle, so fingerprint zero, and
link like any other. A text of fewer words than a shingle is one shingle. Rows may repeat
an id: each has its own fingerprint. A null id counts as later than every other; a
component of null ids only has a null id. Extra columns never matter.
"""

from __future__ import annotations

import sys
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm import kernels
from sojourn.llm.columns import position, unpacked, whole_row
from sojourn.llm.components import components
from sojourn.operators.work import settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCKS, BLOCK_BITS = 4, 16
CELL_LIMIT = 100_000


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of UTF-8 text, lower-casing A-Z only."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles, n = [b" ".join(words)], 1
    else:
        shingles, n = map(b" ".join, zip(*[words[i:] for i in range(shingle)])), len(words) - shingle + 1
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, row, fp): ``row`` is a hash of id and text, ``fp`` the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def scan(batches):
        for batch in batches:
            values = np.fromiter((fingerprint(t or b"", shingle) for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), pa.array(values.view(np.int64))], ["id", "row", "fp"])

    return rows.mapInArrow(scan, f"id {kind}, row long, fp long")


def _cells(nodes: DataFrame) -> DataFrame:
    """(r, depth, a, b, side, v): rows of each (trie, first block) cell."""
    turned = F.explode(F.expr(f"transform(sequence(0, {BLOCKS - 1}), r -> struct(r AS r, (shiftleft(fp, r * {BLOCK_BITS}) | IF(r = 0, 0L, shiftrightunsigned(fp, 64 - r * {BLOCK_BITS}))) AS v))"))
    rows = nodes.select(turned.alias("t")).select("t.r", "t.v")
    block = F.shiftrightunsigned("v", 64 - BLOCK_BITS)
    return rows.select("r", F.lit(BLOCK_BITS).alias("depth"), block.alias("a"), block.alias("b"), F.lit(0).alias("side"), "v")


def _divided(cells: DataFrame, max_bits: int, limit: int) -> DataFrame:
    """Deal cells over ``limit`` rows as pairs of nodes four levels further down."""
    key = ["r", "depth", "a", "b"]
    sizes = cells.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > limit)
    out = None
    while True:
        large = settle(sizes)
        if large.isEmpty():
            return cells if out is None else out.unionByName(cells)
        rest = cells.join(large.drop("n"), key, "left_anti")
        # From here on only the large cells remain to be divided.
        out = rest if out is None else out.unionByName(rest)
        nibble = F.expr("CAST(shiftrightunsigned(v, 60 - depth) & 15 AS INT)")
        split = cells.join(large.drop("n"), key).withColumn("c", nibble).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(15))))
        own = F.col("a") == F.col("b")
        first = F.when(own, F.least("c", "d")).when(F.col("side") == 0, F.col("c")).otherwise(F.col("d"))
        second = F.when(own, F.greatest("c", "d")).when(F.col("side") == 0, F.col("d")).otherwise(F.col("c"))
        side = F.when(own, (F.col("c") > F.col("d")).cast("int")).otherwise(F.col("side"))
        split = split.withColumns({"f": first, "s": second, "side2": side}).select(
            "r", (F.col("depth") + 4).alias("depth"), (F.col("a") * 16 + F.col("f")).alias("a"), (F.col("b") * 16 + F.col("s")).alias("b"), F.col("side2").alias("side"), "v"
        )
        cells = settle(split.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
        sizes = cells.groupBy(*key).agg(F.count("*").alias("n")).where((F.col("n") > limit) & (F.col("depth") < 60))


def _traverse(max_bits: int, batch_rows: int):
    """Task function: rows ordered by cell and side give spanning links of the cells."""

    def links(table):
        r, depth, a, b, side, v = (table[c].to_numpy() for c in ("r", "depth", "a", "b", "side", "v"))
        v = v.view(np.uint64)
        fresh = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (depth[1:] != depth[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        last = np.r_[fresh[1:], len(r)]
        middle = fresh + np.add.reduceat(side == 0, fresh)
        own = a[fresh] == b[fresh]
        used = np.bitwise_count((a[fresh] ^ b[fresh]).view(np.uint64)).astype(np.int64)
        cells = np.stack([fresh, np.where(own, last, middle), np.where(own, fresh, middle), last, used], 1)
        cells = cells[(cells[:, 1] > cells[:, 0]) & (cells[:, 3] > cells[:, 2]) & ~(own & (last - fresh < 2))]
        for at in np.unique(depth[cells[:, 0]]):
            labels = kernels.trie_links(v, cells[depth[cells[:, 0]] == at], int(at), max_bits)
            moved = np.flatnonzero(labels != np.arange(len(labels)))
            if len(moved):
                # A label never crosses a trie, so both ends turn back alike.
                turn = (r[moved] * BLOCK_BITS).astype(np.uint64)
                back = lambda x, t=turn: np.where(t == 0, x, (x >> t) | (x << ((np.uint64(64) - t) & np.uint64(63))))
                yield pa.RecordBatch.from_arrays([pa.array(back(v[moved]).view(np.int64)), pa.array(back(v[labels[moved]]).view(np.int64))], ["u", "v"])

    def scan(batches):
        held = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) < batch_rows:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            keys = [table[c].to_numpy() for c in ("r", "depth", "a", "b")]
            same = np.logical_and.reduce([k == k[-1] for k in keys])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield from links(table.slice(0, cut).combine_chunks())
            held = table.slice(cut).to_batches()
        if sum(x.num_rows for x in held):
            yield from links(pa.Table.from_batches(held).combine_chunks())

    return scan


def near_links(nodes: DataFrame, max_bits: int = 3, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """(u, v) links between distinct fingerprints that reach every pair within ``max_bits``."""
    if not 0 < max_bits < BLOCKS:
        raise ValueError(f"max_bits must be 1 to {BLOCKS - 1}: with {BLOCKS} blocks one is equal up to then")
    cells = _divided(_cells(nodes), max_bits, cell_limit)
    key = ["r", "depth", "a", "b"]
    # The input partitions of the shuffle are sized by Spark's settings; cells are whole in one.
    dealt = cells.repartition(*key).sortWithinPartitions(*key, "side", "v")
    return dealt.mapInArrow(_traverse(max_bits, 1 << 16), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """One row per document: id, row, fp, label (smallest fp of the component), component_id."""
    rows = settle(fingerprints(docs, id_col, text_col, shingle))
    nodes = settle(rows.groupBy("fp").agg(F.min("id").alias("first")))
    labels = components(near_links(nodes.select("fp"), max_bits, cell_limit))
    known = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    known = settle(known)
    smallest = known.groupBy("label").agg(F.min("first").alias("component_id"))
    classes = known.join(smallest, "label").select("fp", "label", "component_id")
    return rows.join(classes, "fp").select("id", "row", "fp", "label", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """The first document of each component, all columns kept. Rows with equal id and text are
    one: of these the row whose other columns are smallest as JSON text, NULL last, stays."""
    found = settle(near_duplicates(docs, id_col, text_col, shingle, max_bits).select("id", "row", "label"))
    first = found.groupBy("label").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("f")).select(F.col("f.id").alias("id"), F.col("f.row").alias("key"))
    whole = docs.select(whole_row(docs).alias("row"))
    own_id, text = (F.col("row").getField(position(docs, c)) for c in (id_col, text_col))
    kept = whole.join(first, own_id.eqNullSafe(F.col("id")) & (F.xxhash64(own_id, text) == F.col("key")))
    if not found.groupBy("id", "row").count().where("count > 1").isEmpty():
        others = [F.col("row").getField(position(docs, c)) for c in docs.columns if c not in (id_col, text_col)]
        order = F.concat_ws("\0", *[F.coalesce(F.to_json(F.struct(c.alias("v"))), F.lit("")) for c in others]) if others else F.lit("")
        kept = kept.groupBy("id", "key").agg(F.min_by("row", order).alias("row"))
    return unpacked(kept, docs)
