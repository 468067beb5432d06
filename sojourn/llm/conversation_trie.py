"""Trie of conversation prefixes, rolled up by centroid decomposition.

A node is a distinct sequence of first turns. It is named by 128 bits that add up along
the sequence, four sums of hashes of (position, turn) modulo 2^32, so a prefix is named by
a running sum and its parent by a subtraction, whatever the length of a conversation.

``rollup`` sums values over subtrees. A component of the parent-edge forest is split at
its centroid, the lightest node that still carries over half of the component; the
sum of the centroid's part goes to every node on the way up to the component's top, which
are exactly the nodes that carry over half. Weights are turns at or below a node, known
from one count, and halve at each split: a node takes part in a logarithmic number of
splits however deep the trie. Components of more than ``bound`` nodes are split by joins
over the whole table, one level of all of them at a time; smaller ones are finished in a
task, a bucket of them together.

Positions and running sums are taken per (conversation, block) and block totals added, so a
conversation that holds a large share of all rows is spread over tasks. Counts are
reduced in each task before they meet. The hash over a node's conversation ids is
streamed over pieces that are joined beforehand.

Defined results. Null role or text counts as empty. Rows without a conversation id belong
to no conversation. Equal turns are ordered by role, then by the SHA-256 of role and text;
repeated rows are turns of their own. A conversation without turns ends at the root; an
empty table has no node. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.llm.columns import word_count
from sojourn.operators.work import settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROOT = "0" * 32
#: Turns of one conversation whose running sums one task takes.
BLOCK = 4096
#: Nodes of a component that is finished in one task.
BOUND = 20_000
PIECE_BYTES = 1 << 20
SPREAD = 4096


def ordered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, name, words): turns by position from 1; ``name`` stands for role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).where("conv IS NOT NULL")
    name = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    rows = rows.select("conv", "turn", "role", name.alias("name"), word_count(F.col("text")).alias("words"), F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).alias("spread"))
    dealt = settle(rows.repartitionByRange("conv", "turn", "role", "name", "spread").withColumn("part", F.spark_partition_id()))
    local = dealt.withColumn("pos", F.expr("row_number() OVER (PARTITION BY conv, part ORDER BY turn, role, name)").cast("long"))
    parts = dealt.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = parts.select("conv", "part", F.expr("sum(n) OVER (PARTITION BY conv ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)").alias("before"))
    before = before.where("before > 0")
    placed = local.join(before, ["conv", "part"], "left")
    return placed.select("conv", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "name", "words")


def spliced(turns: DataFrame, step: int, heads: int) -> DataFrame:
    """(conv, length, pos, name, words): every conversation with its first turns replaced.

    Conversation c starts with the first h turns of conversation c - c % step and goes on
    with its own turns after its first h; h is crc32(c) modulo ``heads``. Position 0 holds a
    row for every conversation, so those without turns stay.
    """
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(heads))
    sizes = turns.groupBy("conv").agg(F.count("*").alias("n")).withColumn("h", h).withColumn("base", F.expr(f"conv - conv % {step}"))
    known = sizes.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    plans = sizes.join(known, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    plans = settle(plans.select("conv", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    first = turns.where(F.col("pos") < heads).withColumnRenamed("conv", "base")
    start = plans.where("taken > 0").join(first, "base").where("pos <= taken").select("conv", "length", "pos", "name", "words")
    rest = turns.join(plans, "conv").where("pos > h").select("conv", "length", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "name", "words")
    top = plans.select("conv", "length", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("name"), F.lit(0).cast("long").alias("words"))
    return top.unionByName(start).unionByName(rest)


def whole(turns: DataFrame) -> DataFrame:
    """(conv, length, pos, name, words) of conversations as they are, with a row at position 0."""
    return spliced(turns, 1, 1)


def visits(sequences: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv, depth, node, parent, words, left): the node of every first part of a conversation;
    ``left`` counts the turns after it."""
    low = F.lit(0xFFFFFFFF)

    def term(k: int) -> Column:
        both = F.xxhash64(F.lit(k // 2 + 17), "pos", "name")
        half = both if k % 2 else F.shiftrightunsigned(both, 32)
        return F.when(F.col("pos") == 0, F.lit(0)).otherwise(half.bitwiseAND(low)).cast("long")

    rows = sequences.withColumns({f"t{k}": term(k) for k in range(4)}).withColumn("block", F.expr(f"(pos - 1) div {block}"))
    sums = {f"p{k}": F.expr(f"sum(t{k}) OVER (PARTITION BY conv, block ORDER BY pos)") for k in range(4)}
    totals = rows.groupBy("conv", "block").agg(*[F.sum(f"t{k}").alias(f"s{k}") for k in range(4)])
    over = "OVER (PARTITION BY conv ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    starts = totals.select("conv", "block", *[F.expr(f"sum(s{k}) {over}").alias(f"s{k}") for k in range(4)]).where("block > 0")
    rows = rows.withColumns(sums).join(starts, ["conv", "block"], "left")

    def name(minus: bool) -> Column:
        words = [F.col(f"p{k}") + F.coalesce(f"s{k}", F.lit(0)) - (F.col(f"t{k}") if minus else 0) for k in range(4)]
        return F.concat(*[F.lpad(F.hex(w.bitwiseAND(low)), 8, "0") for w in words])

    parent = F.when(F.col("pos") > 0, name(True))
    return rows.select("conv", F.col("pos").alias("depth"), name(False).alias("node"), parent.alias("parent"), "words", (F.col("length") - F.col("pos")).alias("left"))


def centroid_sums(parent: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree sums of ``values`` (nodes x columns) over a forest, by centroid decomposition.

    ``parent`` holds indexes, -1 at tops. ``weight`` is positive and counts whole subtrees:
    a node's weight exceeds the sum of its children's.
    """
    n = len(parent)
    out, weight = np.zeros_like(values), weight.copy()
    up = np.where(parent < 0, np.arange(n), parent)
    alive, top = np.arange(n), _tops(up)
    while len(alive):
        comp = top[alive]
        path = 2 * weight[alive] > weight[comp]
        on, own = alive[path], comp[path]
        order = np.argsort(-weight[on], kind="stable")
        centre = np.full(n, -1)
        centre[own[order]] = on[order]  # the lightest is written last
        is_centre = np.zeros(n, bool)
        is_centre[centre[own]] = True
        rest = alive[~is_centre[alive]]
        cut = rest[is_centre[up[rest]]]
        above = up[cut]
        up[cut] = cut
        top = _tops(up)
        totals = np.zeros_like(values)
        np.add.at(totals, top[rest], values[rest])
        found = values * is_centre[:, None]
        np.add.at(found, above, totals[cut])
        out[on] += found[centre[own]]
        lighter = on[~is_centre[on]]
        weight[lighter] -= weight[centre[own[~is_centre[on]]]]
        alive = rest
    return out


def _tops(up: np.ndarray) -> np.ndarray:
    while True:
        further = up[up]
        if np.array_equal(further, up):
            return up
        up = further


def _finish(values: Sequence[str]):
    """Task function: subtree sums inside the components of one bucket."""

    def finish(bucket: pa.Table) -> pa.Table:
        names, weight = bucket["node"].to_pylist(), bucket["weight"].to_numpy()
        place = {(c, v): i for i, (c, v) in enumerate(zip(bucket["comp"].to_pylist(), names))}
        parent = np.array([place.get((c, p), -1) for c, p in zip(bucket["comp"].to_pylist(), bucket["parent"].to_pylist())])
        sums = centroid_sums(parent, weight, np.stack([bucket[v].to_numpy() for v in values], 1))
        columns = [pa.array(sums[:, k] + bucket[f"sum_{v}"].to_numpy()) for k, v in enumerate(values)]
        return pa.Table.from_arrays([bucket["node"].combine_chunks(), *columns], names=["node", *values])

    return finish


def rollup(nodes: DataFrame, paths: DataFrame, values: Sequence[str], bound: int = BOUND) -> DataFrame:
    """(node, values): sums of long columns over the subtree of every node.

    ``nodes`` has node, parent, depth, conv (any conversation through the node) and
    weight (over its whole subtree); ``paths`` the visits of these conversations.
    """
    columns = ["comp", "node", "parent", "depth", "conv", "weight", *values, *[f"sum_{v}" for v in values]]
    start = nodes.withColumns({"comp": F.lit(ROOT), **{f"sum_{v}": F.lit(0).cast("long") for v in values}})
    todo, finished, closed = settle(start.select(*columns)), [], []
    steps = paths.select("conv", F.col("depth").alias("at"), F.col("node").alias("branch"), F.col("parent").alias("above"))
    while True:
        sizes = settle(todo.groupBy("comp").agg(F.count("*").alias("n"), F.max("weight").alias("total")))
        large = sizes.where(F.col("n") > bound).drop("n")
        closed.append(todo.join(large, "comp", "left_anti"))
        if large.isEmpty():
            break
        part = todo.join(large, "comp").withColumn("heavy", F.col("weight") * 2 > F.col("total"))
        centre = F.min_by(F.struct("node", "depth", "weight"), "weight")
        centres = settle(part.where("heavy").groupBy("comp").agg(centre.alias("z")))
        part = part.join(centres, "comp")
        deep = part.where("depth > z.depth").withColumn("at", F.col("z.depth") + 1).join(steps, ["conv", "at"])
        inside = F.col("above") == F.col("z.node")
        deep = deep.withColumn("next", F.when(inside, F.col("branch")).otherwise(F.col("comp"))).drop("at", "branch", "above")
        part = settle(deep.unionByName(part.where("depth <= z.depth").withColumn("next", F.col("comp"))))
        taken = part.where("next <> comp OR node = z.node").groupBy("comp").agg(*[F.sum(v).alias(f"more_{v}") for v in values])
        part = part.join(taken, "comp").withColumns({f"sum_{v}": F.expr(f"sum_{v} + if(heavy, more_{v}, 0)") for v in values})
        part = settle(part.withColumn("weight", F.expr("if(heavy AND node <> z.node, weight - z.weight, weight)")))
        finished.append(part.where("node = z.node").select("node", *[F.col(f"sum_{v}").alias(v) for v in values]))
        todo = part.where("node <> z.node").withColumn("comp", F.col("next")).select(*columns)
    small = settle(reduce(DataFrame.unionByName, closed))
    buckets = max(1, -(-small.count() // bound))
    dealt = small.withColumn("bucket", F.pmod(F.xxhash64("comp"), F.lit(buckets)))
    own = dealt.groupBy("bucket").applyInArrow(_finish(values), "node string, " + ", ".join(f"{v} long" for v in values))
    return reduce(DataFrame.unionByName, finished, own)


def ends_digest(ends: DataFrame) -> DataFrame:
    """(node, digest): SHA-256 of the decimal ids in ``conv``, ascending and comma-joined."""

    def pieces(batches):
        for batch in batches:
            node, conv = batch.column("node").to_pylist(), batch.column("conv").to_pylist()
            out, at = [], 0
            while at < len(node):
                end, size = at, 0
                while end < len(node) and node[end] == node[at] and size < PIECE_BYTES:
                    size += 20
                    end += 1
                out.append((node[at], conv[at], ",".join(map(str, conv[at:end]))))
                at = end
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.string())], ["node", "first", "piece"])

    def digests(batches):
        node, state = None, None
        for batch in batches:
            out = []
            for key, piece in zip(batch.column("node").to_pylist(), batch.column("piece").to_pylist()):
                if key != node:
                    if node is not None:
                        out.append((node, state.hexdigest()))
                    node, state = key, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in (0, 1)], ["node", "digest"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], ["node", "digest"])

    ends = settle(ends.select("node", F.col("conv").cast("long").alias("conv")))
    joined = ends.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv").mapInArrow(pieces, "node string, first long, piece string")
    return joined.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digests, "node string, digest string")


def prefix_nodes(sequences: DataFrame, bound: int = BOUND, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie over ``whole`` or ``spliced`` conversations:

    conv (smallest member), depth, parent_conv, n_convs, n_children, n_leaves and saved
    tokens of its subtree, and the digest of the conversations that end there.
    """
    steps = settle(visits(sequences, block))
    nodes = steps.groupBy("node").agg(
        F.min("conv").alias("conv"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.max("words").alias("words"),
        F.count("*").alias("n_convs"), F.sum(F.col("left") + 1).alias("weight"),
    )
    nodes = settle(nodes)
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes = settle(nodes.withColumns({"n_leaves": F.expr("if(n_children = 0, 1L, 0L)"), "saved": F.expr("(n_convs - 1) * words")}))
    sums = rollup(nodes, steps, ["n_leaves", "saved"], bound)
    digests = ends_digest(steps.where(F.col("left") == 0))
    names = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv"))
    found = nodes.drop("n_leaves", "saved").join(names, "parent", "left").join(sums, "node").join(digests, "node", "left")
    digest = F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256))
    return found.select("node", "conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved", digest.alias("ends_sha256"))
