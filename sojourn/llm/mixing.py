"""Mixing sources to target weights by the cube method.

Each source gets a target number of words. A document is taken ``floor(rate)`` times for
certain, where ``rate`` is target over source size, and once more with probability
``rate - floor(rate)``. The cube method draws that extra copy so that the words and the
documents taken stay at their expected totals: probabilities of three documents at a time
move along the null space of the two balancing equations until one of them is 0 or 1.
A flight ends with at most two open documents.

Flights run on bounded blocks: a source's documents are dealt by hash, every block flies
on its own, and the open rest of all blocks is dealt again, until a source has one block.
Only there a landing problem remains, of at most ten documents, and the rounding nearest to
their expected words is taken. Blocks settle long documents
first, against all shorter ones, so what stays open is short. All draws are seeded by source, level and block: reruns
agree.

Defined results. Null, empty and blank texts have size 0, can be drawn, and take 0 words.
A null source is a source, ordered last. Rows that repeat id, source and size are one unit,
taken alike; a null id is an id here. An empty table gives an empty result. No document is
taken more than ``cap`` times. Extra columns never matter.
"""

from __future__ import annotations

import sys
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sojourn.llm.columns import position, unpacked, whole_row, word_count
from sojourn.operators.work import settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
BLOCK_ROWS = 16_384
#: So many of a block's longest documents are settled against all others, the rest by threes.
LARGE = 1024
#: Landing tries every rounding of at most so many open documents.
LANDING = 10
EPS = 1e-9


def _null_vector(active, words, docs):
    """A direction that leaves the word and document totals of the active documents alone."""
    if len(active) == 3:
        i, j, k = active
        u = (docs[j] * words[k] - docs[k] * words[j], docs[k] * words[i] - docs[i] * words[k], docs[i] * words[j] - docs[j] * words[i])
        return u if any(u) else (docs[j], -docs[i], 0.0)
    if len(active) == 2:
        i, j = active
        if docs[i] * words[j] == docs[j] * words[i]:
            return (docs[j], -docs[i])
    return None


def _land(words, docs, p) -> np.ndarray:
    """The rounding of a few open documents that comes nearest to their expected words,
    then nearest to their expected number."""
    choices = (np.arange(1 << len(p))[:, None] >> np.arange(len(p))) & 1
    off = [np.abs(choices @ v - p @ v) for v in (docs.astype(float), words.astype(float))]
    return choices[np.lexsort(off)[0]].astype(float)


def _move(p, active, u, draw) -> None:
    """One step of the random walk; afterwards at least one of ``active`` is 0 or 1."""
    up = down = float("inf")
    for i, d in zip(active, u):
        if d > 0:
            up, down = min(up, (1 - p[i]) / d), min(down, p[i] / d)
        elif d < 0:
            up, down = min(up, p[i] / -d), min(down, (1 - p[i]) / -d)
    step = up if draw * (up + down) < down else -down
    for i, d in zip(active, u):
        p[i] += step * d


def _settle_large(x: np.ndarray, c: np.ndarray, p: np.ndarray, count: int, draws, keep: int) -> None:
    """Settle the first ``count`` documents, longest first, against all shorter open ones.

    Three at a time a long document hardly moves: the two others hit a bound first, and it
    would stay open to the end. Here it moves against everything behind it at once, by the
    least change that keeps both totals.
    """
    for i in range(min(len(p), count)):
        while 0 < p[i] < 1:
            rest = i + 1 + np.flatnonzero((p[i + 1 :] > 0) & (p[i + 1 :] < 1))
            if len(rest) < keep:
                return
            w, d = x[rest], c[rest]
            dd, dw, ww = d @ d, d @ w, w @ w
            size = dd * ww - dw * dw
            if size > EPS * dd * ww:
                u = d * ((x[i] * dw - c[i] * ww) / size) + w * ((c[i] * dw - x[i] * dd) / size)
            else:
                u = -x[i] * w / ww if ww else -c[i] * d / dd
            u, at = np.r_[1.0, u], np.r_[i, rest]
            with np.errstate(divide="ignore"):
                up = np.where(u > 0, (1 - p[at]) / u, np.where(u < 0, -p[at] / u, np.inf)).min()
                down = np.where(u > 0, p[at] / u, np.where(u < 0, (p[at] - 1) / u, np.inf)).min()
            p[at] += (up if next(draws) * (up + down) < down else -down) * u
            p[at[p[at] < EPS]] = 0.0
            p[at[p[at] > 1 - EPS]] = 1.0


def fly(words: np.ndarray, docs: np.ndarray, p: np.ndarray, seed, land: bool) -> np.ndarray:
    """Probabilities after the flight, and after landing all 0 or 1; longest documents first."""
    draws = iter(np.random.default_rng(seed).random(4 * len(p) + 8).tolist())
    p = p.astype(float)
    _settle_large(words.astype(float), docs.astype(float), p, LARGE, draws, LANDING if land else 3)
    x, c, out = words.astype(float).tolist(), docs.astype(float).tolist(), p.tolist()

    def settled(i):
        if out[i] < EPS or out[i] > 1 - EPS:
            out[i] = float(round(out[i]))
            return True
        return False

    left = [i for i in range(len(out)) if not settled(i)]
    if not land or len(left) > LANDING:
        waiting, active = iter(left), []
        while True:
            while len(active) < 3 and (i := next(waiting, None)) is not None:
                active.append(i)
            u = _null_vector(active, x, c)
            if u is None:
                break
            _move(out, active, u, next(draws))
            active = [i for i in active if not settled(i)]
        left = active
    out = np.array(out, float)
    if land and left:
        out[left] = _land(words[left], docs[left], out[left])
    return out


def source_targets(units: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source: sid, src, source_size, n_units, target.

    Sources in code point order, null last, have the weights in turn. Filling by weight
    with a cap per source stops the sources of least cap per weight first, so running
    totals in that order give the level. The table has one row per source.
    """
    sums = units.groupBy("src").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.count("*").alias("n_units"))
    placed = sums.withColumn("sid", F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last())) - 1)
    w = F.array(*[F.lit(float(x)) for x in weights])
    rows = placed.withColumn("w", F.get(w, F.col("sid") % len(weights))).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("most") / F.col("w"), "sid")
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share))).withColumns({"before": before, "after": after})
    rows = rows.withColumn("full", (F.col("total") - F.col("before")) * F.col("w") / F.col("after") >= F.col("most"))
    open_words = F.col("total") - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(everything)
    open_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(everything)
    rows = rows.withColumns({"words": open_words, "weight": open_weight})
    target = F.when(F.col("full"), F.col("most")).otherwise(F.col("words") * F.col("w") / F.col("weight"))
    return rows.select("sid", "src", "source_size", "n_units", target.alias("target"))


def _flight(seed: int):
    def run(key, table):
        sid, level, blocks, block = (k.as_py() for k in key)
        order = table.sort_by([("words", "descending"), ("h", "ascending")])
        p = fly(order["words"].to_numpy(), order["n"].to_numpy(), order["p"].to_numpy(), [seed, sid, level, block], blocks == 1)
        return order.set_column(order.column_names.index("p"), "p", pa.array(p)).select(["id", "size", "n", "sid", "whole", "h", "words", "n_blocks", "p"])

    return run


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per unit (id, source, size): n rows of it, source_size, target, ``copies`` of each."""
    sizes = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("src"), word_count(F.col(text_col)).alias("size"))
    units = settle(sizes.groupBy("id", "src", "size").agg(F.count("*").alias("n")))
    sources = settle(source_targets(units, weights, share, cap))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    known = units.join(sources.select(F.col("src").alias("src2"), "sid", "n_units", rate.alias("rate")), F.col("src").eqNullSafe(F.col("src2")))
    open_units = known.select(
        "id", "size", "n", "sid", F.floor("rate").alias("whole"), F.xxhash64("id", "size").alias("h"), (F.col("n") * F.col("size")).alias("words"),
        F.ceil(F.col("n_units") / block_rows).alias("n_blocks"), (F.col("rate") - F.floor("rate")).alias("p"),
    )
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in open_units.schema)
    most = sources.agg(F.max("n_units")).first()[0] or 0
    done, level = None, 0
    while True:
        block = F.pmod(F.xxhash64("h", F.lit(level)), F.col("n_blocks")).alias("block")
        flown = open_units.select("*", F.lit(level).alias("level"), block).groupBy("sid", "level", "n_blocks", "block").applyInArrow(_flight(seed), kind)
        flown = settle(flown)
        landed = flown.where("p = 0 OR p = 1")
        done = landed if done is None else done.unionByName(landed)
        most = ceil(most / block_rows)
        if most <= 1:
            break
        # A flight leaves at most two documents open in a block.
        most, level = 2 * most, level + 1
        open_units = flown.where("p > 0 AND p < 1").withColumn("n_blocks", F.ceil(2 * F.col("n_blocks") / block_rows))
    out = done.select("id", "size", "n", "sid", (F.col("whole") + F.col("p")).cast("long").alias("copies"))
    return out.join(sources.select("sid", "src", "source_size", "target"), "sid").drop("sid")


def taken(docs: DataFrame, **settings) -> DataFrame:
    """One row per document row: id, size, source_size, target, copies, taken words."""
    return mix(docs, **settings).withColumn("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select(
        "id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The mixed documents: each row as often as it is taken, all columns kept."""
    units = settle(mix(docs, id_col, text_col, source_col, **settings).where("copies > 0").select("id", "src", "size", "copies"))
    whole = docs.select(whole_row(docs).alias("row"))
    key, source, text = (F.col("row").getField(position(docs, c)) for c in (id_col, source_col, text_col))
    match = key.eqNullSafe(F.col("id")) & source.eqNullSafe(F.col("src")) & (word_count(text) == F.col("size"))
    rows = whole.join(units.hint("shuffle_hash"), match).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return unpacked(rows, docs)
