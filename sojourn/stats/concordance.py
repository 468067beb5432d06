"""Concordance of a risk score with observed order, counted exactly without pairs.

A comparable pair is an event and someone observed longer, or censored at the same
time. It is concordant if the event has the higher score. Distinct scores get ranks,
and any two different ranks part at exactly one bit: there the higher one has a 1,
the lower a 0, and all higher bits agree. So every pair is counted once, in the cell
(bit position, shared higher bits), from running sums over time. A cell has one row of totals per distinct time. Beyond a stated
number of times these are cut into ``TIME_BLOCKS`` ranges: sums run within (cell, range), and range
totals are carried over. Work grows with rows times bits of the rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sojourn.operators.running import RANGE, form_of, in_ranges, running_totals
from sojourn.operators.work import settle

TIE = -1
# Rows per salt of the topmost bit's cells; salts halve at each bit below, as the cells split in two.
ROWS_PER_SALT = 500_000
# Ranges of distinct times; none holds over 1/256 of them, though ranges are cut from samples.
TIME_BLOCKS = 1024


def _ranked(df: DataFrame) -> DataFrame:
    # Written before it is ranked: the ranks and the join with them would each compute the input again.
    rows = settle(df.groupBy("time", "event", "score").agg(F.sum("n").cast("double").alias("n")))
    scores = rows.select("score").distinct()
    ranks = running_totals(scores, "score", {"rank": "1L"}, blocks=RANGE)
    return settle(rows.join(ranks, "score").select("time", "event", "n", (F.col("rank") - 1).cast("long").alias("rank")))


def _running(cells: DataFrame, blocked: bool) -> DataFrame:
    """Totals of later times (censored ones of the same time too) and events of earlier times, by bit."""
    def over(name: str, after: bool, keys, order: str) -> Column:
        w = Window.partitionBy(*keys).orderBy(order)
        w = w.rowsBetween(1, Window.unboundedFollowing) if after else w.rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(name).over(w), F.lit(0.0))

    cell, sums = ["level", "prefix"], {"a0": True, "a1": True, "e0": False, "e1": False}
    run = cells.withColumns({f"in_{c}": over(c, after, [*cell, "block"], "time") for c, after in sums.items()})
    if blocked:
        per_block = cells.groupBy(*cell, "block").agg(*[F.sum(c).alias(c) for c in sums])
        carried = per_block.select(*cell, "block", *[over(c, after, cell, "block").alias(f"by_{c}") for c, after in sums.items()])
        run = run.join(carried, [*cell, "block"]).withColumns({f"in_{c}": F.col(f"in_{c}") + F.col(f"by_{c}") for c in sums})
    return run.select(
        *cell, "time", "e0", "e1", (F.col("in_a0") + F.col("z0")).alias("later0"), (F.col("in_a1") + F.col("z1")).alias("later1"),
        F.col("in_e0").alias("earlier0"), F.col("in_e1").alias("earlier1"),
    )


def concordance(df: DataFrame, score: str = "score", weight: str | None = None) -> DataFrame:
    """One row: concordant share C (tied scores count half), its standard error, and the
    number of comparable pairs. Needs columns time and event; ``score`` is SQL."""
    n = F.col(weight) if weight else F.lit(1)
    value = F.expr(score)
    base = df.select("time", F.col("event").cast("int").alias("event"), value.cast("double").alias("score"), n.alias("n"))
    rows = _ranked(base.filter("time IS NOT NULL AND event IS NOT NULL AND score IS NOT NULL"))
    top, size, times = rows.agg(F.max("rank"), F.count("*"), F.count_distinct("time")).first()
    if form_of(times) == RANGE:
        rows = settle(rows.join(in_ranges(rows.select("time").distinct(), ["time"], "block", TIME_BLOCKS), "time"))
    else:
        rows = rows.withColumn("block", F.lit(0))
    bits = max(int(top or 0).bit_length(), 1)
    top_salts = 1 << (size // ROWS_PER_SALT).bit_length()
    level = F.explode(F.sequence(F.lit(TIE), F.lit(bits - 1))).alias("level")
    spread = rows.select("time", "block", "event", "rank", "n", level).selectExpr(
        "*",
        f"CASE WHEN level = {TIE} THEN rank ELSE shiftright(rank, level + 1) END AS prefix",
        f"CASE WHEN level = {TIE} THEN 0 ELSE cast(shiftright(rank, greatest(level, 0)) & 1 AS int) END AS bit",
    )

    def total(bit: int, event: int | None = None) -> Column:
        hit = F.col("bit") == bit
        if event is not None:
            hit = hit & (F.col("event") == event)
        return F.sum(F.when(hit, F.col("n")).otherwise(0.0))

    cells = spread.groupBy("level", "prefix", "block", "time").agg(
        total(0).alias("a0"), total(1).alias("a1"),
        total(0, 0).alias("z0"), total(1, 0).alias("z1"),
        total(0, 1).alias("e0"), total(1, 1).alias("e1"),
    )
    cells = _running(cells, form_of(times) == RANGE)
    # Near the top a few cells meet most rows (many persons share the last time), so
    # those cells are repeated and the rows spread over the copies.
    salts = F.expr(f"CASE WHEN level = {TIE} THEN 1 ELSE greatest(1, shiftright({top_salts}L, least(62, {bits - 1} - level))) END")
    spread = spread.withColumn("salt", F.pmod(F.col("rank"), salts))
    cells = cells.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    joined = spread.join(cells, ["level", "prefix", "time", "salt"])
    one = F.col("bit") == 1
    tie = F.col("level") == TIE
    died = F.col("event") == 1
    as_event = F.when(died, F.when(one | tie, F.col("later0")).otherwise(F.col("later1"))).otherwise(0.0)
    other_events = F.when(one | tie, F.col("earlier0") + F.when(died, 0.0).otherwise(F.col("e0"))).otherwise(
        F.col("earlier1") + F.when(died, 0.0).otherwise(F.col("e1"))
    )
    event_credit = F.when(tie, 0.5).when(one, 1.0).otherwise(0.0)
    later_credit = F.when(tie, 0.5).when(one, 0.0).otherwise(1.0)
    per_row = joined.groupBy("time", "event", "rank").agg(
        F.first("n").alias("n"),
        F.sum(as_event * event_credit + other_events * later_credit).alias("c"),
        F.sum(as_event + other_events).alias("m"),
    )
    n_, c, m = F.col("n"), F.col("c"), F.col("m")
    sums = per_row.agg(
        F.sum(n_ * c).alias("sc"), F.sum(n_ * m).alias("sm"),
        F.sum(n_ * c * c).alias("cc"), F.sum(n_ * c * m).alias("cm"), F.sum(n_ * m * m).alias("mm"),
    )
    share = F.col("sc") / F.nullif(F.col("sm"), F.lit(0.0))
    out = sums.withColumn("concordance", share)
    k = F.col("concordance")
    spread_sq = F.greatest(F.col("cc") - 2 * k * F.col("cm") + k * k * F.col("mm"), F.lit(0.0))
    return out.select(
        "concordance",
        (F.sqrt(spread_sq) / F.nullif(F.col("sm") / 2, F.lit(0.0))).alias("std_error"),
        (F.col("sm") / 2).cast("long").alias("pairs"),
    )


def model_concordance(fit) -> DataFrame:
    """Concordance of a fitted model's own linear predictor."""
    return concordance(fit.counts, fit.predictor(), weight="n")
