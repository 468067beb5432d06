"""A Bloom filter of ids, applied to a large table before it is shuffled.

The filter is a bit array made by ordinary aggregates: every id sets a few bits, the bits of
a 64-bit word are united by ``bit_or``, and the words become one array that Spark sends
along as a scalar. Testing a row is arithmetic on its id in the stage that scans it. The
size follows the counted number of ids and the wished error rate, up to ``MAX_BYTES``;
beyond that the error rate rises, and if more than ``WORTHLESS`` of the foreign ids would
pass, the rows are left as they are. An id of the set always passes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.operators.work import settle

ERROR = 0.01
MAX_BYTES = 16 << 20
WORTHLESS = 0.5
WORDS_PER_ROW = 4096


def _positions(id_col: Column, bits: int, hashes: int) -> list[Column]:
    """Bit numbers of an id, from two 31-bit halves of one hash."""
    value = F.xxhash64(id_col)
    start, step = F.shiftrightunsigned(value, 33), value.bitwiseAND(F.lit(0x7FFFFFFF))
    return [(start + step * i + F.lit(i)).bitwiseAND(F.lit(bits - 1)) for i in range(hashes)]


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), position.bitwiseAND(F.lit(63)).cast("int"))


def plan_size(n: int, error: float = ERROR, max_bytes: int = MAX_BYTES) -> tuple[int, int, float]:
    """(bits, hashes, expected error) for ``n`` ids."""
    n = max(n, 1)
    wanted = -n * math.log(error) / math.log(2) ** 2
    bits = min(1 << math.ceil(math.log2(max(wanted, 64))), 1 << int(math.log2(max_bytes * 8)))
    hashes = min(8, max(1, round(bits / n * math.log(2))))
    return bits, hashes, (1 - math.exp(-hashes * n / bits)) ** hashes


@dataclass(frozen=True)
class IdFilter:
    words: DataFrame
    bits: int
    hashes: int
    error: float

    def may_hold(self, id_col: Column) -> Column:
        """False only for ids outside the set, and for NULL."""
        words, test = self.words.scalar(), id_col.isNotNull()
        for p in _positions(id_col, self.bits, self.hashes):
            test = test & (F.get(words, F.shiftright(p, 6).cast("int")).bitwiseAND(_bit(p)) != 0)
        return test


def id_filter(ids: DataFrame, key: str = "subject_id", error: float = ERROR, max_bytes: int = MAX_BYTES) -> IdFilter | None:
    """The filter of a table's ids, or None if it would let most foreign ids pass.

    ``ids`` is read twice (count, bits), so settle what is dear to compute.
    """
    known = ids.select(key).where(F.col(key).isNotNull())
    bits, hashes, expected = plan_size(known.count(), error, max_bytes)
    if expected > WORTHLESS:
        return None
    places = known.select(F.explode(F.array(*_positions(F.col(key), bits, hashes))).alias("p"))
    words = places.select(F.shiftright("p", 6).alias("word"), _bit(F.col("p")).alias("bits"))
    empty = ids.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = words.unionByName(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))

    def in_order(value, by):
        return F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("o"), F.col(value).alias("v")))), lambda x: x["v"])

    rows = words.groupBy(F.shiftright("word", int(math.log2(WORDS_PER_ROW))).alias("row")).agg(in_order("bits", "word").alias("part"))
    return IdFilter(settle(rows.agg(F.flatten(in_order("part", "row")).alias("words"))), bits, hashes, expected)


def keep_known(df: DataFrame, ids: DataFrame, key: str = "subject_id", error: float = ERROR, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``df`` without most of the rows whose key is not among ``ids``; a join with them decides the rest."""
    found = id_filter(ids, key, error, max_bytes)
    return df if found is None else df.where(found.may_hold(F.col(key)))
