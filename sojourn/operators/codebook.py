"""Code patterns evaluated once per distinct code instead of once per row.

A code book has one row per distinct code with a bit for every pattern it matches. Rows
look their codes up by a broadcast join; the book's rows are counted first, and a book of
more than ``MAX_CODES`` codes, which would not be a list of codes any more, is not
broadcast: rows then evaluate the patterns themselves, with equal results.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.operators.work import settle

MAX_CODES = 200_000


@dataclass(frozen=True)
class CodeBook:
    """``table`` has code and bits; None if the codes are too many."""

    patterns: dict[str, str]
    table: DataFrame | None

    def mask(self, *names: str) -> int:
        order = list(self.patterns)
        return sum(1 << order.index(n) for n in set(names))

    def has(self, bits: Column, *names: str) -> Column:
        """Whether bits say that any of the named patterns matched."""
        return bits.bitwiseAND(F.lit(self.mask(*names)).cast("long")) != 0


def pattern_bits(code: Column, patterns: dict[str, str]) -> Column:
    """Bit i is set if the i-th pattern matches; 0 for NULL."""
    if len(patterns) > 62:
        raise ValueError("a code book holds at most 62 patterns")
    one = [F.when(code.rlike(p), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, p in enumerate(patterns.values())]
    return reduce(lambda a, b: a + b, one, F.lit(0).cast("long"))


def code_book(df: DataFrame, columns: Sequence[str], patterns: dict[str, str], max_codes: int = MAX_CODES) -> CodeBook:
    """The book of all codes in the columns, in one pass that reads nothing else."""
    codes = df.select(F.explode(F.array(*[F.col(c) for c in columns])).alias("code")).where("code IS NOT NULL").distinct()
    book = settle(codes.select("code", pattern_bits(F.col("code"), patterns).alias("bits")).where("bits <> 0"))
    return CodeBook(patterns, book if book.count() <= max_codes else None)


def with_code_bits(df: DataFrame, columns: Sequence[str], book: CodeBook, name: str = "code_bits") -> DataFrame:
    """Add the bits of all patterns that any of the columns matches."""
    if book.table is None:
        return df.withColumn(name, reduce(lambda a, b: a.bitwiseOR(b), [pattern_bits(F.col(c), book.patterns) for c in columns]))
    for i, c in enumerate(columns):
        own = F.broadcast(book.table.select(F.col("code").alias(f"__code{i}"), F.col("bits").alias(f"__bits{i}")))
        df = df.join(own, F.col(c) == F.col(f"__code{i}"), "left").drop(f"__code{i}")
    bits = [F.coalesce(f"__bits{i}", F.lit(0).cast("long")) for i in range(len(columns))]
    return df.withColumn(name, reduce(lambda a, b: a.bitwiseOR(b), bits)).drop(*[f"__bits{i}" for i in range(len(columns))])
