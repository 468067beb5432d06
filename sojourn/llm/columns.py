"""Small Column helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The six ASCII white-space characters: word separators of every contract here.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once a row.

    Spark inlines a column into every place that reads it, inside lambdas once per
    element; a lambda variable is not inlined.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of the words between ASCII white space; null or blank text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    none = F.array().cast("array<string>")
    return let(trimmed, lambda t: F.when(t == "", none).otherwise(F.split(t, SPACE_RUN)))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def column(name: str) -> Column:
    """A column by its very name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def position(df: DataFrame, name: str) -> str:
    """Name of a column's field in ``whole_row``."""
    return f"c{df.columns.index(name)}"


def whole_row(df: DataFrame) -> Column:
    """All columns in one struct, so that an operator's own columns cannot clash with them."""
    return F.struct(*[column(c).alias(position(df, c)) for c in df.columns])


def unpacked(found: DataFrame, df: DataFrame, changed: dict[str, Column] | None = None, row: str = "row") -> DataFrame:
    """The columns of ``df`` again, from its rows in ``found``; ``changed`` replaces some."""
    changed = changed or {}
    return found.select(*[changed.get(c, F.col(row).getField(position(df, c))).alias(c) for c in df.columns])
