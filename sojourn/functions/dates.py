"""Day- and month-grained dates. Unparsable text gives NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sojourn.functions.logic import _col


def ymd(c) -> Column:
    return F.try_to_date(_col(c).cast("string"), "yyyyMMdd")


def ym(c) -> Column:
    """First day of a ``yyyyMM`` month."""
    return F.try_to_date(_col(c).cast("string"), "yyyyMM")


def month_start(c) -> Column:
    return F.trunc(_col(c), "month")


def years_after(c, n: int) -> Column:
    """Same day ``n`` years on; 29 February rolls back to the 28th."""
    return F.add_months(_col(c), 12 * n)


def days_between(start, end) -> Column:
    return F.date_diff(_col(end), _col(start))


def whole_number(c) -> Column:
    """Integer from text, NULL when the text is not a number."""
    return _col(c).try_cast("int")
