"""Conditions, recodes and row-wise extremes with explicit NULL rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def in_list(c, values) -> Column:
    """Membership that is never NULL: a NULL value is simply not a member."""
    return F.coalesce(_col(c).isin(*values), F.lit(False))


def any_true(p) -> Column:
    """Aggregate OR ignoring NULLs; a group of only NULLs gives false."""
    return F.coalesce(F.bool_or(_col(p)), F.lit(False))


def if_else(condition: Column, yes, no) -> Column:
    """Two-way choice where a NULL condition gives NULL, not the ``no`` branch."""
    return F.when(condition, yes).when(~condition, no)


def _strict(fn, cols) -> Column:
    cols = [_col(c) for c in cols]
    some_null = reduce(lambda a, b: a | b, [c.isNull() for c in cols])
    return F.when(~some_null, fn(*cols))


def row_min(*cols) -> Column:
    """Row-wise minimum, NULL if any input is NULL (``least`` would skip it)."""
    return _strict(F.least, cols)


def row_max(*cols) -> Column:
    """Row-wise maximum, NULL if any input is NULL."""
    return _strict(F.greatest, cols)


def recode(c, labels: dict) -> Column:
    """Replace listed values by labels; unlisted and NULL values become NULL."""
    c = _col(c)
    out = None
    for value, label in labels.items():
        out = F.when(c == value, label) if out is None else out.when(c == value, label)
    return out if out is not None else F.lit(None).cast("string")


def yes_no(condition: Column) -> Column:
    return F.when(condition, "Yes").otherwise("No")


def matches(cols, *patterns: str) -> Column:
    """True if any of the columns matches any of the patterns (three-valued OR)."""
    cols = [cols] if isinstance(cols, (str, Column)) else list(cols)
    return reduce(lambda a, b: a | b, [_col(c).rlike(p) for c in cols for p in patterns])


def label_by_pattern(c, patterns: dict, other="other") -> Column:
    """Label of the first matching pattern."""
    out = None
    for label, pattern in patterns.items():
        hit = _col(c).rlike(pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(other)


def cut(c, breaks: list, labels: list) -> Column:
    """Right-closed bins over ascending ``breaks``; the lowest break is included.

    Break columns that coincide collapse: a value falls in the first bin whose
    upper break is not below it. Values outside the breaks give NULL.
    """
    c = _col(c)
    inside = (c >= breaks[0]) & (c <= breaks[-1])
    out = None
    for upper, label in zip(breaks[1:], labels):
        hit = inside & (c <= upper)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def code_match(cols, code, mode: str = "exact", phenotypes: dict | None = None) -> Column:
    """True if any diagnosis column is "the same code" as ``code``.

    exact compares whole codes, prefix3 the three-character category, and group
    the phenotype both codes fall in.
    """
    code = _col(code)
    if mode == "exact":
        hits = [_col(c) == code for c in cols]
    elif mode == "prefix3":
        hits = [F.substring(_col(c), 1, 3) == F.substring(code, 1, 3) for c in cols]
    elif mode == "group":
        def group(c):
            return F.when(c.isNotNull(), F.nullif(label_by_pattern(c, phenotypes, "none"), F.lit("none")))

        hits = [group(_col(c)) == group(code) for c in cols]
    else:
        raise ValueError(f"unknown match mode: {mode}")
    return reduce(lambda a, b: a | b, hits)
