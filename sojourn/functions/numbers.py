"""Rounding for display and tail probabilities.

Spark has no ``erf``, ``lgamma`` or incomplete gamma/beta, so they are built
here from series and continued fractions whose length depends on the degrees of
freedom. They are applied to small result tables, one row per test. Special
functions take and return SQL text, which keeps large expressions cheap to build.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sojourn.functions.logic import _col


def round_even(c, digits: int) -> Column:
    return F.bround(_col(c), digits)


def signif(c, digits: int = 3) -> Column:
    """Round to significant digits; 0 and NULL pass through."""
    c = _col(c).cast("double")
    place = F.floor(F.log10(F.abs(c))).cast("int")
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - place)
    return F.when((c == 0) | c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), c).otherwise(
        F.round(c * scale) / scale
    )


HALF_LOG_2PI = 0.9189385332046727


def ln_gamma_large(x: str) -> str:
    """Stirling's series for log Gamma, for x of 10 or more."""
    return (
        f"((({x}) - 0.5D) * ln({x}) - ({x}) + {HALF_LOG_2PI}D + (1D/12 - (1D/360 - (1D/1260 - (1D/1680 - 1D/1188/(({x})*({x})))"
        f" /(({x})*({x}))) /(({x})*({x}))) /(({x})*({x}))) / ({x}))"
    )


def ln_gamma(x: str) -> str:
    """log Gamma for x > 0: the argument is raised by 10, then divided back out."""
    product = " * ".join(f"(({x}) + {j}D)" for j in range(10))
    return f"({ln_gamma_large(f'({x}) + 10D')} - ln({product}))"


def _gamma_p_series(a: str, x: str) -> str:
    """Lower regularised incomplete gamma by its power series (x <= a + 1)."""
    steps = f"cast(ceil({a} + 12 * sqrt({a} + 1) + 80) AS int)"
    total = (
        f"aggregate(sequence(1, {steps}), named_struct('term', 1D / ({a}), 'sum', 1D / ({a})),"
        f" (s, i) -> named_struct('term', s.term * ({x}) / (({a}) + i), 'sum', s.sum + s.term * ({x}) / (({a}) + i)),"
        f" s -> s.sum)"
    )
    return f"({total} * exp(({a}) * ln({x}) - ({x}) - {ln_gamma(a)}))"


def _gamma_q_fraction(a: str, x: str) -> str:
    """Upper regularised incomplete gamma by its continued fraction (x > a + 1),
    evaluated from the innermost level outwards."""
    depth = f"cast(ceil(60 + 6 * sqrt({a} + 1)) AS int)"
    inner = (
        f"aggregate(sequence({depth}, 1, -1), ({x}) - ({a}) + 1D + 2D * {depth},"
        f" (f, i) -> ({x}) - ({a}) - 1D + 2D * i - i * (i - ({a})) / f)"
    )
    return f"(exp(({a}) * ln({x}) - ({x}) - {ln_gamma(a)}) / {inner})"


def chi2_sf(stat: str, df: str) -> Column:
    """Upper tail of chi-square; NULL in gives NULL out."""
    a, x = f"(cast({df} AS double) / 2)", f"(cast({stat} AS double) / 2)"
    return F.expr(
        f"CASE WHEN {x} IS NULL OR {a} IS NULL OR {a} <= 0 THEN NULL WHEN {x} <= 0 THEN 1D"
        f" WHEN {x} <= {a} + 1 THEN 1D - {_gamma_p_series(a, x)} ELSE {_gamma_q_fraction(a, x)} END"
    )


def _beta_fraction(a: str, b: str, x: str) -> str:
    """Regularised incomplete beta for x below its mean, by the classic even/odd
    continued fraction folded from the innermost level outwards."""
    odd = f"(-(({a}) + i - 1D) * (({a}) + ({b}) + i - 1D) * ({x}) / ((({a}) + 2D*i - 2D) * (({a}) + 2D*i - 1D)))"
    even = f"(i * (({b}) - i) * ({x}) / ((({a}) + 2D*i - 1D) * (({a}) + 2D*i)))"
    depth = f"cast(ceil(40 + 8 * sqrt(greatest({a}, {b}))) AS int)"
    fraction = f"aggregate(sequence({depth}, 1, -1), 1D, (f, i) -> 1D + {odd} / (1D + {even} / f))"
    front = f"exp({ln_gamma(f'({a}) + ({b})')} - {ln_gamma(a)} - {ln_gamma(b)} + ({a}) * ln({x}) + ({b}) * ln(1D - ({x})))"
    return f"({front} / ({a}) / {fraction})"


def f_sf(stat: str, df1: str, df2: str) -> Column:
    """Upper tail of the F distribution."""
    f, a, b = f"(cast({stat} AS double))", f"(cast({df2} AS double) / 2)", f"(cast({df1} AS double) / 2)"
    x, y = f"({a} / ({a} + {b} * {f}))", f"({b} * {f} / ({a} + {b} * {f}))"
    return F.expr(
        f"CASE WHEN {f} IS NULL OR {a} IS NULL OR {b} IS NULL OR {a} <= 0 OR {b} <= 0 THEN NULL WHEN {f} <= 0 THEN 1D"
        f" WHEN {x} < ({a} + 1) / ({a} + {b} + 2) THEN {_beta_fraction(a, b, x)}"
        f" ELSE 1D - {_beta_fraction(b, a, y)} END"
    )
