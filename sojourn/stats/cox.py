"""Cox proportional-hazards models with Efron ties.

Each Newton step is one Spark job over collapsed (time, event, covariates) counts:
risk-set sums by time, a running sum from the last time backwards, and one row of
log-likelihood, gradient and information back to the driver. The driver only solves
a system as large as the number of coefficients.

Efron's tie terms reduce, per time, to six scalar sums over the d tied events. All but
the last ten terms have a closed form, so a time with a billion events costs no more
than one with ten.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.functions.numbers import chi2_sf
from sojourn.operators.running import choose_blocks, form_of, running_totals
from sojourn.operators.work import settle
from sojourn.stats.km import Z95
from sojourn.stats.profile import complete_cases

MAX_STEPS = 20
TOLERANCE = 1e-9


@dataclass(frozen=True)
class Factor:
    """Categorical covariate; the first level is the reference."""

    name: str
    levels: tuple


def _name(term) -> str:
    return term.name if isinstance(term, Factor) else term


def design(df: DataFrame, terms, keep=("time", "event")) -> tuple[DataFrame, list[str], list[str]]:
    """Complete cases with one numeric column per coefficient.

    Returns the table, the coefficient names and, aligned with them, the term each
    belongs to. A factor gives a 0/1 column per non-reference level; a value outside
    its levels counts as missing.
    """
    names, owners, exprs = [], [], []
    usable = complete_cases(df, [*[c for c in keep], *[_name(t) for t in terms]])
    for term in terms:
        if isinstance(term, Factor):
            usable = usable.filter(F.col(term.name).isin(*term.levels))
            for level in term.levels[1:]:
                names.append(f"{term.name}{level}")
                owners.append(term.name)
                exprs.append(F.when(F.col(term.name) == level, 1.0).otherwise(0.0))
        else:
            names.append(term)
            owners.append(term)
            exprs.append(F.col(term).cast("double"))
    return usable.select(*keep, *[e.alias(f"x{i}") for i, e in enumerate(exprs)]), names, owners


def _ends(coefficients, term, first: int = 1) -> str:
    """Euler-Maclaurin end corrections from the ``first`` on: their terms at y1 less those at z."""
    def at(y: str) -> str:
        return " + ".join(term(c, k, y) for k, c in enumerate(coefficients, 1) if k >= first)
    return f"(({at('y1')}) - ({at('z')}))"


def _power(y: str, k: int) -> str:
    return "(" + " * ".join([y] * k) + ")"


def _with_tie_sums(at_risk: DataFrame) -> DataFrame:
    """Add sums over l = 0..d-1 with f = l/d and a = s0 - f*e0: of ln a (``ln_a``), 1/a
    (``i1``), f/a (``if1``), 1/a^2 (``i2``), f/a^2 (``if2``) and f^2/a^2 (``iff2``).

    With z = d*s0/e0 and y = z - l, a is s0*y/z. The last ten terms, where y can be small,
    are added up one by one; the m before them by Euler-Maclaurin's formula, whose
    remainder is below double precision from y = 10 on. Its integrals are functions of
    v = ln(z/y1) with y1 = z - m; they are summed as series of positive terms, so nothing
    cancels however large z is against m.
    """
    even = ("1D/6", "-1D/30", "1D/42", "-1D/30", "5D/66")
    log_ends = _ends([f"{c}/{2 * k * (2 * k - 1)}" for k, c in enumerate(even, 1)],
                     lambda c, k, y: f"({c}) / {_power(y, 2 * k - 1)}")
    once = [f"{c}/{2 * k}" for k, c in enumerate(even, 1)]
    inv_ends = _ends(once, lambda c, k, y: f"({c}) / {_power(y, 2 * k)}")
    square_ends = _ends(even, lambda c, k, y: f"({c}) / {_power(y, 2 * k + 1)}")

    def mixed(times: int, first: int = 1) -> str:
        pairs = list(zip(even, once))
        return _ends(pairs, lambda c, k, y: f"(({c[0]}) * z / {y} - {times} * ({c[1]})) / {_power(y, 2 * k)}", first)

    staged = at_risk.selectExpr(
        "*", "s0 * d / e0 AS z", "d * greatest(s0 - e0, 0D) / e0 AS past", "greatest(d - 10, 0D) AS m"
    ).selectExpr("*", "d - m + past AS y1").selectExpr("*", "z / y1 AS w", "log1p(m / y1) AS v")
    grow = "s.t * v / i"
    series = staged.selectExpr(
        "*",
        "aggregate(sequence(2, cast(ceil(40 + 4 * v) AS int)), named_struct('t', v, 'up', 0D, 'down', 0D, 'odd', 0D),"
        f" (s, i) -> named_struct('t', {grow}, 'up', s.up + {grow}, 'down', s.down + (i - 1) * {grow},"
        f" 'odd', s.odd + CASE WHEN i % 2 = 1 THEN {grow} ELSE 0D END)) AS e",
    )
    # exp(v)-1-v, exp(-v)-1+v and sinh(v)-v are e.up, e.down/w and e.odd.
    head = series.selectExpr(
        "*",
        f"y1 * v - m + v / 2 - {log_ends} AS h0",
        f"z * v + (1 - w) / 2 + z * {inv_ends} AS h1",
        f"z * z * e.down / w - m * w / 2 + z * z * {inv_ends} AS g1",
        f"m * w + (1 - w * w) / 2 + z * z * {square_ends} AS h2",
        f"z * z * e.up - m * w * w / 2 + z * z * {mixed(1)} AS g2",
        # The first correction of the last sum, written out: its two parts nearly cancel.
        f"z * z * z * 2 * e.odd - m * m * w * w / 2 + m * w * w * w / 6 + z * z * z * {mixed(2, first=2)} AS f2",
    )
    start = (
        "named_struct('ln_a', m * ln(s0) + h0, 'i1', h1 / s0, 'if1', g1 / (d * s0), 'i2', h2 / (s0 * s0),"
        " 'if2', g2 / (d * s0 * s0), 'iff2', f2 / (d * d * s0 * s0))"
    )
    y = "(d - l + past)"
    a = f"(s0 * {y} / z)"
    add = (
        f"named_struct('ln_a', k.ln_a + ln(s0) - log1p(l / {y}), 'i1', k.i1 + 1 / {a}, 'if1', k.if1 + l / d / {a}, 'i2', k.i2 + 1 / ({a}*{a}),"
        f" 'if2', k.if2 + l / d / ({a}*{a}), 'iff2', k.iff2 + l / d * l / d / ({a}*{a}))"
    )
    fold = f"aggregate(sequence(cast(m AS long), cast(d AS long) - 1), {start}, (k, l) -> {add})"
    return head.withColumn("k", F.expr(fold))


def _triangle(p: int):
    return [(i, j) for i in range(p) for j in range(i, p)]


def per_time(counts: DataFrame, eta: str, centred: list[str], by=(), blocks: int | None = None) -> DataFrame:
    """Per event time: events ``d``, log-likelihood ``l``, gradient ``u{i}`` and
    information ``v{i}_{j}``.

    ``counts`` has columns (by…, time, event, n) plus covariates; ``centred`` are the
    covariates and ``eta`` the linear predictor, as SQL over those columns.
    """
    by = list(by)
    p = len(centred)
    tri = _triangle(p)
    base = counts.selectExpr(
        *by, "time", "CASE WHEN event = 1 THEN cast(n AS double) ELSE 0D END AS nd", f"{eta} AS eta",
        f"n * exp({eta}) AS w", f"CASE WHEN event = 1 THEN n * exp({eta}) ELSE 0D END AS wd",
        *[f"{c} AS z{i}" for i, c in enumerate(centred)],
    )
    aggs = {"d": "nd", "eta_d": "nd * eta", "r0": "w", "e0": "wd"}
    for i in range(p):
        aggs.update({f"x{i}": f"nd * z{i}", f"r1_{i}": f"w * z{i}", f"e1_{i}": f"wd * z{i}"})
    for i, j in tri:
        aggs.update({f"r2_{i}_{j}": f"w * z{i} * z{j}", f"e2_{i}_{j}": f"wd * z{i} * z{j}"})
    sums = base.groupBy(*by, "time").agg(*[F.expr(f"sum({e}) AS {name}") for name, e in aggs.items()])
    totals = {"s0": "r0", **{f"s1_{i}": f"r1_{i}" for i in range(p)}, **{f"s2_{i}_{j}": f"r2_{i}_{j}" for i, j in tri}}
    at_risk = running_totals(sums, "time", totals, by=by, descending=True, blocks=blocks).filter("d > 0")
    out = ["d", "eta_d - k.ln_a AS l"]
    out += [f"x{i} - s1_{i} * k.i1 + e1_{i} * k.if1 AS u{i}" for i in range(p)]
    out += [
        f"s2_{i}_{j} * k.i1 - e2_{i}_{j} * k.if1 - s1_{i} * s1_{j} * k.i2"
        f" + (s1_{i} * e1_{j} + e1_{i} * s1_{j}) * k.if2 - e1_{i} * e1_{j} * k.iff2 AS v{i}_{j}"
        for i, j in tri
    ]
    return _with_tie_sums(at_risk).selectExpr(*by, "time", *out)


def _total(p: int, weight: str = "1D", tag: str = "") -> list[Column]:
    names = [f"u{i}" for i in range(p)] + [f"v{i}_{j}" for i, j in _triangle(p)]
    return [F.expr(f"sum({weight} * {n}) AS {tag}{n}") for n in names]


def _vector(row, p: int, tag: str = "") -> np.ndarray:
    return np.array([row[f"{tag}u{i}"] or 0.0 for i in range(p)])


def _matrix(row, p: int, tag: str = "") -> np.ndarray:
    out = np.zeros((p, p))
    for i, j in _triangle(p):
        out[i, j] = out[j, i] = row[f"{tag}v{i}_{j}"] or 0.0
    return out


def _number(x: float) -> str:
    return f"({float(x)!r}D)" if math.isfinite(x) else f"double('{float(x)!r}')"


def _centred(centre) -> list[str]:
    return [f"(x{i} - {_number(c)})" for i, c in enumerate(centre)]


def _predictor(beta, centred) -> str:
    return "(" + " + ".join(f"{_number(b)} * {c}" for b, c in zip(beta, centred)) + ")"


def _step(information: np.ndarray, gradient: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(information, gradient)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(information) @ gradient


def _invert(information: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.inv(information)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(information)


class _Newton:
    """Newton-Raphson with step halving; stops on relative change of the log-likelihood."""

    def __init__(self, p: int):
        self.beta = np.zeros(p)
        self.trial = self.beta
        self.loglik = self.loglik0 = None
        self.done = self.converged = False
        self.steps = 0

    def update(self, loglik: float, gradient: np.ndarray, information: np.ndarray) -> None:
        if self.loglik0 is None:
            self.loglik0 = loglik
            self.score = float(gradient @ _step(information, gradient))
        elif math.isfinite(loglik) and abs(loglik - self.loglik) <= TOLERANCE * abs(loglik):
            self.converged = self.done = True
        elif not math.isfinite(loglik) or loglik < self.loglik:
            self.steps += 1
            self.trial = (self.trial + self.beta) / 2
            self.done = self.steps >= MAX_STEPS
            return
        self.beta, self.loglik, self.information, self.gradient = self.trial, loglik, information, gradient
        if not self.done:
            self.trial = self.beta + _step(information, gradient)
            self.steps += 1
            self.done = self.steps > MAX_STEPS


    def finite(self) -> bool:
        """Whether the estimate settled, not just the log-likelihood. Under separation the
        likelihood levels off while each step still moves the coefficient. Without
        information, as for a constant, there is no estimate."""
        if not np.all(np.diag(self.information) > 0):
            return False
        step = np.abs(_step(self.information, self.gradient))
        return self.converged and not bool(np.any((step > TOLERANCE) & (step > math.sqrt(TOLERANCE) * np.abs(self.beta))))


def two_sided_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2)) if math.isfinite(z) else float("nan")


def _hazard_row(beta: float, se: float) -> tuple:
    with np.errstate(over="ignore"):
        limits = [float(np.exp(v)) for v in (beta, beta - Z95 * se, beta + Z95 * se)]
    z = beta / se if se > 0 else float("nan")
    return limits[0], se, z, two_sided_p(z), limits[1], limits[2]


TIDY = "estimate double, std_error double, statistic double, p_value double, conf_low double, conf_high double"


@dataclass
class CoxFit:
    """A fitted model. Arrays are as long as the coefficient list."""

    spark: SparkSession
    terms: list
    names: list[str]
    owners: list[str]
    centre: np.ndarray
    beta: np.ndarray
    vcov: np.ndarray
    information: np.ndarray
    loglik_null: float
    loglik: float
    score: float
    n: int
    events: int
    steps: int
    converged: bool
    counts: DataFrame = field(repr=False)
    blocks: int = 0

    @property
    def lr(self) -> float:
        return 2 * (self.loglik - self.loglik_null)

    @property
    def wald(self) -> float:
        return float(self.beta @ self.information @ self.beta)

    @property
    def aic(self) -> float:
        return -2 * self.loglik + 2 * len(self.beta)

    @property
    def bic(self) -> float:
        """With the number of persons, not of events, in the penalty."""
        return -2 * self.loglik + math.log(self.n) * len(self.beta)

    def centred(self) -> list[str]:
        return _centred(self.centre)

    def predictor(self) -> str:
        """Linear predictor over the x columns, centred, as SQL."""
        return _predictor(self.beta, self.centred())

    def tidy(self) -> DataFrame:
        """Hazard ratio with confidence limits per coefficient; standard error and
        statistic stay on the log scale."""
        rows = [(name, *_hazard_row(float(b), float(se)))
                for name, b, se in zip(self.names, self.beta, np.sqrt(np.diag(self.vcov)))]
        return self.spark.createDataFrame(rows, f"term string, {TIDY}")

    def glance(self) -> DataFrame:
        """Sizes, log-likelihoods, the three model tests, AIC and BIC."""
        k = len(self.beta)
        row = (self.n, self.events, self.loglik_null, self.loglik, self.lr, k, self.wald, k, self.score, k, self.aic, self.bic, self.converged)
        df = self.spark.createDataFrame(
            [row],
            "n long, events long, loglik_null double, loglik_final double, lr_chisq double, lr_df int,"
            " wald_chisq double, wald_df int, score_chisq double, score_df int, aic double, bic double, converged boolean",
        )
        return df.withColumns({f"{t}_p": chi2_sf(f"{t}_chisq", f"{t}_df") for t in ("lr", "wald", "score")})


def cox_fit(df: DataFrame, terms, blocks: int | None = None) -> CoxFit:
    """Fit one model on (time, event) and the given terms (names or ``Factor``)."""
    table, names, owners = design(df, terms)
    p = len(names)
    xs = [f"x{i}" for i in range(p)]
    counts = settle(table.groupBy("time", "event", *xs).agg(F.count("*").alias("n")))
    n = F.col("n").cast("double")
    head = counts.agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("event") == 1, F.col("n"))).alias("d"), F.count_distinct("time").alias("times"),
        *[(F.sum(n * F.col(x)) / F.sum(n)).alias(x) for x in xs],
    ).first()
    if not head["n"] or not head["d"]:
        raise ValueError("no events among complete cases")
    blocks = form_of(head["times"]) if blocks is None else blocks
    centre = np.array([head[x] for x in xs])
    centred = _centred(centre)
    newton = _Newton(p)
    while not newton.done:
        row = per_time(counts, _predictor(newton.trial, centred), centred, blocks=blocks).agg(F.sum("l").alias("l"), *_total(p)).first()
        newton.update(row["l"], _vector(row, p), _matrix(row, p))
    return CoxFit(
        df.sparkSession, list(terms), names, owners, centre, newton.beta, _invert(newton.information), newton.information,
        newton.loglik0, newton.loglik, newton.score, head["n"], head["d"], newton.steps, newton.converged, counts, blocks,
    )


def null_tests(df: DataFrame, terms, blocks: int | None = None) -> DataFrame:
    """Null log-likelihood, gradient and information for one numeric or two-level term,
    and the score test, without iterating; lazy but for the collapsed table."""
    table, names, _ = design(df, terms)
    if len(names) != 1:
        raise ValueError("one coefficient expected")
    counts, blocks = choose_blocks(table.groupBy("time", "event", "x0").agg(F.count("*").alias("n")), blocks)
    total = per_time(counts, "0D", ["x0"], blocks=blocks).agg(F.sum("l").alias("loglik_null"), *_total(1))
    return total.select(
        F.lit(names[0]).alias("term"), "loglik_null",
        F.when(F.col("v0_0") > 0, F.col("u0") * F.col("u0") / F.col("v0_0")).alias("score_chisq"),
    )


def cox_sweep(df: DataFrame, terms, blocks: int | None = None) -> DataFrame:
    """One single-covariate model per term, all fitted together.

    The table is unpivoted to (var, x) once; every Newton step is one job grouped by
    (var, time) that advances all models still moving. Every term has a row; one without
    events or without variation has NULL estimates and ``finite`` false.
    """
    frames = []
    for term in terms:
        name = _name(term)
        if isinstance(term, Factor):
            if len(term.levels) != 2:
                raise ValueError(f"{name}: a sweep takes numeric and two-level terms")
            frames.append(F.when(F.col(name) == term.levels[1], 1.0).when(F.col(name) == term.levels[0], 0.0).alias(name))
        else:
            frames.append(F.col(name).cast("double").alias(name))
    names = [_name(t) for t in terms]
    long = complete_cases(df, ["time", "event"]).select("time", "event", *frames).unpivot(["time", "event"], names, "var", "x")
    counts = long.filter(F.col("x").isNotNull()).groupBy("var", "time", "event", "x").agg(F.count("*").alias("n"))
    counts = settle(counts)
    n = F.col("n").cast("double")
    heads = {r["var"]: r for r in counts.groupBy("var").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("event") == 1, F.col("n")).otherwise(0)).alias("d"),
        F.count_distinct("time").alias("times"), (F.sum(n * F.col("x")) / F.sum(n)).alias("m")).collect()}
    blocks = form_of(max((h["times"] for h in heads.values()), default=0)) if blocks is None else blocks
    fits = {v: _Newton(1) for v in names if v in heads and heads[v]["d"]}

    def by_var(values: dict) -> str:
        return "(CASE var " + " ".join(f"WHEN '{v}' THEN {_number(b)}" for v, b in values.items()) + " END)"

    while any(not f.done for f in fits.values()):
        moving = {v: f for v, f in fits.items() if not f.done}
        live = counts.filter(F.col("var").isin(*moving))
        z = f"(x - {by_var({v: heads[v]['m'] for v in moving})})"
        eta = f"{z} * {by_var({v: f.trial[0] for v, f in moving.items()})}"
        rows = per_time(live, eta, [z], by=["var"], blocks=blocks).groupBy("var").agg(
            F.sum("l").alias("l"), *_total(1)).collect()
        for row in rows:
            moving[row["var"]].update(row["l"], _vector(row, 1), _matrix(row, 1))
    out = []
    for v in names:
        f = fits.get(v)
        info = float(f.information[0, 0]) if f else 0.0
        if info > 0:
            out.append((v, *_hazard_row(float(f.beta[0]), 1 / math.sqrt(info)), 2 * (f.loglik - f.loglik0), f.score, f.finite()))
        else:
            # No complete case, no event, or nothing that varies at an event: no estimate.
            out.append((v, *[None] * (len(TIDY.split(",")) + 2), False))
    return df.sparkSession.createDataFrame(out, f"var string, {TIDY}, lr_chisq double, score_chisq double, finite boolean")
