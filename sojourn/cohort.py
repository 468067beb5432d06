"""From an event table to a cohort: index events, linked events, exclusions.

Scans and shuffles of the event table are the cost that matters here:

* ``index_event`` reads only qualifying claims and reduces them to one per person
  before the shuffle (``index_stay`` does the same for dates of inpatient days);
* ``link`` joins claims to their person's index once, after ``reach`` has left only
  those that a measure can use, and ``summarise`` computes every per-person measure
  asked for from that one pass.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.config import StudyConfig
from sojourn.functions.dates import month_start, whole_number, ym
from sojourn.functions.logic import any_true, code_match, in_list, matches
from sojourn.operators.columns import select_any
from sojourn.operators.select import order_key
from sojourn.operators.sets import ids
from sojourn.operators.skew import keyed_join

CLAIM_COLUMNS = ("form_cd", "dx1", "dx2", "path_type", "result_type", "los")


# --- predicates over claims ---------------------------------------------------

def inpatient(cfg: StudyConfig) -> Column:
    return F.col("form_cd") == cfg.inpatient_form


def qualifies(cfg: StudyConfig) -> Column:
    """Inpatient claim whose primary diagnosis is in a study phenotype."""
    return inpatient(cfg) & matches("dx1", *cfg.phenotypes.values())


def in_period(cfg: StudyConfig) -> Column:
    """Claim starts within the study years; a plain date range, so it reaches the scan."""
    return F.col("start_dt").between(F.lit(cfg.obs_start), F.lit(cfg.study_end))


def same_diagnosis(cfg: StudyConfig) -> Column:
    """Primary or secondary diagnosis of a linked claim equals the index code."""
    return code_match(["dx1", "dx2"], "index_code", cfg.match, cfg.phenotypes)


def in_lookback(cfg: StudyConfig, days: int | None = None) -> Column:
    """Linked claim falls in ``[index - days, index)``."""
    earliest = F.date_sub("first_admit", days or cfg.lookback_days)
    return (F.col("start_dt") < F.col("first_admit")) & (F.col("start_dt") >= earliest) & in_period(cfg)


def discharge(cfg: StudyConfig) -> Column:
    """Start plus length of stay for inpatient claims, NULL for others."""
    return F.when(inpatient(cfg), F.date_add("start_dt", F.col("los")))


# --- claim-level steps --------------------------------------------------------

def build_events(claims: DataFrame, persons: DataFrame, cfg: StudyConfig, hot: DataFrame | None = None) -> DataFrame:
    """Claims with their person's birth, death and sex; claims of unknown persons drop."""
    return keyed_join(claims, persons, "subject_id", salt_by=cfg.order, hot=hot)


def qualifying_ids(events: DataFrame, cfg: StudyConfig) -> DataFrame:
    return ids(events.filter(qualifies(cfg)))


def claims_of(events: DataFrame, id_set: DataFrame, cfg: StudyConfig, hot: DataFrame | None = None) -> DataFrame:
    """All given claims of the listed persons."""
    return keyed_join(events, id_set, "subject_id", salt_by=cfg.order, how="left_semi", hot=hot)


def within_period(events: DataFrame, cfg: StudyConfig) -> DataFrame:
    return events.filter(in_period(cfg))


def with_discharge(events: DataFrame, cfg: StudyConfig) -> DataFrame:
    return events.withColumn("discharge_dt", discharge(cfg))


# --- index event --------------------------------------------------------------

def index_event(events: DataFrame, persons: DataFrame, cfg: StudyConfig, payload=CLAIM_COLUMNS) -> DataFrame:
    """First qualifying claim per person in the study period.

    Gives ``first_admit``, ``index_code``, the index claim's own ``payload`` and
    ``discharge_dt``, and the person's attributes and age. Each task keeps one claim per
    person, so a heavy person costs one row per task.
    """
    payload = [c for c in payload if c in events.columns]
    claim = F.struct(
        "start_dt", order_key(events, cfg.order).alias("o"), F.struct(*payload, discharge(cfg).alias("discharge_dt")).alias("p")
    )
    first = events.filter(qualifies(cfg) & in_period(cfg)).groupBy("subject_id").agg(F.min(claim).alias("c"))
    index = first.select(
        "subject_id",
        F.col("c.start_dt").alias("first_admit"),
        F.col("c.p.dx1").alias("index_code"),
        *[F.col(f"c.p.{c}").alias(c) for c in [*payload, "discharge_dt"]],
    )
    return with_age(index.join(persons, "subject_id"))


def index_stay(events: DataFrame, index: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Add ``index_discharge``: the earliest discharge of any inpatient claim on the index day.

    Claims shrink to person-days of dates before the shuffle, and a heavy person is
    spread over days.
    """
    days = events.filter(inpatient(cfg) & in_period(cfg)).groupBy("subject_id", F.col("start_dt").alias("first_admit")).agg(
        F.min(discharge(cfg)).alias("index_discharge")
    )
    return index.join(days, ["subject_id", "first_admit"])


def with_age(index: DataFrame) -> DataFrame:
    """Age in calendar years at the index event; NULL if the birth year is not a number."""
    return index.withColumn("age_index", F.year("first_admit") - whole_number("birth_yyyy"))


def invalid_age() -> Column:
    return F.col("age_index").isNull() | (F.col("age_index") < 0)


# --- linked events and one-pass measures --------------------------------------

INDEX_KEYS = ("first_admit", "index_code", "index_discharge", "death_month")


def link(events: DataFrame, index: DataFrame, cfg: StudyConfig, hot: DataFrame | None = None) -> DataFrame:
    """Claims of indexed persons with the person's index date, code and, if known, discharge.

    All index-relative conditions (before, on, after, look-back) are filters on this
    table. Heavy persons are split over salts; see ``operators.skew``.
    """
    return keyed_join(events, _index_side(index), "subject_id", salt_by=cfg.order, hot=hot)


def link_local(events: DataFrame, index: DataFrame) -> DataFrame:
    """``link`` for events that lie together by person and hold no heavy person: a plain
    join, which moves only the index to the events' buckets."""
    return events.join(_index_side(index), "subject_id")


def _index_side(index: DataFrame) -> DataFrame:
    return select_any(index.withColumn("death_month", ym("death_yyyymm")), ["subject_id", *INDEX_KEYS])


@dataclass(frozen=True)
class Measure:
    """A per-person result in two steps: aggregates over the claims of a person-day,
    and aggregates over the days of a person. ``needs_stay`` marks those that refer to
    the index discharge. ``earlier`` selects the claims before the study period that it
    needs, if any; none looks past the end of the study."""

    day: dict = field(default_factory=dict)
    person: dict = field(default_factory=dict)
    needs_stay: bool = False
    earlier: Column | None = None


def reach(events: DataFrame, measures: list[Measure], cfg: StudyConfig) -> DataFrame:
    """The claims that the measures can use. The date bounds reach the scan."""
    wanted = F.col("start_dt") >= F.lit(cfg.obs_start)
    for m in measures:
        if m.earlier is not None:
            wanted = wanted | ((F.col("start_dt") < F.lit(cfg.obs_start)) & m.earlier)
    return events.filter((F.col("start_dt") <= F.lit(cfg.study_end)) & wanted)


def summarise(linked: DataFrame, measures: list[Measure]) -> DataFrame:
    """Compute any number of measures in one pass over linked claims.

    The person-day step shrinks claims map-side and bounds what a person can bring to
    the second step by the number of days in the study.
    """
    day_aggs = {n: c for m in measures for n, c in m.day.items()}
    person_aggs = {n: c for m in measures for n, c in m.person.items()}
    keys = [c for c in ("subject_id", "first_admit", "index_discharge", "start_dt") if c in linked.columns]
    days = linked.groupBy(*keys).agg(
        *[c.alias(n) for n, c in day_aggs.items()]
    )
    return days.groupBy("subject_id").agg(*[c.alias(n) for n, c in person_aggs.items()])


def claim_count(cfg: StudyConfig) -> Measure:
    return Measure(
        {"d_claims": F.count_if(in_period(cfg))},
        {"n_claims": F.sum("d_claims")},
    )


def washout(cfg: StudyConfig) -> Measure:
    """Index code already present, in either diagnosis, before the observation start.

    An index code lies in a study phenotype, so earlier claims with no such code cannot
    equal it. Its three-character category may reach outside the phenotype.
    """
    hit = (F.col("start_dt") < F.lit(cfg.obs_start)) & same_diagnosis(cfg)
    earlier = F.lit(True) if cfg.match == "prefix3" else matches(["dx1", "dx2"], *cfg.phenotypes.values())
    return Measure({"d_washout": any_true(hit)}, {"washout": any_true("d_washout")}, earlier=earlier)


def death_in_stay(cfg: StudyConfig) -> Measure:
    """Death month lies between the admission and discharge months of a stay: of any
    stay in the study period, or with ``death_scope="index"`` of one on the index day."""
    leaves = discharge(cfg)
    hit = (
        in_list("form_cd", cfg.death_forms)
        & in_period(cfg)
        & (F.col("death_month") >= month_start("start_dt"))
        & (F.col("death_month") <= month_start(leaves))
    )
    if cfg.death_scope == "index":
        hit = hit & (F.col("start_dt") == F.col("first_admit"))
    return Measure({"d_death": any_true(hit)}, {"death_in_stay": any_true("d_death")})


def unclear_discharge(cfg: StudyConfig) -> Measure:
    """An inpatient claim without a usable length of stay."""
    leaves = discharge(cfg)
    unclear = leaves.isNull() | F.col("los").isNull() | (leaves < F.col("start_dt"))
    hit = inpatient(cfg) & in_period(cfg) & unclear
    return Measure({"d_unclear": any_true(hit)}, {"unclear_discharge": any_true("d_unclear")})


EXCLUSIONS = ("washout", "death_in_stay", "unclear_discharge", "invalid_age")


def exclusion_measures(cfg: StudyConfig) -> list[Measure]:
    return [claim_count(cfg), washout(cfg), death_in_stay(cfg), unclear_discharge(cfg)]


def flag_persons(index: DataFrame, summary: DataFrame) -> DataFrame:
    """Index persons with their measures and all exclusion flags."""
    return index.join(summary, "subject_id").withColumn("invalid_age", invalid_age())


def included(flagged: DataFrame, reasons=EXCLUSIONS) -> DataFrame:
    """Persons with none of the exclusion reasons."""
    out = flagged
    for reason in reasons:
        out = out.filter(~F.col(reason))
    return out.drop(*reasons)


def attrition(events: DataFrame, persons: DataFrame, flagged: DataFrame, cfg: StudyConfig, reasons=EXCLUSIONS) -> DataFrame:
    """Persons and claims left after each step, in order; only persons in ``persons`` count.

    Claims are counted within the study period, except at ``qualified``, which counts
    everything a qualifying person has.
    """
    per_person = events.groupBy("subject_id").agg(
        F.bool_or(qualifies(cfg)).alias("ok"),
        F.count("*").alias("n_all"),
        F.count_if(in_period(cfg)).alias("n_in"),
    ).filter("ok").join(persons, "subject_id", "left_semi")
    before = per_person.agg(
        F.count("*").alias("p0"), F.sum("n_all").alias("c0"),
        F.count_if(F.col("n_in") > 0).alias("p1"), F.sum("n_in").alias("c1"),
    ).select(F.expr("stack(2, 0, 'qualified', p0, c0, 1, 'in_period', p1, c1) AS (seq, step, n_persons, n_claims)"))
    left = F.lit(True)
    aggs, rows = [], []
    for i, reason in enumerate(["indexed", *reasons]):
        if i:
            left = left & ~F.col(reason)
        aggs += [F.count_if(left).alias(f"p{i}"), F.coalesce(F.sum(F.when(left, F.col("n_claims"))), F.lit(0)).alias(f"c{i}")]
        rows.append(f"{i + 2}, '{reason}', p{i}, c{i}")
    after = flagged.agg(*aggs).select(
        F.expr(f"stack({len(rows)}, {', '.join(rows)}) AS (seq, step, n_persons, n_claims)")
    )
    return before.unionByName(after)


def exclude(cohort: DataFrame, reasons: dict[str, DataFrame]) -> DataFrame:
    """Drop every person listed in any of the id sets, in one anti join."""
    listed = None
    for id_set in reasons.values():
        listed = id_set if listed is None else listed.unionByName(id_set)
    return cohort.join(listed, "subject_id", "left_anti")


def cohort_claims(events: DataFrame, persons_in: DataFrame, cfg: StudyConfig, hot: DataFrame | None = None) -> DataFrame:
    """All study-period claims of the included persons, with age at index."""
    slim = persons_in.select("subject_id", "age_index")
    return keyed_join(within_period(events, cfg), slim, "subject_id", salt_by=cfg.order, hot=hot)
