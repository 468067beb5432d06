"""A whole study over one claims table and one person table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sojourn import cohort, features, lookback, outcome, tte
from sojourn.config import StudyConfig
from sojourn.operators.idfilter import keep_known
from sojourn.operators.work import settle
from sojourn.sources.person_store import PersonStore


def all_measures(cfg: StudyConfig) -> list[cohort.Measure]:
    return [
        *cohort.exclusion_measures(cfg),
        outcome.same_dx_count(cfg),
        outcome.first_event(cfg, "admission"),
        outcome.last_event(cfg),
        outcome.first_event(cfg, "discharge"),
        lookback.lookback_counts(cfg),
        lookback.comorbidity(cfg),
    ]


def flagged_persons(claims: DataFrame | PersonStore, persons: DataFrame, cfg: StudyConfig, measures=None, hot=None) -> DataFrame:
    """Every indexed person with the measures asked for and all exclusion flags.

    ``hot`` may hold the claims' heavy persons if they are already known. Claims stored by
    person are indexed, linked and summarised in their buckets; of a plain table, only
    claims that pass the configured id filter are shuffled to their person.
    """
    measures = measures or all_measures(cfg)
    if isinstance(claims, PersonStore):
        return _flagged_in_store(claims, persons, cfg, measures)
    index = _index(claims, persons, cfg, measures)
    reached = cohort.reach(claims, measures, cfg)
    if cfg.id_filter:
        index = settle(index)
        reached = keep_known(reached, index, error=cfg.id_filter)
    linked = cohort.link(reached, index, cfg, hot=hot)
    return cohort.flag_persons(index, cohort.summarise(linked, measures))


def _index(claims: DataFrame, persons: DataFrame, cfg: StudyConfig, measures) -> DataFrame:
    index = cohort.index_event(claims, persons, cfg)
    return cohort.index_stay(claims, index, cfg) if any(m.needs_stay for m in measures) else index


def _flagged_in_store(store: PersonStore, persons: DataFrame, cfg: StudyConfig, measures) -> DataFrame:
    index = settle(store.per_person(lambda claims: _index(claims, persons, cfg, measures)))

    def local(claims: DataFrame) -> DataFrame:
        return cohort.summarise(cohort.link_local(cohort.reach(claims, measures, cfg), index), measures)

    def split(claims: DataFrame) -> DataFrame:
        return cohort.summarise(cohort.link(cohort.reach(claims, measures, cfg), index, cfg, hot=store.hot), measures)

    return cohort.flag_persons(index, store.per_person(local, split))


def person_table(claims: DataFrame | PersonStore, persons: DataFrame, cfg: StudyConfig) -> DataFrame:
    """One row per included person: index stay, label, gaps, look-back, comorbidity."""
    people = cohort.included(flagged_persons(claims, persons, cfg))
    people = outcome.with_first_readmit(outcome.with_label(people))
    return outcome.with_gap(people, cfg)


def analysis_table(claims: DataFrame | PersonStore, persons: DataFrame, cfg: StudyConfig) -> DataFrame:
    """The person table with derived features and scaled covariates."""
    people = features.person_features(person_table(claims, persons, cfg), cfg)
    return features.scaled(lookback.label_flags(people, cfg.comorbidities))


def survival_table(claims: DataFrame | PersonStore, persons: DataFrame, cfg: StudyConfig) -> DataFrame:
    """The analysis table with start, end, time and event within the horizon."""
    return tte.apply_horizon(tte.time_to_event(analysis_table(claims, persons, cfg), cfg), cfg)
