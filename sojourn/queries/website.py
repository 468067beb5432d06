"""The study operators on a table that has nothing to do with claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from sojourn import tte
from sojourn.plans import study
from sojourn.queries.reference_sql import r
from sojourn.queries.registry import query, rounded
from sojourn.sources.user_events import CONFIG, events, users
from sojourn.stats import km

USERS = """WITH e AS (
SELECT user_id AS subject_id, CAST(ts AS DATE) AS d, event_type, CAST(value >= 50 AS INT) AS high FROM events
), idx AS (
SELECT subject_id, min(d) AS first_error FROM e WHERE event_type = 'error' AND d BETWEEN DATE '2024-01-08' AND DATE '2024-01-30' GROUP BY 1
), early AS (
SELECT DISTINCT subject_id FROM e WHERE event_type = 'error' AND d < DATE '2024-01-08'
), nxt AS (
SELECT i.subject_id, i.first_error, min(e.d) AS next_error FROM idx i LEFT JOIN e
  ON e.subject_id = i.subject_id AND e.event_type = 'error' AND e.d > i.first_error AND e.d <= DATE '2024-01-30' GROUP BY 1, 2
), t AS (
SELECT subject_id, first_error, CAST(date_diff('day', first_error, coalesce(next_error, DATE '2024-01-30')) AS INT) AS "time",
       CAST(next_error IS NOT NULL AS INT) AS event FROM nxt
)"""


def _people(spark, sf_dir):
    table = events(spark, sf_dir)
    return study.flagged_persons(table, users(table), CONFIG)


@query(prelude=USERS, sql="""SELECT subject_id, first_error, "time", event, subject_id IN (SELECT subject_id FROM early) AS earlier_error FROM t""")
def error_recurrence(spark, sf_dir):
    """Days from each user's first error to the next, and whether errors came before."""
    people = tte.apply_horizon(tte.time_to_event(_people(spark, sf_dir), CONFIG), CONFIG)
    return people.select("subject_id", F.col("first_admit").alias("first_error"), "time", "event", F.col("washout").alias("earlier_error"))


@query(prelude=USERS, sql=f""", p AS (SELECT unnest([1, 3, 7, 14]) AS k), c AS (SELECT "time", count(*) AS c, sum(event) AS d FROM t GROUP BY 1),
n AS (SELECT *, sum(c) OVER (ORDER BY "time" DESC) AS n FROM c),
s AS (SELECT "time", exp(sum(CASE WHEN d < n THEN ln(1 - d / n) END) OVER (ORDER BY "time")) * CAST(max(CAST(d = n AS INT)) OVER (ORDER BY "time") = 0 AS INT) AS s FROM n)
SELECT CAST(k AS INT) AS "time", (SELECT count(*) FROM t WHERE "time" >= k) AS n_risk, {r('coalesce((SELECT arg_max(s, "time") FROM s WHERE "time" <= k), 1)', 'surv')},
       {r('1 - coalesce((SELECT arg_max(s, "time") FROM s WHERE "time" <= k), 1)', 'risk')} FROM p WHERE k <= (SELECT max("time") FROM t)""")
def error_recurrence_landmarks(spark, sf_dir):
    people = tte.apply_horizon(tte.time_to_event(_people(spark, sf_dir), CONFIG), CONFIG)
    return rounded(km.landmarks(km.kaplan_meier(people), CONFIG.landmarks))


@query(prelude=USERS, sql="""
, h AS (SELECT e.*, i.first_error FROM e JOIN idx i ON i.subject_id = e.subject_id
        WHERE e.d < i.first_error AND e.d >= i.first_error - 7 AND e.d >= DATE '2024-01-08'),
g AS (SELECT subject_id, count(*) FILTER (event_type <> 'error') AS prior_other_n, count(*) FILTER (high = 1) AS prior_emergency_n,
      bool_or(event_type = 'purchase') AS hx_purchase FROM h GROUP BY 1)
SELECT i.subject_id, prior_other_n, prior_emergency_n, coalesce(hx_purchase, false) AS hx_purchase FROM idx i LEFT JOIN g ON g.subject_id = i.subject_id""")
def error_lookback(spark, sf_dir):
    """What users did in the week before their first error."""
    return _people(spark, sf_dir).select("subject_id", "prior_other_n", "prior_emergency_n", "hx_purchase")
