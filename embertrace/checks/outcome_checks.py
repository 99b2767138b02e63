"""Outcomes of exercised rules. Each process creation opens a span of one rule, of a length that its id decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embertrace.checks.oracle import with_hits
from embertrace.checks.registry import Tables, query
from embertrace.operators import killchain
from embertrace.operators.outcomes import path_outcomes, rule_outcomes, unplanned_hits
from embertrace.plans.telemetry import sql_text
from embertrace.rules import catalogue

RULE_IDS = [*sorted(r.id for r in catalogue()), "NO_SUCH_RULE_001"]


def spans(t: Tables) -> DataFrame:
    made = t.telemetry.filter((F.col("event_type_id") == 1) & F.col("event_time").isNotNull())
    rule = F.get(F.array(*[F.lit(r) for r in RULE_IDS]), (F.col("id") % len(RULE_IDS)).cast("int"))
    minutes = F.make_dt_interval(mins=((F.col("id") % 97) * 10 - 30).cast("int"))
    return made.select(
        F.date_format("event_time", "yyyy-MM-dd").alias("session"), rule.alias("rule_id"),
        F.concat(F.lit("path "), (F.col("id") % 3).cast("string")).alias("path"), F.col("event_time").alias("start"),
        (F.col("event_time") + minutes).alias("end"), (F.col("id") % 7 == 0).alias("blocked"), (F.col("id") % 5 == 0).alias("skipped"),
        F.col("id").alias("made_by"))


def with_spans(body: str) -> str:
    ids = ", ".join(sql_text(r) for r in RULE_IDS)
    return with_hits(f"""
, s AS MATERIALIZED (SELECT strftime(event_time, '%Y-%m-%d') AS session, ([{ids}])[id % {len(RULE_IDS)} + 1] AS rule_id,
  'path ' || (id % 3) AS path, event_time AS a, event_time + to_minutes((id % 97) * 10 - 30) AS b, id % 7 = 0 AS blocked, id % 5 = 0 AS skipped, id AS made_by
  FROM tel WHERE event_type_id = 1 AND event_time IS NOT NULL),
c AS (SELECT made_by, count(*) AS n FROM s JOIN hits h ON h.rule_id = s.rule_id AND h.timestamp BETWEEN s.a AND s.b GROUP BY made_by),
p AS MATERIALIZED (SELECT s.session, s.rule_id, s.path, s.made_by, coalesce(c.n, 0) AS n_hits, CASE
    WHEN s.skipped OR s.rule_id NOT IN (SELECT rule_id FROM rules) THEN 'SKIP' WHEN c.n > 0 THEN 'PASS' WHEN s.blocked THEN 'PARTIAL' ELSE 'FAIL' END AS outcome
  FROM s LEFT JOIN c ON s.made_by = c.made_by)
{body}""")


@query("cov_paths", with_spans("SELECT session, rule_id, path, made_by, n_hits, outcome FROM p"))
def cov_paths(t: Tables):
    """Hits and outcome of every span in which a rule was exercised."""
    found = path_outcomes(spans(t), t.hits, killchain.rules_frame(t.spark))
    return found.select("session", "rule_id", "path", "made_by", "n_hits", "outcome")


@query("cov_outcomes", with_spans("""
, g AS (SELECT session, rule_id, count(*) AS n_paths, CAST(sum(n_hits) AS BIGINT) AS n_hits, count(*) FILTER (WHERE outcome = 'PASS') AS n_pass,
  count(*) FILTER (WHERE outcome = 'PARTIAL') AS n_partial, count(*) FILTER (WHERE outcome = 'FAIL') AS n_fail, count(*) FILTER (WHERE outcome = 'SKIP') AS n_skip
  FROM p GROUP BY session, rule_id)
SELECT *, CASE WHEN n_skip = n_paths THEN 'SKIP' WHEN n_partial + n_fail = 0 THEN 'PASS' WHEN n_partial + n_pass = 0 THEN 'FAIL' ELSE 'PARTIAL' END AS outcome FROM g"""))
def cov_outcomes(t: Tables):
    """Outcome of every rule in every session."""
    return rule_outcomes(path_outcomes(spans(t), t.hits, killchain.rules_frame(t.spark)))


@query("cov_unplanned", with_spans("""
SELECT rule_id, epoch_us(timestamp) AS timestamp, id FROM hits h
WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.rule_id = h.rule_id AND h.timestamp BETWEEN s.a AND s.b)"""))
def cov_unplanned(t: Tables):
    """Hits that no span of their rule covers."""
    return unplanned_hits(spans(t), t.hits)
