"""Sources, rule checks, predicates, detection, alerts."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embertrace.checks.oracle import condition_sql, rule_sql, with_alerts, with_hits, with_scores, with_tel
from embertrace.checks.registry import NOW, Tables, query
from embertrace.operators import rule_table
from embertrace.operators.alerts import alert_identity, alerts_from_detected, alerts_from_hits, detect_with_identity, with_status
from embertrace.operators.detect import detect
from embertrace.operators.predicates import condition_column, rule_column
from embertrace.operators.tables import in_range
from embertrace.rules import Condition, Rule
from embertrace.sources.stored import append, event_rows, split_valid, validity
from embertrace.schema import BLANK_FIELDS, BOOL_FIELDS, EVENT_FIELDS, INT_FIELDS, RECORD_FIELDS
from embertrace.session import shared_dir
from embertrace.sources.xml_events import accepted, keep_known_types, parse, rejected, render

# --- sources and sinks ----------------------------------------------------------------------


@query("src_event_filter", with_tel("SELECT id, id % 25 AS event_type_id FROM tel WHERE id % 25 IN (1, 3, 7, 8, 10, 22)"))
def src_event_filter(t: Tables):
    return keep_known_types(t.telemetry.select("id", (F.col("id") % 25).cast("int").alias("event_type_id")))


def _after_xml(field: str) -> str:
    """SQL for a field of a record that went through XML: it is there for the event types that have it; an
    empty text is absent, and some fields are never absent."""
    value = field if field in INT_FIELDS or field in BOOL_FIELDS else f"nullif({field}, '')"
    value = f"coalesce({value}, '')" if field in BLANK_FIELDS else value
    types = ", ".join(str(e) for e, fields in EVENT_FIELDS.items() if field in fields)
    value = f"CASE WHEN event_type_id IN ({types}) THEN {value} END"
    return (f"CAST({value} AS BIGINT)" if field in BOOL_FIELDS else value) + f" AS {field}"


@query("norm_xml", with_tel(f"""
SELECT event_type_id, epoch_us(event_time) AS event_time, computer, {", ".join(map(_after_xml, RECORD_FIELDS))}
FROM tel WHERE coalesce(process_id, source_process_id) IS NOT NULL"""))
def norm_xml(t: Tables):
    """Records to XML and back, all of their columns."""
    return accepted(parse(render(t.telemetry))).drop("id")


@query("norm_reject", with_tel("""
SELECT reject_reason, count(*) AS n FROM (
  SELECT CASE WHEN id % 10 = 0 THEN 'malformed' WHEN id % 10 = 1 THEN 'event type'
    WHEN coalesce(process_id, source_process_id) IS NULL THEN 'process id' END AS reject_reason
  FROM tel) x WHERE reject_reason IS NOT NULL GROUP BY 1"""))
def norm_reject(t: Tables):
    xml = F.col("xml")
    damaged = render(t.telemetry).select(
        F.when(F.col("id") % 10 == 0, F.left(xml, F.lit(150)))
        .when(F.col("id") % 10 == 1, F.regexp_replace(xml, "<EventID>[0-9]+", "<EventID>99"))
        .otherwise(xml).alias("xml"))
    return rejected(parse(damaged)).groupBy("reject_reason").agg(F.count("*").alias("n"))


@query("sink_events", with_tel("SELECT id, event_type_id, epoch_us(timestamp) AS timestamp, pid, image FROM events_t"))
def sink_events(t: Tables):
    return event_rows(t.telemetry).select("id", "event_type_id", "timestamp", "pid", "image")


def _appended(t: Tables, df: DataFrame, kind: str) -> DataFrame:
    """What a table holds after two appends, and what it refused, with ``kept``."""
    path = f"{shared_dir(t.spark)}/sink-{uuid.uuid4().hex}"
    for half in (0, 1):
        append(df.filter(F.col("event_fk") % 2 == half), path, kind)
    kept, refused = (t.spark.read.schema(df.schema).parquet(p) for p in (path, f"{path}_refused"))
    return kept.withColumn("kept", F.lit(1)).unionByName(refused.withColumn("kept", F.lit(0)))


@query("sink_hits", with_hits("""
SELECT id, event_fk, rule_id, CASE WHEN event_fk % 11 = 0 THEN 'Odd' ELSE severity END AS severity, epoch_us(timestamp) AS timestamp,
  CAST(event_fk % 11 <> 0 AS BIGINT) AS kept FROM hits"""))
def sink_hits(t: Tables):
    """Hits through the sink; those of an unknown severity are refused, not lost."""
    odd = t.hits.withColumn("severity", F.when(F.col("event_fk") % 11 == 0, "Odd").otherwise(F.col("severity")))
    return _appended(t, odd, "hits").select("id", "event_fk", "rule_id", "severity", "timestamp", "kept")


@query("sink_alerts", with_alerts("""
SELECT id, event_fk, rule_id, CASE WHEN event_fk % 7 = 0 THEN 'lost' ELSE status END AS status, process_pid,
  CAST(event_fk % 7 <> 0 AS BIGINT) AS kept FROM alerts"""))
def sink_alerts(t: Tables):
    """Alerts through the sink; those of an unknown status are refused, not lost."""
    odd = t.alerts.withColumn("status", F.when(F.col("event_fk") % 7 == 0, "lost").otherwise(F.col("status")))
    return _appended(t, odd, "alerts").select("id", "event_fk", "rule_id", "status", "process_pid", "kept")


@query("sink_scores", with_scores("SELECT event_fk, model_type, score * 1.2 AS score, CAST(score * 1.2 <= 1 AS BIGINT) AS kept FROM scores"))
def sink_scores(t: Tables):
    """Scores through the sink; those out of range are refused, not lost."""
    odd = t.scores.withColumn("score", F.col("score") * 1.2)
    return _appended(t, odd, "scores").select("event_fk", "model_type", "score", "kept")


@query("sink_checks", with_scores("""
SELECT 'scores' AS kind, CAST(score * 1.2 <= 1 AND event_fk % 9 <> 0 AS BIGINT) AS valid, count(*) AS n
FROM scores GROUP BY 1, 2"""))
def sink_checks(t: Tables):
    """Scores pushed out of range, and a model the table does not know, are refused."""
    odd = t.scores.withColumns({
        "score": F.col("score") * 1.2,
        "model_type": F.when(F.col("event_fk") % 9 == 0, "other").otherwise(F.col("model_type"))})
    good, bad = split_valid(odd, "scores")
    both = good.withColumn("valid", F.lit(1)).unionByName(bad.withColumn("valid", F.lit(0)))
    return both.groupBy(F.lit("scores").alias("kind"), "valid").agg(F.count("*").alias("n"))


# --- rule checks, over submissions derived from the events ------------------------------------

OPERATOR_NAMES = ["equals", "contains_any", "same_basename", "sounds_like", "regex"]


def submissions(t: Tables):
    """One made-up rule per event, faults spread by the id."""
    i = F.col("id")
    op = F.get(F.array(*[F.lit(o) for o in OPERATOR_NAMES]), (i % 5).cast("int"))
    condition = F.struct(
        F.lit("image").alias("field"), op.alias("operator"),
        F.when(i % 4 != 0, F.lit("x")).alias("value"),
        F.when(i % 3 != 0, F.array(F.lit("x"))).alias("values"),
        F.when(i % 2 != 0, F.lit("target_image")).alias("reference_field"),
        F.lit(False).alias("allow_null"))
    return t.telemetry.select(
        "id", F.concat(F.lit("R"), i.cast("string")).alias("rule_id"),
        F.when(i % 7 != 0, F.lit("n")).alias("rule_name"), F.when(i % 11 != 0, F.lit("d")).alias("description"),
        F.lit("T1").alias("mitre_technique"), F.lit("Execution").alias("mitre_tactic"),
        F.when(i % 13 == 0, F.lit("Severe")).otherwise(F.lit("High")).alias("severity"),
        F.when(i % 5 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1))).alias("event_ids"),
        F.when(i % 17 == 0, F.lit("XOR")).otherwise(F.lit("AND")).alias("logic"),
        F.array(condition).alias("conditions"))


@query("rule_required", with_tel("""
SELECT id, CASE WHEN id % 7 = 0 AND id % 11 = 0 THEN 'description,rule_name' WHEN id % 7 = 0 THEN 'rule_name'
  WHEN id % 11 = 0 THEN 'description' ELSE '' END AS missing FROM tel"""))
def rule_required(t: Tables):
    return submissions(t).select("id", rule_table.missing_keys().alias("missing"))


@query("rule_enum", with_tel("""
SELECT id, CASE WHEN id % 13 = 0 THEN 'severity' WHEN id % 17 = 0 THEN 'logic' WHEN id % 5 = 3 THEN 'operator' END AS bad
FROM tel"""))
def rule_enum(t: Tables):
    return submissions(t).select("id", rule_table.bad_enum().alias("bad"))


@query("rule_event_ids", with_tel("SELECT id, CAST(id % 5 = 0 AS BIGINT) AS bad FROM tel"))
def rule_event_ids(t: Tables):
    return submissions(t).select("id", rule_table.bad_event_ids().alias("bad"))


@query("rule_operands", with_tel("""
SELECT id, CAST(CASE WHEN id % 5 = 1 THEN id % 3 = 0 WHEN id % 5 = 2 THEN id % 2 = 0 ELSE id % 4 = 0 END AS BIGINT) AS bad
FROM tel"""))
def rule_operands(t: Tables):
    return submissions(t).select("id", rule_table.bad_operands().alias("bad"))


# --- predicates -----------------------------------------------------------------------------

PREDICATE_CASES = {
    "p_equals": Condition("initiated", "equals", value="TRUE"),
    "p_not_equals": Condition("destination_port", "not_equals", value="443"),
    "p_contains": Condition("command_line", "contains", value="DownloadString"),
    "p_not_contains": Condition("command_line", "not_contains", value="%"),
    "p_contains_any": Condition("image_loaded", "contains_any", values=("\\Downloads\\", "\\programdata\\")),
    "p_not_contains_any": Condition("call_trace", "not_contains_any", values=("Automation", "zzz")),
    "p_bits_any_set": Condition("granted_access", "bits_any_set", values=("0x1410", "0x0028", "oops")),
    "p_starts_with": Condition("image", "starts_with", value="c:\\windows"),
    "p_ends_with": Condition("image", "ends_with", value="hta.exe"),
    "p_not_ends_with": Condition("target_image", "not_ends_with", value="LSASS.exe"),
    "p_ends_with_any": Condition("source_image", "ends_with_any", values=("\\winword.exe", "dump.exe")),
    "p_not_ends_with_any": Condition("source_image", "not_ends_with_any", values=("\\winword.exe", "dump.exe")),
    "p_regex": Condition("query_name", "regex", value="^Q.{49,}$"),
    "p_same_basename": Condition("source_image", "same_basename", reference_field="target_image"),
    "p_not_same_basename": Condition("source_image", "not_same_basename", reference_field="target_image"),
}


def _predicate_query(name: str, case: Condition) -> None:
    loose = Condition(case.field, case.operator, case.value, case.values, case.reference_field, allow_null=True)
    sql = with_tel(
        f"SELECT id, CAST({condition_sql(case)} AS BIGINT) AS strict, CAST({condition_sql(loose)} AS BIGINT) AS null_passes FROM tel")

    @query(name, sql)
    def run(t: Tables):
        events = t.telemetry
        return events.select(
            "id", condition_column(case, events.columns).alias("strict"),
            condition_column(loose, events.columns).alias("null_passes"))


for _name, _case in PREDICATE_CASES.items():
    _predicate_query(_name, _case)

EITHER = Rule("EITHER", (1, 10), "Low", "Execution", "T1", (
    Condition("image", "ends_with", value="cmd.exe"), Condition("granted_access", "bits_any_set", values=("0x40",))), logic="OR")
BOTH = Rule("BOTH", (10,), "Low", "Execution", "T1", (
    Condition("source_image", "ends_with", value="procdump.exe"), Condition("granted_access", "bits_any_set", values=("0x10",))))


@query("p_logic", with_tel(f"""
SELECT id, CAST(({condition_sql(EITHER.conditions[0])}) OR ({condition_sql(EITHER.conditions[1])}) AS BIGINT) AS either,
  CAST(({condition_sql(BOTH.conditions[0])}) AND ({condition_sql(BOTH.conditions[1])}) AS BIGINT) AS both FROM tel"""))
def p_logic(t: Tables):
    events = t.telemetry
    return events.select(
        "id", rule_column(EITHER, events.columns).alias("either"), rule_column(BOTH, events.columns).alias("both"))


@query("p_route", with_tel(f"""
SELECT id AS event_fk, 'EITHER' AS rule_id FROM tel WHERE {rule_sql(EITHER)}
UNION ALL SELECT id, 'BOTH' FROM tel WHERE {rule_sql(BOTH)}"""))
def p_route(t: Tables):
    """Rules apply only to their event types, one of them to two types."""
    return detect(t.telemetry, [EITHER, BOTH]).select("event_fk", "rule_id")


FIRED = "TIMESTAMP '2024-02-01 00:00:00'"


@query("detect", with_hits(f"""
SELECT id, event_fk, rule_id, rule_name, severity, mitre_technique, mitre_tactic, CAST(NULL AS VARCHAR) AS matched_fields,
  epoch_us({FIRED}) AS timestamp, epoch_us(timestamp) AS event_time FROM hits"""))
def detect_all(t: Tables):
    """All 51 rules over all events; hits carry the evaluation clock."""
    return detect(t.telemetry, fired_at=NOW + timedelta(days=1))


# --- alerts ---------------------------------------------------------------------------------

ALERTS_SQL = with_alerts("""
SELECT id, rule_hit_fk, event_fk, rule_id, rule_name, severity, mitre_technique, mitre_tactic, process_image, process_pid,
  command_line, parent_image, status, CAST(NULL AS VARCHAR) AS suspected_families, epoch_us(timestamp) AS timestamp FROM alerts""")


@query("al_from_hits", ALERTS_SQL)
def al_from_hits(t: Tables):
    return alerts_from_hits(t.hits, t.telemetry)


@query("al_live", ALERTS_SQL)
def al_live(t: Tables):
    """The same alerts straight from detection, without the join back to the events."""
    return alerts_from_detected(detect_with_identity(t.telemetry))


@query("al_identity", with_tel("""
SELECT id AS event_fk, coalesce(nullif(image, ''), nullif(source_image, '')) AS process_image,
  coalesce(nullif(process_id, 0), nullif(source_process_id, 0)) AS process_pid, command_line, parent_image FROM tel"""))
def al_identity(t: Tables):
    return alert_identity(t.telemetry)


@query("al_status", with_alerts("""
SELECT id, CASE event_fk % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'acknowledged' ELSE 'resolved' END AS status FROM alerts"""))
def al_status(t: Tables):
    return with_status(t.alerts, t.status_changes).select("id", "status")


@query("st_event_checks", with_tel("SELECT count(*) AS n FROM events_t WHERE event_type_id IS NOT NULL"))
def st_event_checks(t: Tables):
    rows = event_rows(t.telemetry)
    return rows.filter(validity("events")).agg(F.count("*").alias("n"))


@query("f_between", with_alerts("""
SELECT id, epoch_us(timestamp) AS timestamp FROM alerts
WHERE timestamp BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-12 18:30:00'"""))
def f_between(t: Tables):
    start, end = NOW.replace(day=10, hour=6), NOW.replace(day=12, hour=18, minute=30)
    return in_range(t.alerts, start, end).select("id", "timestamp")
