"""Search predicates, filters, paging, lookups, joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from embertrace.checks.oracle import with_alerts, with_hits, with_scores, with_tel
from embertrace.checks.registry import NOW, Tables, query
from embertrace.functions.clock import bounds, time_range
from embertrace.functions.lines import expand_json
from embertrace.operators import killchain
from embertrace.operators.metrics import hit_band
from embertrace.operators.search import Fields, search, where
from embertrace.operators.tables import (
    alert_detail, hits_with_events, in_range, labelled, latest_after, newest_first, orphans, page, recent, recent_scores,
    rules_text, rules_with_counts, rules_without_hits, with_parent)
from embertrace.operators.alerts import with_status
from embertrace.sources.stored import event_rows

A, E, H = Fields("alerts"), Fields("events"), Fields("rule_hits")


def _alert_query(name: str, predicate: Callable[[], Column | None], sql_where: str) -> None:
    @query(name, with_alerts(f"SELECT id FROM alerts WHERE {sql_where}"))
    def run(t: Tables):
        return where(t.alerts, predicate()).select("id")


_alert_query("s_plain_text", lambda: A.plain("command_line", "100% DONE_"), "command_line ILIKE '%100% done_%'")
_alert_query("s_plain_int", lambda: A.plain("process_pid", "1007"), "process_pid = 1007")
_alert_query("s_quoted", lambda: A.quoted("process_image", "WINDOWS\\system32\\m"),
             "process_image ILIKE '%windows' || chr(92) || 'system32' || chr(92) || 'm%'")
_alert_query("s_wildcard", lambda: A.wildcard("rule_id", "net_*_00?"), "rule_id ILIKE 'net_%_00_'")
_alert_query("s_range", lambda: A.between("process_pid", "1010", "1030") & A.between("severity", "H", "Low"),
             "process_pid BETWEEN 1010 AND 1030 AND severity BETWEEN 'H' AND 'Low'")
_alert_query("s_range_time", lambda: A.between("timestamp", "2024-01-05T00:00:00+02:00", "2024-01-09T12:00:00Z"),
             "timestamp BETWEEN TIMESTAMP '2024-01-04 22:00:00' AND TIMESTAMP '2024-01-09 12:00:00'")
_alert_query("s_range_open", lambda: A.between("timestamp", "2024-01-25", "*"), "timestamp >= TIMESTAMP '2024-01-25 00:00:00'")
_alert_query("s_and", lambda: A.plain("severity", "high") & A.plain("mitre_tactic", "evasion"),
             "severity ILIKE '%high%' AND mitre_tactic ILIKE '%evasion%'")
_alert_query("s_or", lambda: A.plain("severity", "critical") | A.plain("rule_id", "NET_"),
             "severity ILIKE '%critical%' OR rule_id ILIKE '%NET_%'")
_alert_query("s_not", lambda: ~A.plain("parent_image", "explorer"), "NOT (parent_image ILIKE '%explorer%')")
_alert_query("s_num_as_text", lambda: A.quoted("process_pid", "11") & A.quoted("timestamp", "2024-01-1"),
             "CAST(process_pid AS VARCHAR) ILIKE '%11%' AND strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f') ILIKE '%2024-01-1%'")
_alert_query("s_empty", lambda: None, "true")


@query("s_fields", with_hits("""
SELECT id FROM hits WHERE rule_name ILIKE '%memory%' AND severity ILIKE '%critical%' AND mitre_technique ILIKE '%T1055%'"""))
def s_fields(t: Tables):
    """The fields of the rule-hit context."""
    return where(t.hits, H.plain("rule_name", "memory") & H.plain("severity", "critical") & H.plain("mitre_technique", "T1055")).select("id")


@query("s_context", with_tel("""
SELECT id FROM events_t WHERE event_type_id = 3 AND image ILIKE '%cmd.exe'
  AND timestamp BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-31 00:00:00'
ORDER BY timestamp DESC, id DESC LIMIT 100"""))
def s_context(t: Tables):
    start, end = time_range(NOW, "30d")
    tables = {"events": event_rows(t.telemetry)}
    return search(tables, "events", E.plain("event_type_id", "3") & E.wildcard("image", "*cmd.exe"), start, end).items.select("id")


# --- filters, order, paging -----------------------------------------------------------------

@query("f_time_range", with_alerts("SELECT id FROM alerts WHERE timestamp BETWEEN TIMESTAMP '2024-01-24' AND TIMESTAMP '2024-01-31'"))
def f_time_range(t: Tables):
    return in_range(t.alerts, *time_range(NOW, "7d")).select("id")


@query("f_bounds", with_tel("""
SELECT id FROM tel WHERE event_time >= TIMESTAMP '2024-01-03 10:00:00' AND event_time <= TIMESTAMP '2024-01-04 11:30:59.999999'"""))
def f_bounds(t: Tables):
    return in_range(t.telemetry, *bounds("2024-01-03 10:00:00", "2024-01-04T11:30:59"), "event_time").select("id")


@query("f_severity", with_alerts("SELECT id FROM alerts WHERE severity = 'Critical'"))
def f_severity(t: Tables):
    return t.alerts.filter(F.col("severity") == "Critical").select("id")


@query("f_status", with_alerts("SELECT id FROM alerts WHERE event_fk % 3 = 1"))
def f_status(t: Tables):
    return with_status(t.alerts, t.status_changes).filter(F.col("status") == "acknowledged").select("id")


@query("f_event_type", with_tel("SELECT id FROM tel WHERE event_type_id = 10"))
def f_event_type(t: Tables):
    return t.telemetry.filter(F.col("event_type_id") == 10).select("id")


@query("f_rules_text", with_hits("""
SELECT r.rule_id, count(h.id) AS hit_count FROM rules r LEFT JOIN hits h USING (rule_id)
WHERE (contains(lower(r.rule_name), 'script') OR contains(lower(r.rule_id), 'script')) AND r.severity = 'High' GROUP BY 1"""))
def f_rules_text(t: Tables):
    rules = rules_with_counts(killchain.rules_frame(t.spark), t.hits)
    return rules_text(rules, "Script", "High").select("rule_id", "hit_count")


@query("f_json_like", with_tel("SELECT id FROM tel WHERE event_type_id = 1 AND command_line ILIKE '%DownloadString%'"))
def f_json_like(t: Tables):
    rows = event_rows(t.telemetry.filter(F.col("event_type_id") == 1))
    return rows.filter(E.plain("raw_json", "downloadstring")).select("id")


@query("o_newest_first", with_alerts("""
SELECT id, row_number() OVER (ORDER BY timestamp DESC, id DESC) - 1 AS place FROM alerts"""))
def o_newest_first(t: Tables):
    """The order as row numbers, worked out partition by partition."""
    from embertrace.operators.tables import number_rows

    return number_rows(t.alerts.select("id", "timestamp"), newest_first(), "place").select("id", "place")


@query("l_page", with_alerts("""
SELECT id, (SELECT count(*) FROM alerts WHERE severity = 'High') AS total,
  greatest(1, CAST(ceil((SELECT count(*) FROM alerts WHERE severity = 'High') / 50.0) AS BIGINT)) AS pages
FROM alerts WHERE severity = 'High' ORDER BY timestamp DESC, id DESC LIMIT 50 OFFSET 100"""))
def l_page(t: Tables):
    got = page(t.alerts.filter(F.col("severity") == "High"), 3, 50)
    return got.items.select("id", F.lit(got.total).cast("bigint").alias("total"), F.lit(got.pages).alias("pages"))


@query("l_recent", with_tel("SELECT id FROM events_t WHERE event_type_id = 10 ORDER BY timestamp DESC, id DESC LIMIT 15"))
def l_recent(t: Tables):
    return recent(event_rows(t.telemetry.filter(F.col("event_type_id") == 10)), 15).select("id")


@query("l_latest_hit", with_hits("""
SELECT id, rule_id, epoch_us(timestamp) AS timestamp FROM hits WHERE timestamp > TIMESTAMP '2024-01-20'
ORDER BY hits.timestamp DESC, id DESC LIMIT 1"""))
def l_latest_hit(t: Tables):
    return latest_after(t.hits, NOW.replace(day=20)).select("id", "rule_id", "timestamp")


@query("k_alert_detail", with_alerts("""
SELECT a.id, a.rule_id, e.event_type_id AS event_type, epoch_us(e.timestamp) AS event_timestamp, e.pid AS event_pid, e.image AS event_image
FROM alerts a LEFT JOIN events_t e ON a.event_fk = e.id WHERE a.id = (SELECT max(id) FROM alerts)"""))
def k_alert_detail(t: Tables):
    wanted = t.alerts.agg(F.max("id")).first()[0]
    detail = alert_detail(t.alerts, event_rows(t.telemetry), wanted)
    return detail.select("id", "rule_id", "event_type", "event_timestamp", "event_pid", "event_image")


@query("j_payload", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS leftover FROM events")
def j_payload(t: Tables):
    value, leftover = expand_json(F.col("props"), "$.k", "bigint")
    return t.given("events").select("event_id", value.alias("k"), leftover.alias("leftover"))


@query("j_hit_payload", """
SELECT event_id, CASE WHEN event_id % 5 > 1 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
  CASE WHEN event_id % 5 = 1 THEN substr(props, 2) END AS leftover FROM events""")
def j_hit_payload(t: Tables):
    """NULL stays NULL, text that is not JSON stays as it is."""
    i, props = F.col("event_id"), F.col("props")
    stored = F.when(i % 5 == 1, F.expr("substring(props, 2)")).when(i % 5 > 1, props)
    value, leftover = expand_json(F.col("matched_fields"), "$.k", "bigint")
    return t.given("events").select("event_id", stored.alias("matched_fields")).select(
        "event_id", value.alias("k"), leftover.alias("leftover"))


# --- joins ----------------------------------------------------------------------------------

@query("j_hits_events", with_hits("""
SELECT h.id, e.image, e.pid FROM hits h JOIN events_t e ON h.event_fk = e.id
WHERE e.timestamp >= TIMESTAMP '2024-01-15'"""))
def j_hits_events(t: Tables):
    return hits_with_events(t.hits, in_range(t.telemetry, NOW.replace(day=15), None, "event_time")).select("id", "image", "pid")


@query("j_rules_hits", with_hits("SELECT r.rule_id, count(h.id) AS hit_count FROM rules r LEFT JOIN hits h USING (rule_id) GROUP BY 1"))
def j_rules_hits(t: Tables):
    return rules_with_counts(killchain.rules_frame(t.spark), t.hits).select("rule_id", "hit_count")


@query("a_hit_band", with_hits("""
SELECT band, count(*) AS rules FROM (
  SELECT r.rule_id, CASE WHEN count(h.id) = 0 THEN '0' WHEN count(h.id) <= 5 THEN '1-5' WHEN count(h.id) <= 20 THEN '6-20' ELSE '>20' END AS band
  FROM rules r LEFT JOIN hits h USING (rule_id) GROUP BY 1) x GROUP BY 1"""))
def a_hit_band(t: Tables):
    rules = rules_with_counts(killchain.rules_frame(t.spark), t.hits)
    return rules.groupBy(hit_band(F.col("hit_count")).alias("band")).agg(F.count("*").alias("rules"))


@query("cov_rules", with_hits("""
SELECT rule_id FROM rules WHERE rule_id NOT IN (SELECT rule_id FROM hits WHERE timestamp >= TIMESTAMP '2024-01-30 12:00:00')"""))
def cov_rules(t: Tables):
    late = in_range(t.hits, NOW.replace(day=30, hour=12), None)
    return rules_without_hits(killchain.rules_frame(t.spark), late).select("rule_id")


@query("j_parent", with_tel("""
SELECT c.id, p.parent_event, p.parent_event_image
FROM (SELECT * FROM tel WHERE event_type_id = 1 AND process_id IS NOT NULL) c
LEFT JOIN (
  SELECT process_id, id AS parent_event, image AS parent_event_image FROM (
    SELECT process_id, id, image, row_number() OVER (PARTITION BY process_id ORDER BY event_time, id) AS n
    FROM tel WHERE event_type_id = 1 AND process_id IS NOT NULL) x WHERE n = 1) p
ON c.parent_process_id = p.process_id"""))
def j_parent(t: Tables):
    return with_parent(t.telemetry).select("id", "parent_event", "parent_event_image")


@query("j_scores_events", with_scores("""
SELECT s.event_fk, s.model_type, e.event_type_id FROM scores s JOIN events_t e ON s.event_fk = e.id
ORDER BY s.event_fk DESC, s.model_type DESC LIMIT 20"""))
def j_scores_events(t: Tables):
    return recent_scores(t.scores, t.telemetry).select("event_fk", "model_type", "event_type_id")


@query("j_orphans", with_scores("SELECT count(*) AS n FROM scores WHERE event_fk % 10 = 0 AND event_fk % 4 <> 0"))
def j_orphans(t: Tables):
    """Some scores are pointed at events that do not exist, some at none."""
    fk = F.col("event_fk")
    moved = F.when(fk % 4 == 0, F.lit(None)).when(fk % 10 == 0, -fk - 1).otherwise(fk)
    return orphans(t.scores.withColumn("event_fk", moved), t.telemetry).agg(F.count("*").alias("n"))


@query("u_labelled", with_tel("""
SELECT id, CAST(event_type_id IN (8, 10) AS BIGINT) AS label FROM tel WHERE event_type_id IN (1, 8, 10)
UNION ALL SELECT id, 1 FROM tel WHERE event_type_id = 10"""))
def u_labelled(t: Tables):
    """Repeated rows stay."""
    ids, kind = t.telemetry.select("id", "event_type_id"), F.col("event_type_id")
    twice = ids.filter(kind.isin(8, 10)).unionByName(ids.filter(kind == 10))
    return labelled(ids.filter(kind == 1), twice).select("id", "label")
