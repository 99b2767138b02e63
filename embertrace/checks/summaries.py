"""Aggregations, kill chain, process tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from embertrace.checks.oracle import with_alerts, with_hits, with_scores, with_tel
from embertrace.checks.feature_checks import VECTOR_SQL
from embertrace.checks.registry import NOW, Tables, query
from embertrace.functions.clock import time_range
from embertrace.operators import identity, killchain, metrics, tree
from embertrace.operators.features import BINARY_FEATURES, event_vectors
from embertrace.operators.detect import detect
from embertrace.schema import TACTICS

WEEK = "timestamp BETWEEN TIMESTAMP '2024-01-24' AND TIMESTAMP '2024-01-31'"
TACTIC_CTE = "tactics AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{i}', '{n}', {p})" for p, (i, n) in enumerate(TACTICS, 1)) + ") v(tactic_id, tactic_name, display_order))"


def week():
    return time_range(NOW, "7d")


@query("flagship", with_hits("""
SELECT rule_id, rule_name, count(*) AS hit_count,
  CASE max(CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END)
    WHEN 4 THEN 'Critical' WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS top_severity
FROM hits GROUP BY 1, 2"""))
def flagship(t: Tables):
    """Detection over all events, straight into the ranked rule counts."""
    return metrics.top_rules(detect(t.telemetry), None, None, limit=None)


@query("a_stats", with_alerts(f"""
SELECT (SELECT count(*) FROM alerts WHERE {WEEK}) AS total_alerts, (SELECT count(*) FROM events_t WHERE {WEEK}) AS total_events,
  (SELECT count(*) FROM hits WHERE {WEEK}) AS total_rule_hits, (SELECT count(DISTINCT rule_id) FROM hits WHERE {WEEK}) AS rules_fired,
  (SELECT count(*) FROM alerts WHERE {WEEK} AND severity = 'Low') AS severity_low,
  (SELECT count(*) FROM alerts WHERE {WEEK} AND severity = 'Medium') AS severity_medium,
  (SELECT count(*) FROM alerts WHERE {WEEK} AND severity = 'High') AS severity_high,
  (SELECT count(*) FROM alerts WHERE {WEEK} AND severity = 'Critical') AS severity_critical"""))
def a_stats(t: Tables):
    events = t.telemetry.select(F.col("event_time").alias("timestamp"))
    return metrics.stats(t.alerts, events, t.hits, *week())


@query("a_severity", with_alerts(f"""
SELECT l.severity, count(a.id) AS n FROM (VALUES ('Low'), ('Medium'), ('High'), ('Critical')) l(severity)
LEFT JOIN (SELECT * FROM alerts WHERE {WEEK}) a USING (severity) GROUP BY 1"""))
def a_severity(t: Tables):
    return metrics.severity_distribution(t.alerts, *week())


def _timeline_sql(start: str, end: str, micros: int, label: str) -> str:
    return with_alerts(f"""
SELECT epoch_us(TIMESTAMP '{start}') + b.i * {micros} AS bucket, count(a.id) AS n, '{label}' AS interval
FROM range(0, CAST((epoch_us(TIMESTAMP '{end}') - epoch_us(TIMESTAMP '{start}')) // {micros} AS BIGINT) + 1) b(i)
LEFT JOIN (SELECT * FROM alerts WHERE timestamp BETWEEN TIMESTAMP '{start}' AND TIMESTAMP '{end}') a
  ON (epoch_us(a.timestamp) - epoch_us(TIMESTAMP '{start}')) // {micros} = b.i
GROUP BY b.i""")


@query("a_timeline", _timeline_sql("2024-01-24 00:00:00", "2024-01-31 00:00:00", 6 * 3_600_000_000, "6h"))
def a_timeline(t: Tables):
    return metrics.timeline(t.alerts, *week())


@query("a_interval", _timeline_sql("2024-01-30 22:17:00", "2024-01-31 00:00:00", 300_000_000, "5m"))
def a_interval(t: Tables):
    """A shorter range takes a finer step, from its own start."""
    return metrics.timeline(t.alerts, NOW.replace(day=30, hour=22, minute=17), NOW)


@query("a_top_rules", with_hits(f"""
SELECT rule_id, rule_name, count(*) AS hit_count,
  CASE max(CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END)
    WHEN 4 THEN 'Critical' WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS top_severity
FROM hits WHERE {WEEK} GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10"""))
def a_top_rules(t: Tables):
    return metrics.top_rules(t.hits, *week())


@query("a_rule_hits_since", with_hits("SELECT rule_id, count(*) AS hit_count FROM hits WHERE timestamp >= TIMESTAMP '2024-01-20' GROUP BY 1"))
def a_rule_hits_since(t: Tables):
    return metrics.hits_per_rule_since(t.hits, NOW.replace(day=20))


@query("a_hit_span", with_hits("""
SELECT epoch_us(min(timestamp)) AS first_hit, epoch_us(max(timestamp)) AS last_hit FROM hits
WHERE starts_with(rule_id, 'API_') AND timestamp >= TIMESTAMP '2024-01-10'"""))
def a_hit_span(t: Tables):
    return metrics.hit_span(t.hits, "API_", NOW.replace(day=10))


@query("a_totals", with_alerts("SELECT 'alerts' AS table_name, count(*) AS n FROM alerts UNION ALL SELECT 'events', count(*) FROM tel"))
def a_totals(t: Tables):
    return metrics.table_counts({"alerts": t.alerts, "events": t.telemetry})


@query("a_table_counts", with_alerts("""
SELECT 'events' AS table_name, count(*) AS n FROM tel UNION ALL SELECT 'rule_hits', count(*) FROM hits
UNION ALL SELECT 'alerts', count(*) FROM alerts UNION ALL SELECT 'model_scores', count(*) FROM scores"""))
def a_table_counts(t: Tables):
    return metrics.table_counts({"events": t.telemetry, "rule_hits": t.hits, "alerts": t.alerts, "model_scores": t.scores})


# --- kill chain -----------------------------------------------------------------------------

def mapping(t: Tables):
    return killchain.tactic_map(killchain.rules_frame(t.spark))


STATUS_SQL = with_hits(f"""
, {TACTIC_CTE}, per_rule AS (
  SELECT r.rule_id, r.mitre_tactic, count(h.id) AS hit_count, max(h.timestamp) AS last_seen
  FROM rules r LEFT JOIN (SELECT * FROM hits WHERE {WEEK}) h USING (rule_id) GROUP BY 1, 2)
SELECT t.tactic_id, t.tactic_name, CAST(t.display_order AS BIGINT) AS display_order, CAST(coalesce(sum(p.hit_count), 0) > 0 AS BIGINT) AS fired,
  CAST(coalesce(sum(p.hit_count), 0) AS BIGINT) AS hit_count, epoch_us(max(p.last_seen)) AS last_seen,
  coalesce(string_agg(CASE WHEN p.hit_count > 0 THEN p.rule_id || '=' || CAST(p.hit_count AS VARCHAR) END, ',' ORDER BY p.hit_count DESC, p.rule_id), '') AS fired_rules,
  count(p.rule_id) AS total_rules_mapped, coalesce(string_agg(p.rule_id, ',' ORDER BY p.rule_id), '') AS all_rule_ids
FROM tactics t LEFT JOIN per_rule p ON t.tactic_name = p.mitre_tactic GROUP BY 1, 2, 3""")


@query("a_tactic_status", STATUS_SQL)
def a_tactic_status(t: Tables):
    status = killchain.tactic_status(t.hits, mapping(t), *week())
    shown = F.transform("fired_rules", lambda r: F.concat(r["rule_id"], F.lit("="), r["hit_count"].cast("string")))
    return status.withColumn("fired_rules", F.coalesce(shown, F.array().cast("array<string>")))


@query("j_tactics", with_hits(f"""
, {TACTIC_CTE} SELECT t.tactic_id, count(h.id) AS hit_count FROM tactics t
LEFT JOIN rules r ON r.mitre_tactic = t.tactic_name LEFT JOIN hits h ON h.rule_id = r.rule_id
  AND h.timestamp BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31' GROUP BY 1"""))
def j_tactics(t: Tables):
    return killchain.tactic_status(t.hits, mapping(t), *time_range(NOW, "30d")).select("tactic_id", "hit_count")


@query("j_tactic_rules", with_hits("""
SELECT r.rule_id, count(*) AS hit_count FROM hits h JOIN rules r USING (rule_id)
WHERE r.mitre_tactic = 'Command and Control' AND h.timestamp BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31' GROUP BY 1"""))
def j_tactic_rules(t: Tables):
    return killchain.tactic_detail(t.hits, mapping(t), "TA0011", *time_range(NOW, "30d")).select("rule_id", "hit_count")


@query("a_tactic_detail", with_hits(f"""
SELECT r.rule_id, r.rule_name, r.mitre_technique AS technique_id, count(*) AS hit_count, epoch_us(max(h.timestamp)) AS last_seen
FROM (SELECT * FROM hits WHERE {WEEK}) h JOIN rules r USING (rule_id) WHERE r.mitre_tactic = 'Execution' GROUP BY 1, 2, 3"""))
def a_tactic_detail(t: Tables):
    return killchain.tactic_detail(t.hits, mapping(t), "TA0002", *week())


@query("a_tactics_fired", with_hits(f"""
SELECT count(DISTINCT r.mitre_tactic) AS tactics_fired, CAST(12 AS BIGINT) AS tactics_total
FROM (SELECT * FROM hits WHERE {WEEK}) h JOIN rules r USING (rule_id)"""))
def a_tactics_fired(t: Tables):
    return killchain.tactics_fired(killchain.tactic_status(t.hits, mapping(t), *week()))


@query("src_tactic_map", with_hits(f"""
, {TACTIC_CTE} SELECT r.rule_id, t.tactic_id, t.tactic_name, count(h.id) AS hit_count
FROM rules r LEFT JOIN tactics t ON r.mitre_tactic = t.tactic_name LEFT JOIN hits h USING (rule_id) GROUP BY 1, 2, 3"""))
def src_tactic_map(t: Tables):
    counts = t.hits.groupBy("rule_id").agg(F.count("*").alias("hit_count"))
    return mapping(t).join(counts, "rule_id", "left").select(
        "rule_id", "tactic_id", "tactic_name", F.coalesce("hit_count", F.lit(0)).alias("hit_count"))


# --- scores ---------------------------------------------------------------------------------

@query("a_score_summary", with_scores("""
SELECT model_type, CAST(1 AS BIGINT) AS trained, count(*) AS total_scored, min(score) AS score_min, max(score) AS score_max,
  avg(score) AS score_mean, median(score) AS score_median FROM scores GROUP BY 1"""))
def a_score_summary(t: Tables):
    return metrics.score_summary(t.scores)


@query("a_score_bins", with_scores("""
SELECT CAST(b.i AS BIGINT) AS bin, count(s.score) AS n,
  (100.0 * count(s.score) / (SELECT count(*) FROM scores WHERE model_type = 'isolation_forest')) AS pct
FROM range(0, 10) b(i) LEFT JOIN (SELECT * FROM scores WHERE model_type = 'isolation_forest') s
  ON s.score >= b.i / 10.0 AND (s.score < (b.i + 1) / 10.0 OR b.i = 9) GROUP BY b.i"""))
def a_score_bins(t: Tables):
    return metrics.score_bins(t.scores, "isolation_forest")


@query("a_score_trend", with_scores("""
SELECT epoch_us(date_trunc('hour', timestamp)) AS hour, avg(score) AS avg_score, count(*) AS n FROM scores
WHERE model_type = 'isolation_forest' AND timestamp >= TIMESTAMP '2024-01-29 00:00:00' GROUP BY 1"""))
def a_score_trend(t: Tables):
    return metrics.score_trend(t.scores, NOW, hours=48)


@query("a_ml_status", with_scores("SELECT model_type, CAST(1 AS BIGINT) AS trained, count(*) AS scored_events FROM scores GROUP BY 1"))
def a_ml_status(t: Tables):
    return metrics.model_status(t.scores)


def _groups_sql(key: str) -> str:
    return with_hits(f"""
, scored AS (SELECT t.event_type_id, least(t.raw_value / 500.0, 1.0) AS score,
    CASE WHEN h.event_fk IS NULL THEN 0 ELSE 1 END AS label
  FROM tel t LEFT JOIN (SELECT DISTINCT event_fk FROM hits) h ON t.id = h.event_fk)
SELECT CAST({key} AS BIGINT) AS {key}, count(*) AS n, min(score) AS score_min, max(score) AS score_max, avg(score) AS score_mean,
  avg(CASE WHEN score > 0.5 THEN 1.0 ELSE 0.0 END) AS share_above_05, avg(CASE WHEN score > 0.3 THEN 1.0 ELSE 0.0 END) AS share_above_03
FROM scored GROUP BY 1""")


@query("a_score_by_label", _groups_sql("label"))
def a_score_by_label(t: Tables):
    """Label 1: the event has a hit. Hits shrink to one row per event before the join."""
    hit = t.hits.groupBy("event_fk").agg(F.lit(1).alias("_hit"))
    scored = t.scores.join(hit, "event_fk", "left").withColumn("label", F.coalesce("_hit", F.lit(0)))
    return metrics.score_groups(scored, "label")


@query("a_score_by_eid", _groups_sql("event_type_id"))
def a_score_by_eid(t: Tables):
    kinds = t.telemetry.select(F.col("id").alias("event_fk"), "event_type_id")
    return metrics.score_groups(t.scores.join(kinds, "event_fk"), "event_type_id")


@query("a_sample_by_eid", with_tel("""
SELECT event_type_id, id FROM (
  SELECT event_type_id, id, row_number() OVER (PARTITION BY event_type_id ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) AS n FROM tel) x
WHERE n <= 200"""))
def a_sample_by_eid(t: Tables):
    return metrics.sample_per_type(t.telemetry.select("event_type_id", "id"))


@query("a_activation", with_tel(f", vectors AS (SELECT {VECTOR_SQL} FROM tel)\n" + " UNION ALL ".join(
    f"SELECT '{name}' AS feature, avg(CAST({name} AS DOUBLE)) AS share FROM vectors" for name in BINARY_FEATURES)))
def a_activation(t: Tables):
    return metrics.activation(event_vectors(t.telemetry), BINARY_FEATURES)


# --- process tree ---------------------------------------------------------------------------

def _tree_sql(body: str, cap: int | None) -> str:
    limit = f"ORDER BY event_time DESC, id DESC LIMIT {cap}" if cap else ""
    return with_tel(f"""
, made AS (SELECT * FROM tel WHERE event_type_id = 1 {limit}),
nodes AS MATERIALIZED (SELECT process_id AS pid, parent_process_id AS parent_pid, image, command_line, event_time FROM (
  SELECT *, row_number() OVER (PARTITION BY process_id ORDER BY event_time, id) AS n FROM made WHERE process_id IS NOT NULL) x WHERE n = 1)
{body}""")


@query("t_nodes", _tree_sql("SELECT pid, parent_pid, image, command_line, epoch_us(event_time) AS timestamp FROM nodes", None))
def t_nodes(t: Tables):
    return tree.nodes(t.telemetry, *time_range(NOW, "30d"))


@query("t_edges", _tree_sql("SELECT p.pid AS parent_pid, c.pid FROM nodes c JOIN nodes p ON c.parent_pid = p.pid", None))
def t_edges(t: Tables):
    return tree.edges(tree.nodes(t.telemetry, *time_range(NOW, "30d")))


@query("t_roots", _tree_sql("SELECT pid, image FROM nodes WHERE parent_pid NOT IN (SELECT pid FROM nodes)", None))
def t_roots(t: Tables):
    return tree.roots(tree.nodes(t.telemetry, *time_range(NOW, "30d"))).select("pid", "image")


PATHS = """SELECT pid, root_pid, depth FROM (
WITH RECURSIVE walk AS (
  SELECT pid, pid AS root_pid, CAST(0 AS BIGINT) AS depth FROM nodes WHERE parent_pid NOT IN (SELECT pid FROM nodes)
  UNION ALL SELECT n.pid, w.root_pid, w.depth + 1 FROM nodes n JOIN walk w ON n.parent_pid = w.pid AND n.pid <> n.parent_pid)
SELECT * FROM walk) p"""


@query("t_paths", _tree_sql(PATHS, None))
def t_paths(t: Tables):
    """Depth and root of every process of the whole table."""
    return tree.paths(tree.nodes(t.telemetry, None, None))[0]


@query("t_cycles", _tree_sql(f"SELECT pid FROM nodes WHERE pid NOT IN (SELECT pid FROM ({PATHS}) q)", None))
def t_cycles(t: Tables):
    """Processes in or below a parent cycle; a process that is its own parent makes one."""
    return tree.paths(tree.nodes(t.telemetry, None, None))[1]


# --- process identity -----------------------------------------------------------------------

def _process_sql(body: str, guid: str = "CAST(NULL AS VARCHAR)") -> str:
    """Processes by host, pid and start, each with its latest parent; written by correlated lookups."""
    return with_tel(f"""
, made AS (SELECT id, computer, process_id AS pid, {guid} AS guid, event_time AS started, image, command_line, parent_process_id AS parent_pid
  FROM tel WHERE event_type_id = 1 AND process_id IS NOT NULL),
procs AS MATERIALIZED (SELECT id AS process, computer, pid, guid, started, image, command_line, parent_pid FROM (
  SELECT *, row_number() OVER (PARTITION BY computer, coalesce(guid, 'id ' || CAST(id AS VARCHAR)) ORDER BY started, id) AS n FROM made) x WHERE n = 1),
nodes AS MATERIALIZED (SELECT c.*,
  (SELECT min(n.started) FROM procs n WHERE n.computer = c.computer AND n.pid = c.pid AND n.started > c.started) AS ended,
  (SELECT max_by(p.process, (p.started, p.process)) FROM procs p WHERE p.computer = c.computer AND p.pid = c.parent_pid AND p.started < c.started) AS parent_process
  FROM procs c)
{body}""")


PROCESS_COLUMNS = "process, computer, pid, epoch_us(started) AS started, epoch_us(ended) AS ended, image, parent_process"
BY_GUID = "nullif(trim(process_guid), '')"


@query("t_processes", _process_sql(f"SELECT {PROCESS_COLUMNS} FROM nodes"))
def t_processes(t: Tables):
    """Every creation is a process; a reused pid gives another node."""
    return identity.process_nodes(identity.processes(t.telemetry, by_guid=False)).select(
        "process", "computer", "pid", "started", "ended", "image", "parent_process")


@query("t_processes_guid", _process_sql(f"SELECT {PROCESS_COLUMNS}, guid FROM nodes", BY_GUID))
def t_processes_guid(t: Tables):
    """Creations of one guid on one host are one process."""
    return identity.process_nodes(identity.processes(t.telemetry)).select(
        "process", "computer", "pid", "started", "ended", "image", "parent_process", "guid")


@query("t_process_paths", _process_sql("""SELECT process, root_process, depth FROM (
WITH RECURSIVE walk AS (
  SELECT process, process AS root_process, CAST(0 AS BIGINT) AS depth FROM nodes WHERE parent_process IS NULL
  UNION ALL SELECT n.process, w.root_process, w.depth + 1 FROM nodes n JOIN walk w ON n.parent_process = w.process)
SELECT * FROM walk) p"""))
def t_process_paths(t: Tables):
    """Root and depth of every process, reused pids told apart."""
    return identity.process_paths(identity.process_nodes(identity.processes(t.telemetry, by_guid=False)))


def _owned_sql(guid: str, named: str) -> str:
    return _process_sql(f""", owned AS (SELECT e.id, coalesce({named},
    (SELECT max_by(p.process, (p.started, p.process)) FROM procs p WHERE p.computer = t.computer AND p.pid = e.pid AND p.started <= t.event_time)) AS process
  FROM events_t e JOIN tel t USING (id))
SELECT id, process FROM owned""", guid)


@query("j_process", _owned_sql("CAST(NULL AS VARCHAR)", "NULL"))
def j_process(t: Tables):
    """The process of every event, by host, pid and time."""
    return identity.with_process(t.telemetry, identity.processes(t.telemetry, by_guid=False), by_guid=False).select("id", "process")


@query("j_process_guid", _owned_sql(BY_GUID, "(SELECT g.process FROM procs g WHERE g.computer = t.computer AND g.guid = nullif(trim(t.process_guid), ''))"))
def j_process_guid(t: Tables):
    """The process of every event, by guid where it has one."""
    return identity.with_process(t.telemetry, identity.processes(t.telemetry)).select("id", "process")
