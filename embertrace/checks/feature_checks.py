"""Scalar functions, features of events and windows, CSV files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from embertrace.checks.oracle import low, last_part, with_hits, with_tel
from embertrace.checks.registry import NOW, Tables, query
from embertrace.functions import clock, lines, net, text
from embertrace.functions.clock import bounds, lit_time
from embertrace.operators.identity import process_windows
from embertrace.operators.features import (
    FEATURE_TYPES, FEATURES, FIRST, FOREST_FEATURES, LOLBINS, event_vectors, labelled_windows, rule_features, window_features,
    window_features_live)
from embertrace.session import shared_dir
from embertrace.sources.stored import read_features_csv, write_features_csv

# --- the same features in the other engine ----------------------------------------------------

COMMAND, PARENT_COMMAND = "coalesce(command_line, '')", "coalesce(parent_command_line, '')"
LOW_COMMAND = f"lower({COMMAND})"
HOUR = "CAST(hour(event_time) AS BIGINT)"


def _has(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({LOW_COMMAND}, '{w}')" for w in words) + ")"


def _names(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


IMAGE, PARENT = last_part("image"), last_part("parent_image")
ENTROPY = (
    f"CASE WHEN {COMMAND} = '' THEN 0.0 ELSE list_sum(list_transform(list_distinct(string_split({COMMAND}, '')), lambda c: "
    f"-(length({COMMAND}) - length(replace({COMMAND}, c, ''))) / CAST(length({COMMAND}) AS DOUBLE) * "
    f"log2((length({COMMAND}) - length(replace({COMMAND}, c, ''))) / CAST(length({COMMAND}) AS DOUBLE)))) END")
EXTERNAL = ["8.8.8.8", "100.64.0.1", "224.0.0.1", "172.32.0.1", "2606:4700::1111", "192.0.0.9"]
WIDE_MASKS = ["0x1410", "0x1fffff", "0x0028", "0x1f0fff", "32"]
PAIRS = {
    "winword.exe": ["powershell.exe", "cmd.exe", "wscript.exe", "cscript.exe", "mshta.exe"],
    "wscript.exe": ["powershell.exe", "cmd.exe"],
}
CHAIN = " OR ".join(f"({PARENT} = '{p}' AND {IMAGE} IN {_names(c)})" for p, c in PAIRS.items())
SQL_FEATURES = {
    "cmd_length": f"length({COMMAND})",
    "cmd_entropy": ENTROPY,
    "has_encoded_command": _has(["-encodedcommand", " -enc ", "–enc"]),
    "has_download_keyword": _has(["downloadstring", "downloadfile", "webclient", "invoke-webrequest", "wget", "curl", "bitstransfer"]),
    "is_signed": "0",
    "hour_of_day": HOUR,
    "is_off_hours": f"{HOUR} NOT BETWEEN 8 AND 18",
    "is_lolbin": f"{IMAGE} IN {_names(LOLBINS)}",
    "is_suspicious_parent": f"{PARENT} IN ('winword.exe', 'explorer.exe', 'wscript.exe')",
    "parent_cmd_length": f"length({PARENT_COMMAND})",
    "is_known_suspicious_chain": CHAIN,
    "parent_is_same_image": f"{PARENT} = {IMAGE}",
    "dns_query_length": "length(coalesce(query_name, ''))",
    "dest_port": "coalesce(destination_port, 0)",
    "is_suspicious_port": "destination_port IN (4444, 8443, 31337)",
    "is_external_ip": f"destination_ip IN {_names(EXTERNAL)}",
    "network_event_count": "1",
    "image_load_count": "1",
    "unsigned_image_loaded": "NOT signed",
    "create_remote_thread_count": "1",
    "open_process_count": "1",
    "open_process_lsass_target": f"{last_part('target_image')} = 'lsass.exe'",
    "open_process_suspicious_access": f"{low('granted_access')} IN {_names(WIDE_MASKS)}",
}


def _default(feature: str) -> str:
    return "-1" if feature == "hour_of_day" else "0"


def _sql_feature(feature: str) -> str:
    if feature not in SQL_FEATURES:
        return "CAST(0 AS BIGINT)"
    value, types = SQL_FEATURES[feature], ", ".join(map(str, FEATURE_TYPES[feature]))
    if feature == "cmd_entropy":
        return f"CASE WHEN event_type_id = 1 THEN {value} ELSE 0.0 END"
    return f"CASE WHEN event_type_id IN ({types}) THEN CAST(coalesce({value}, false) AS BIGINT) ELSE {_default(feature)} END" if (
        any(k in value for k in (" IN ", " = ", "NOT ", "contains"))
    ) else f"CASE WHEN event_type_id IN ({types}) THEN CAST({value} AS BIGINT) ELSE {_default(feature)} END"


def _feature_query(feature: str) -> None:
    @query(feature, with_tel(f"SELECT id, {_sql_feature(feature)} AS {feature} FROM tel"))
    def run(t: Tables):
        return event_vectors(t.telemetry, [feature]).select("id", feature)


for _f in FEATURES:
    if FEATURE_TYPES[_f]:
        _feature_query(_f)

VECTOR_SQL = ", ".join(f"{_sql_feature(f)} AS {f}" for f in FEATURES)


@query("w_event_vector", with_tel(f"SELECT id, {VECTOR_SQL} FROM tel"))
def w_event_vector(t: Tables):
    return event_vectors(t.telemetry).select("id", *FEATURES)


# --- windows --------------------------------------------------------------------------------

FAMILY = {"powershell": "PS_", "lolbin": "LOLBIN_", "network": "NET_", "api": "API_", "chain": "CHAIN_"}


VECTOR_PARTS = ", ".join(f"{_sql_feature(f)} AS {f}" for f in FEATURES if f in SQL_FEATURES)


def _merged_sql() -> list[str]:
    """Each feature that events give, merged over the events of a window."""
    source = {f: t for t, fields in FIRST.items() for f in fields}
    merged = []
    for f in FEATURES:
        if f in source:
            value = f"coalesce(first({f} ORDER BY event_time, id) FILTER (WHERE event_type_id = {source[f]}), {_default(f)})"
            merged.append(f"{value} AS {f}")
        elif f.endswith("_count") and f in SQL_FEATURES:
            merged.append(f"CAST(sum({f}) AS BIGINT) AS {f}")
        elif f in SQL_FEATURES:
            merged.append(f"max({f}) AS {f}")
    return merged


def windowed_sql() -> str:
    return with_tel(f"""
, keyed AS (SELECT t.*, e.image AS flat, e.pid FROM tel t JOIN events_t e USING (id)),
vectors AS (SELECT id, event_type_id, event_time, flat, pid, {VECTOR_PARTS} FROM keyed)
SELECT epoch_us(time_bucket(INTERVAL '10 minutes', event_time)) AS window_start, flat AS image, pid, {', '.join(_merged_sql())}
FROM vectors GROUP BY 1, 2, 3""")


def _window_sql(where: str, columns: list[str], extra: str = "") -> str:
    merged, vec = _merged_sql(), VECTOR_PARTS
    family = ", ".join(f"max(CAST(starts_with(rule_id, '{p}') AS BIGINT)) AS has_{n}_rule_hit" for n, p in FAMILY.items())
    picked = ", ".join(
        f"coalesce(h.{c}, 0) AS {c}" if c not in SQL_FEATURES else f"w.{c}" for c in columns)
    return with_hits(f"""
, inside AS (SELECT t.*, e.pid, e.image AS flat FROM tel t JOIN events_t e USING (id) WHERE {where}),
vectors AS (SELECT id, event_type_id, event_time, flat, pid, {vec} FROM inside),
windows AS (SELECT flat AS image, pid, {', '.join(merged)} FROM vectors GROUP BY flat, pid),
fired AS (SELECT i.flat AS image, i.pid, count(*) AS rule_hit_count, count(DISTINCT rule_id) AS unique_rules_fired, {family}
  FROM hits h JOIN inside i ON h.event_fk = i.id GROUP BY 1, 2)
SELECT w.image, w.pid, {picked}{extra} FROM windows w LEFT JOIN fired h
  ON w.image IS NOT DISTINCT FROM h.image AND w.pid IS NOT DISTINCT FROM h.pid""")


SINCE, UNTIL = "2024-01-05 00:00:00", "2024-01-25 23:59:59"
BOUNDED = f"event_time >= TIMESTAMP '{SINCE}' AND event_time <= TIMESTAMP '{UNTIL}.999999'"
FIRST_FEATURES = [f for fields in FIRST.values() for f in fields]
RULE_FEATURES = [f for f in FEATURES if not FEATURE_TYPES[f]]


@query("w_window", _window_sql("true", FEATURES))
def w_window(t: Tables):
    return window_features(t.telemetry, t.hits)


@query("w_window_live", _window_sql("true", FEATURES))
def w_window_live(t: Tables):
    """The same vectors from events and rules alone, by bitmask."""
    return window_features_live(t.telemetry)


def _process_windows_sql() -> str:
    merged, vec = _merged_sql(), VECTOR_PARTS
    family = ", ".join(f"max(CAST(starts_with(rule_id, '{p}') AS BIGINT)) AS has_{n}_rule_hit" for n, p in FAMILY.items())
    picked = ", ".join(f"coalesce(h.{c}, 0) AS {c}" if c not in SQL_FEATURES else f"w.{c}" for c in FEATURES)
    return with_hits(f"""
, owned AS (SELECT t.*, e.pid, e.image AS flat, (
    SELECT max_by(p.id, (p.event_time, p.id)) FROM tel p WHERE p.event_type_id = 1 AND p.computer = t.computer AND p.process_id = e.pid AND p.event_time <= t.event_time) AS process
  FROM tel t JOIN events_t e USING (id)),
inside AS (SELECT *, CASE WHEN process IS NULL THEN pid END AS stray_pid FROM owned),
vectors AS (SELECT id, event_type_id, event_time, computer, process, stray_pid, {vec} FROM inside),
windows AS (SELECT computer, process, stray_pid, {', '.join(merged)} FROM vectors GROUP BY 1, 2, 3),
fired AS (SELECT i.computer, i.process, i.stray_pid, count(*) AS rule_hit_count, count(DISTINCT rule_id) AS unique_rules_fired, {family}
  FROM hits h JOIN inside i ON h.event_fk = i.id GROUP BY 1, 2, 3)
SELECT w.computer, w.process, w.stray_pid, {picked} FROM windows w LEFT JOIN fired h
  ON w.computer = h.computer AND w.process IS NOT DISTINCT FROM h.process AND w.stray_pid IS NOT DISTINCT FROM h.stray_pid""")


@query("w_process", _process_windows_sql())
def w_process(t: Tables):
    """Windows of processes on their hosts, reused pids told apart."""
    return process_windows(t.telemetry, by_guid=False)


@query("w_first", _window_sql(BOUNDED, FIRST_FEATURES))
def w_first(t: Tables):
    return window_features(t.telemetry, t.hits, *bounds(SINCE, UNTIL)).select("image", "pid", *FIRST_FEATURES)


@query("w_rulefeatures", _window_sql(BOUNDED, RULE_FEATURES))
def w_rulefeatures(t: Tables):
    return window_features(t.telemetry, t.hits, *bounds(SINCE, UNTIL)).select("image", "pid", *RULE_FEATURES)


@query("w_rule_hits", with_hits(f"""
SELECT e.image, e.pid, count(*) AS rule_hit_count, count(DISTINCT rule_id) AS unique_rules_fired,
  {', '.join(f"max(CAST(starts_with(rule_id, '{p}') AS BIGINT)) AS has_{n}_rule_hit" for n, p in FAMILY.items())}
FROM hits h JOIN events_t e ON h.event_fk = e.id WHERE {BOUNDED.replace("event_time", "h.timestamp")} GROUP BY 1, 2"""))
def w_rule_hits(t: Tables):
    """Features of rule hits from hits that carry their window."""
    return rule_features(t.window_hits, *bounds(SINCE, UNTIL))


# Two spans of label 0 with a gap, and one of label 1 that overlaps the second.
LABELLED = [(None, "2024-01-09 23:59:59", 0), ("2024-01-12 00:00:00", "2024-01-20 12:00:00", 0), ("2024-01-19 00:00:00", None, 1)]


def _span_sql(n: int, since: str | None, until: str | None, label: int) -> str:
    parts = [] if since is None else [f"event_time >= TIMESTAMP '{since}'"]
    parts += [] if until is None else [f"event_time <= TIMESTAMP '{until}.999999'"]
    return f"(SELECT * FROM ({_window_sql(' AND '.join(parts), FEATURES, f', CAST({n} AS BIGINT) AS span, CAST({label} AS BIGINT) AS label')}))"


@query("w_labelled", " UNION ALL ".join(_span_sql(n, *span) for n, span in enumerate(LABELLED)))
def w_labelled(t: Tables):
    """Windows of several labelled spans in one pass over the events."""
    return labelled_windows(t.telemetry, [(*bounds(since, until), label) for since, until, label in LABELLED])


@query("w_label", _window_sql(BOUNDED, ["network_event_count"], ", CAST(1 AS BIGINT) AS label"))
def w_label(t: Tables):
    return window_features(t.telemetry, t.hits, *bounds(SINCE, UNTIL), label=1).select("image", "pid", "network_event_count", "label")


@query("w_rf_subset", _window_sql("true", FOREST_FEATURES))
def w_rf_subset(t: Tables):
    return window_features_live(t.telemetry).select("image", "pid", *FOREST_FEATURES)


for _f in RULE_FEATURES:
    def _register(feature: str) -> None:
        @query(feature, _window_sql("true", [feature]))
        def run(t: Tables):
            return window_features_live(t.telemetry).select("image", "pid", feature)

    _register(_f)


def _csv_round_trip(t: Tables):
    path = f"{shared_dir(t.spark)}/features-{uuid.uuid4().hex}"
    write_features_csv(window_features_live(t.telemetry, label=0), path)
    return path


@query("sink_features_csv", _window_sql("true", FEATURES, ", CAST(0 AS BIGINT) AS label").replace("SELECT w.image, w.pid, ", "SELECT "))
def sink_features_csv(t: Tables):
    return read_features_csv(t.spark, _csv_round_trip(t))


@query("src_features_csv", _window_sql("true", ["cmd_length", "rule_hit_count"]).replace("SELECT w.image, w.pid, ", "SELECT "))
def src_features_csv(t: Tables):
    return read_features_csv(t.spark, _csv_round_trip(t), ["cmd_length", "rule_hit_count"]).drop("label")


# --- scalar functions -----------------------------------------------------------------------

FLAT = "coalesce(image, source_image)"


@query("fn_basename", with_tel(f"SELECT id, {last_part(FLAT)} AS name FROM tel"))
def fn_basename(t: Tables):
    return t.telemetry.select("id", text.basename(F.coalesce("image", "source_image")).alias("name"))


@query("fn_win_name", with_tel(
    f"SELECT id, list_extract(string_split(replace({FLAT}, chr(92), '/'), '/'), -1) AS name FROM tel"))
def fn_win_name(t: Tables):
    """A trailing slash does not count."""
    path = F.coalesce("image", "source_image")
    ended = F.when(F.col("id") % 2 == 0, F.concat(path, F.lit("\\"))).otherwise(path)
    return t.telemetry.select("id", text.win_name(ended).alias("name"))


@query("fn_entropy", "SELECT doc_id, (" + ENTROPY.replace(COMMAND, "text") + ") AS entropy FROM documents")
def fn_entropy(t: Tables):
    """Of whole documents."""
    return t.given("documents").select("doc_id", text.entropy(F.col("text")).alias("entropy"))


@query("fn_hour", with_tel(f"SELECT id, CASE WHEN id % 7 = 0 THEN -1 ELSE {HOUR} END AS hour FROM tel"))
def fn_hour(t: Tables):
    stamp = F.when(F.col("id") % 7 == 0, F.lit("soon")).otherwise(clock.time_text(F.col("event_time")))
    return t.telemetry.select("id", clock.hour_or_unknown(clock.event_time(stamp)).alias("hour"))


@query("fn_hex_mask", with_tel("""
SELECT id, CAST(CASE lower(granted_access) WHEN '0x1410' THEN 5136 WHEN '0x40' THEN 64 WHEN '0x1fffff' THEN 2097151 WHEN '0x1000' THEN 4096
    WHEN '0x0028' THEN 40 WHEN '0x1f0fff' THEN 2035711 WHEN '32' THEN 32 WHEN '0x1440' THEN 5184 END AS BIGINT) AS mask,
  CAST(CASE lower(granted_access) WHEN '0x1410' THEN 5136 WHEN '0x40' THEN 64 WHEN '0x1fffff' THEN 2097151 WHEN '0x1000' THEN 4096
    WHEN '0x0028' THEN 40 WHEN '0x1f0fff' THEN 2035711 WHEN '32' THEN 50 WHEN '0x1440' THEN 5184 WHEN 'bad' THEN 2989 END AS BIGINT) AS hex
FROM tel WHERE event_type_id = 10"""))
def fn_hex_mask(t: Tables):
    masks = t.telemetry.filter(F.col("event_type_id") == 10)
    access = F.col("granted_access")
    return masks.select("id", text.mask_value(access).alias("mask"), text.hex_value(access).alias("hex"))


@query("fn_ip_external", with_tel(
    f"SELECT id, CAST(coalesce(destination_ip IN {_names(EXTERNAL)}, false) AS BIGINT) AS external FROM tel WHERE event_type_id = 3"))
def fn_ip_external(t: Tables):
    conns = t.telemetry.filter(F.col("event_type_id") == 3)
    return conns.select("id", net.is_external(F.col("destination_ip")).alias("external"))


@query("fn_int", with_tel("SELECT id, CASE WHEN id % 4 <> 1 THEN id END AS number FROM tel"))
def fn_int(t: Tables):
    i = F.col("id")
    digits = F.when(i % 4 == 1, F.concat(i.cast("string"), F.lit(".5"))).otherwise(F.concat(F.lit(" "), i.cast("string")))
    return t.telemetry.select("id", text.to_int(digits).alias("number"))


@query("fn_bool", with_tel("SELECT id, CAST(CASE id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS BIGINT) AS flag FROM tel"))
def fn_bool(t: Tables):
    word = F.get(F.array(F.lit("TRUE"), F.lit("False"), F.lit("yes")), (F.col("id") % 3).cast("int"))
    return t.telemetry.select("id", text.to_bool(word).alias("flag"))


@query("fn_event_time", with_tel("""
SELECT id, CASE WHEN id % 5 = 0 THEN epoch_us(TIMESTAMP '2024-01-31') ELSE epoch_us(event_time) END AS at FROM tel"""))
def fn_event_time(t: Tables):
    stamp = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'7Z'")
    raw = F.when(F.col("id") % 10 == 0, F.lit("")).when(F.col("id") % 5 == 0, F.lit("not a time")).otherwise(stamp)
    return t.telemetry.select("id", clock.event_time(raw, lit_time(NOW)).alias("at"))


def _shown(path: str) -> str:
    return f"list_extract(string_split(replace({path}, chr(92), '/'), '/'), -1)"


@query("fn_key_detail", with_tel(f"""
SELECT id, coalesce(CASE event_type_id
  WHEN 1 THEN CASE WHEN length(nullif(command_line, '')) > 80 THEN substr(command_line, 1, 79) || '…' ELSE nullif(command_line, '') END
  WHEN 3 THEN destination_ip || ':' || CAST(destination_port AS VARCHAR)
  WHEN 7 THEN {_shown('image_loaded')}
  WHEN 8 THEN {_shown('source_image')} || ' → ' || {_shown('target_image')}
  WHEN 10 THEN {_shown('source_image')} || ' → ' || {_shown('target_image')} ||
    CASE WHEN coalesce(granted_access, '') <> '' THEN ' [' || granted_access || ']' ELSE '' END
  WHEN 22 THEN nullif(query_name, '') END, '—') AS detail FROM tel"""))
def fn_key_detail(t: Tables):
    return t.telemetry.select("id", lines.key_detail().alias("detail"))


def _quoted(value: str) -> str:
    doubled = f"replace({value}, chr(92), chr(92) || chr(92))"
    return (
        f"CASE WHEN contains({value}, chr(39)) THEN '\"' || {doubled} || '\"' ELSE chr(39) || {doubled} || chr(39) END")


@query("fn_hit_line", with_hits(f"""
SELECT h.id, concat_ws(' | ', '[2024-01-31 00:00:00] RULE_HIT', 'rule=' || {_quoted('rule_name')}, 'id=' || rule_id,
  'technique=' || mitre_technique, 'tactic=' || mitre_tactic, 'severity=' || severity,
  'image=' || {_quoted("coalesce(t.image, t.source_image, 'N/A')")}, 'cmdline=' || {_quoted('t.command_line')},
  'parent=' || {_quoted('t.parent_image')}, 'target=' || {_quoted('t.target_image')}, 'access=' || t.granted_access,
  CASE WHEN coalesce(t.destination_hostname, t.destination_ip) IS NOT NULL THEN 'dest=' ||
    {_quoted("(coalesce(t.destination_hostname, t.destination_ip) || coalesce(':' || CAST(t.destination_port AS VARCHAR), ''))")} END) AS line
FROM hits h JOIN tel t ON h.event_fk = t.id"""))
def fn_hit_line(t: Tables):
    joined = t.hits.select("id", "event_fk", "rule_id", "rule_name", "severity", "mitre_technique", "mitre_tactic").join(
        t.telemetry.withColumnRenamed("id", "event_fk"), "event_fk")
    return joined.select("id", lines.hit_line(lit_time(NOW)).alias("line"))


@query("fn_rel_time", with_tel("""
, ages AS (SELECT id, (epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(event_time)) AS us FROM tel)
SELECT id, CASE WHEN us < 60000000 THEN 'just now' WHEN us < 3600000000 THEN CAST(us // 60000000 AS VARCHAR) || 'm ago'
  WHEN us < 86400000000 THEN CAST(us // 3600000000 AS VARCHAR) || 'h ago' ELSE CAST(us // 86400000000 AS VARCHAR) || 'd ago' END AS age
FROM ages"""))
def fn_rel_time(t: Tables):
    return t.telemetry.select("id", clock.relative_time(F.col("event_time"), lit_time(NOW.replace(day=30, hour=12))).alias("age"))


@query("fn_json", with_tel("""
SELECT id, event_type_id AS event_id, coalesce(process_id, source_process_id) AS pid, command_line, granted_access,
  CAST(initiated AS BIGINT) AS initiated, destination_port FROM tel"""))
def fn_json(t: Tables):
    """Records to JSON text and back."""
    out = t.telemetry.select("id", lines.payload_json().alias("raw")).select("id", lines.payload_fields(F.col("raw")).alias("p"))
    return out.select(
        "id", "p.event_id", F.coalesce("p.process_id", "p.source_process_id").alias("pid"), "p.command_line",
        "p.granted_access", "p.initiated", "p.destination_port")
