"""SQL building blocks for the other engine: the derived tables as CTEs, written independently of
the Spark operators (only the rule catalogue's data is shared)."""

from __future__ import annotations

from embertrace.plans.telemetry import sql_text, telemetry_sql
from embertrace.rules import Condition, Rule, catalogue
from embertrace.schema import BLANK_FIELDS, EVENT_FIELDS


def low(field: str) -> str:
    return f"lower(CAST({field} AS VARCHAR))"


def last_part(path: str) -> str:
    return f"lower(list_extract(string_split(replace({path}, chr(92), '/'), '/'), -1))"


def hex_number(text: str) -> str:
    digits = f"regexp_replace(trim({text}), '^0x', '')"
    return f"(CASE WHEN regexp_full_match(trim({text}), '(0x)?[0-9a-f]+') THEN CAST('0x' || {digits} AS BIGINT) END)"


def any_of(items: list[str]) -> str:
    return "(" + " OR ".join(items) + ")"


def condition_sql(c: Condition, null_ok: bool | None = None) -> str:
    t = low(c.field)
    v = sql_text((c.value or "").lower())
    vs = [sql_text(x.lower()) for x in c.values]
    ends = any_of([f"suffix({t}, {x})" for x in vs]) if vs else ""
    has = any_of([f"contains({t}, {x})" for x in vs]) if vs else ""
    tests = {
        "equals": f"{t} = {v}",
        "not_equals": f"{t} <> {v}",
        "contains": f"contains({t}, {v})",
        "not_contains": f"NOT contains({t}, {v})",
        "contains_any": has,
        "not_contains_any": f"({t} = '' OR NOT {has})",
        "starts_with": f"starts_with({t}, {v})",
        "ends_with": f"suffix({t}, {v})",
        "not_ends_with": f"NOT suffix({t}, {v})",
        "ends_with_any": ends,
        "not_ends_with_any": f"NOT {ends}",
        "regex": f"regexp_matches({t}, {sql_text(c.value)}, 'i')",
    }
    if c.operator == "bits_any_set":
        masks = [m for m in c.values if all(ch in "0123456789abcdefABCDEFx" for ch in m)]
        test = "coalesce(" + any_of([f"({hex_number(t)} & {int(m, 16)}) = {int(m, 16)}" for m in masks]) + ", false)"
    elif c.operator in ("same_basename", "not_same_basename"):
        sign = "=" if c.operator == "same_basename" else "<>"
        test = f"({c.reference_field} IS NOT NULL AND {last_part(c.field)} {sign} {last_part(c.reference_field)})"
    else:
        test = tests[c.operator]
    allow = c.allow_null if null_ok is None else null_ok
    return f"CASE WHEN {c.field} IS NULL THEN {str(allow).lower()} ELSE {test} END"


def rule_sql(rule: Rule) -> str:
    joined = f" {rule.logic} ".join(f"({condition_sql(c)})" for c in rule.conditions)
    return f"event_type_id IN ({', '.join(map(str, rule.event_ids))}) AND ({joined})"


def hits_select() -> str:
    parts = []
    for r in catalogue():
        consts = ", ".join(
            f"{sql_text(v)} AS {n}" for n, v in (
                ("rule_id", r.id), ("rule_name", r.name), ("severity", r.severity),
                ("mitre_technique", r.mitre_technique), ("mitre_tactic", r.mitre_tactic)))
        parts.append(
            f"SELECT CAST(id AS VARCHAR) || ':{r.id}' AS id, id AS event_fk, {consts}, event_time AS timestamp "
            f"FROM tel WHERE {rule_sql(r)}")
    return "\nUNION ALL ".join(parts)


RULES_CTE = "rules AS (SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join(sql_text(v) for v in (r.id, r.name, r.severity, r.mitre_tactic, r.mitre_technique)) + ")"
    for r in catalogue()) + ") v(rule_id, rule_name, severity, mitre_tactic, mitre_technique))"

TEL_CTE = f"tel AS MATERIALIZED ({telemetry_sql()})"
EVENTS_CTE = """events_t AS (
  SELECT id, event_type_id, event_time AS timestamp,
    CASE WHEN event_type_id IN (8, 10) THEN source_process_id ELSE process_id END AS pid,
    CASE WHEN event_type_id IN (8, 10) THEN source_image ELSE image END AS image
  FROM tel)"""
HITS_CTE = f"hits AS MATERIALIZED ({hits_select()})"
ALERTS_CTE = """alerts AS MATERIALIZED (
  SELECT h.id, h.id AS rule_hit_fk, h.event_fk, rule_id, rule_name, severity, mitre_technique, mitre_tactic,
    coalesce(nullif(t.image, ''), nullif(t.source_image, '')) AS process_image,
    coalesce(nullif(t.process_id, 0), nullif(t.source_process_id, 0)) AS process_pid,
    t.command_line, t.parent_image, 'open' AS status, h.timestamp
  FROM hits h LEFT JOIN tel t ON h.event_fk = t.id)"""
SCORES_CTE = """scores AS MATERIALIZED (
  SELECT id AS event_fk, CASE WHEN id % 2 = 0 THEN 'isolation_forest' ELSE 'random_forest' END AS model_type,
    least(raw_value / 500.0, 1.0) AS score, event_time AS timestamp
  FROM tel)"""


# Telemetry as it reads after a way through XML: absent texts of these fields are '' there.
_BLANKED = ", ".join(
    f"CASE WHEN event_type_id IN ({', '.join(str(e) for e, fields in EVENT_FIELDS.items() if f in fields)}) THEN coalesce({f}, '') ELSE {f} END AS {f}"
    for f in sorted(BLANK_FIELDS) if any(f in fields for fields in EVENT_FIELDS.values()))
XML_CTE = f"tel AS MATERIALIZED (SELECT * REPLACE ({_BLANKED}) FROM ({telemetry_sql()}))"


def with_xml(body: str) -> str:
    return f"WITH {XML_CTE}, {EVENTS_CTE}, {HITS_CTE}, {RULES_CTE}\n{body}"


# A body may begin with a comma to add CTEs of its own.
def with_tel(body: str) -> str:
    return f"WITH {TEL_CTE}, {EVENTS_CTE}\n{body}"


def with_hits(body: str) -> str:
    return f"WITH {TEL_CTE}, {EVENTS_CTE}, {HITS_CTE}, {RULES_CTE}\n{body}"


def with_alerts(body: str) -> str:
    return f"WITH {TEL_CTE}, {EVENTS_CTE}, {HITS_CTE}, {ALERTS_CTE}, {SCORES_CTE}, {RULES_CTE}\n{body}"


def with_scores(body: str) -> str:
    return f"WITH {TEL_CTE}, {EVENTS_CTE}, {SCORES_CTE}\n{body}"
