"""One-line summaries of events and hits, and JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from embertrace.functions.text import DASH, truncate, win_name
from embertrace.schema import BOOL_FIELDS, EVENT_FIELDS, INT_FIELDS


def _name(path: Column) -> Column:
    return F.when(F.char_length(path) > 0, F.coalesce(win_name(path), F.lit(""))).otherwise(F.lit(DASH))


def key_detail() -> Column:
    """The most telling field of an event, by type; a dash where it is missing."""
    eid = F.col("event_type_id")
    pair = F.concat(_name(F.col("source_image")), F.lit(" → "), _name(F.col("target_image")))
    known = (_name(F.col("source_image")) != DASH) | (_name(F.col("target_image")) != DASH)
    access, query = F.col("granted_access"), F.col("query_name")
    line = (
        F.when((eid == 1) & (F.col("command_line") != ""), truncate(F.col("command_line")))
        .when(eid == 3, F.concat(F.col("destination_ip"), F.lit(":"), F.col("destination_port").cast("string")))
        .when((eid == 7) & (F.col("image_loaded") != ""), _name(F.col("image_loaded")))
        .when((eid == 10) & (access != ""), F.concat(pair, F.lit(" ["), access, F.lit("]")))
        .when(eid.isin(8, 10) & known, pair)
        .when((eid == 22) & (query != ""), query)
    )
    return F.coalesce(line, F.lit(DASH))


def quote(text: Column) -> Column:
    """Text in quotes with backslashes and line breaks escaped; double quotes only when needed."""
    t = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for char, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        t = F.replace(t, F.lit(char), F.lit(shown))
    use_double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    single = F.concat(F.lit("'"), F.replace(t, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(use_double, F.concat(F.lit('"'), t, F.lit('"'))).otherwise(single)


def hit_line(at: Column) -> Column:
    """One log line for a hit joined to its event. ``at`` is the moment of writing."""
    image = F.coalesce(
        F.nullif(F.col("image"), F.lit("")), F.nullif(F.col("source_image"), F.lit("")), F.lit("N/A"))
    host, ip, port = F.col("destination_hostname"), F.col("destination_ip"), F.col("destination_port")
    dest = F.coalesce(F.nullif(host, F.lit("")), F.nullif(ip, F.lit("")), F.lit("?"))
    dest = F.when(port.isNotNull(), F.concat(dest, F.lit(":"), port.cast("string"))).otherwise(dest)

    def part(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"{label}="), value)  # NULL drops out of concat_ws

    return F.concat_ws(
        " | ",
        F.concat(F.lit("["), F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit("] RULE_HIT")),
        part("rule", quote(F.col("rule_name"))),
        part("id", F.col("rule_id")),
        part("technique", F.coalesce(F.col("mitre_technique"), F.lit("None"))),
        part("tactic", F.coalesce(F.col("mitre_tactic"), F.lit("None"))),
        part("severity", F.col("severity")),
        part("image", quote(image)),
        part("cmdline", quote(F.col("command_line"))),
        part("parent", quote(F.col("parent_image"))),
        F.when(F.col("source_image") != image, part("source", quote(F.col("source_image")))),
        part("target", quote(F.col("target_image"))),
        part("access", F.col("granted_access")),
        F.when(host.isNotNull() | ip.isNotNull(), part("dest", quote(dest))),
    )


def payload_json() -> Column:
    """The record of an event as JSON, with exactly the fields its type has."""
    out = F.lit(None).cast("string")
    for eid, fields in EVENT_FIELDS.items():
        record = F.struct(
            F.col("event_type_id").alias("event_id"),
            F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("utc_time"),
            "computer",
            *fields,
        )
        out = F.when(F.col("event_type_id") == eid, F.to_json(record, {"ignoreNullFields": "false"})).otherwise(out)
    return out


def payload_fields(raw: Column) -> Column:
    """JSON payload back to a typed record; text that is not JSON gives NULL."""
    names = dict.fromkeys(f for fields in EVENT_FIELDS.values() for f in fields)
    kinds = ", ".join(
        f"{f} {'bigint' if f in INT_FIELDS else 'boolean' if f in BOOL_FIELDS else 'string'}" for f in names)
    return F.from_json(raw, f"event_id int, utc_time string, computer string, {kinds}")


def expand_json(raw: Column, path: str = "$", kind: str = "string") -> tuple[Column, Column]:
    """(value at ``path``, leftover text). Text that is not JSON is kept whole as the leftover.

    The parser stops after the first value, so the text is parsed inside brackets: anything after
    that value is then an error, or a second element.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))
    first, second = F.try_variant_get(listed, "$[0]", "variant"), F.try_variant_get(listed, "$[1]", "variant")
    whole = first.isNotNull() & second.isNull()
    value = F.when(whole, F.try_variant_get(listed, "$[0]" + path[1:], kind))
    return value, F.when(~whole, raw)
