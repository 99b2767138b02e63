"""Thirty features per event, and per process window (image, pid)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embertrace.functions.clock import hour_or_unknown, lit_time, off_hours
from embertrace.functions.net import is_external
from embertrace.functions.text import contains_any, entropy, mask_value, win_name
from embertrace.operators.detect import detect, rule_words, with_masks
from embertrace.operators.tables import event_image, event_pid, hits_with_events, in_range
from embertrace.rules import Rule, catalogue

# Feature order, the event types each comes from, and word lists. Features of rule
# hits have no event type. All default to 0 except hour_of_day.
FEATURE_TYPES: dict[str, tuple[int, ...]] = {
    "cmd_length": (1,), "cmd_entropy": (1,), "has_encoded_command": (1,), "has_download_keyword": (1,),
    "is_signed": (1,), "hour_of_day": (1,), "is_off_hours": (1,), "is_lolbin": (1,),
    "is_suspicious_parent": (1,), "parent_cmd_length": (1,), "is_known_suspicious_chain": (1,),
    "parent_is_same_image": (1,), "dns_query_length": (22,), "dest_port": (3,), "is_suspicious_port": (3,),
    "is_external_ip": (3,), "network_event_count": (3, 22), "image_load_count": (7,),
    "unsigned_image_loaded": (7,), "create_remote_thread_count": (8,), "open_process_count": (10,),
    "open_process_lsass_target": (10,), "open_process_suspicious_access": (10,), "rule_hit_count": (),
    "unique_rules_fired": (), "has_powershell_rule_hit": (), "has_lolbin_rule_hit": (),
    "has_network_rule_hit": (), "has_api_rule_hit": (), "has_chain_rule_hit": (),
}
FEATURES = list(FEATURE_TYPES)
FOREST_FEATURES = [f for f in FEATURES if f not in ("hour_of_day", "open_process_suspicious_access")]
BINARY_FEATURES = [f for f in FEATURES if f.startswith(("is_", "has_")) or f in (
    "parent_is_same_image", "unsigned_image_loaded", "open_process_lsass_target",
    "open_process_suspicious_access")]
ENCODED_MARKERS = ["-encodedcommand", " -enc ", "–enc"]
DOWNLOAD_WORDS = [
    "downloadstring", "downloadfile", "webclient", "invoke-webrequest", "wget", "curl", "bitstransfer",
]
LOLBINS = [
    "mshta.exe", "rundll32.exe", "regsvr32.exe", "certutil.exe", "wscript.exe", "cscript.exe",
    "msiexec.exe", "installutil.exe", "regasm.exe", "regsvcs.exe", "odbcconf.exe", "ieexec.exe",
    "msconfig.exe", "schtasks.exe", "at.exe", "bitsadmin.exe", "forfiles.exe", "pcalua.exe",
    "syncappvpublishingserver.exe", "appsyncpublishingserver.exe", "expand.exe", "extrac32.exe",
    "findstr.exe", "hh.exe", "makecab.exe", "msdeploy.exe", "msdt.exe", "mspub.exe", "wmic.exe",
    "xwizard.exe",
]
LAUNCHERS = [
    "winword.exe", "excel.exe", "powerpnt.exe", "outlook.exe", "onenote.exe", "mspub.exe", "visio.exe",
    "wscript.exe", "cscript.exe", "mshta.exe", "explorer.exe",
]
CHAINS = [  # parent and child that make a suspicious pair
    ("winword.exe", "powershell.exe"), ("winword.exe", "cmd.exe"), ("winword.exe", "wscript.exe"),
    ("winword.exe", "cscript.exe"), ("winword.exe", "mshta.exe"), ("excel.exe", "powershell.exe"),
    ("excel.exe", "cmd.exe"), ("excel.exe", "wscript.exe"), ("excel.exe", "cscript.exe"),
    ("powerpnt.exe", "powershell.exe"), ("powerpnt.exe", "cmd.exe"), ("outlook.exe", "powershell.exe"),
    ("outlook.exe", "cmd.exe"), ("wscript.exe", "powershell.exe"), ("wscript.exe", "cmd.exe"),
    ("cscript.exe", "powershell.exe"), ("cscript.exe", "cmd.exe"), ("mshta.exe", "powershell.exe"),
    ("mshta.exe", "cmd.exe"),
]
ODD_PORTS = [
    4444, 1234, 8443, 8888, 9001, 9002, 31337, 1337, 6666, 6667, 4445, 5555, 2222, 3333, 7777, 9999, 12345,
    54321, 65535,
]
VM_READ, VM_WRITE, ALL_ACCESS = 0x0010, 0x0020, 0x1F0FFF
RULE_FAMILIES = {
    "has_powershell_rule_hit": "PS_", "has_lolbin_rule_hit": "LOLBIN_", "has_network_rule_hit": "NET_",
    "has_api_rule_hit": "API_", "has_chain_rule_hit": "CHAIN_",
}

# How a window merges its events' values.
SUMMED = ["network_event_count", "image_load_count", "create_remote_thread_count", "open_process_count"]
ANY = [
    "has_encoded_command", "has_download_keyword", "is_lolbin", "is_suspicious_parent",
    "is_known_suspicious_chain", "parent_is_same_image", "unsigned_image_loaded",
    "open_process_lsass_target", "open_process_suspicious_access",
]
FIRST = {  # of the first event of the type
    1: ["cmd_length", "cmd_entropy", "is_signed", "hour_of_day", "is_off_hours", "parent_cmd_length"],
    3: ["dest_port", "is_suspicious_port", "is_external_ip"],
    22: ["dns_query_length"],
}


def default_value(feature: str) -> Column:
    if feature == "cmd_entropy":
        return F.lit(0.0)
    return F.lit(-1 if feature == "hour_of_day" else 0)


def _flag(test: Column) -> Column:
    return F.coalesce(test, F.lit(False)).cast("int")


def _chain(parent: Column, child: Column) -> Column:
    out = F.lit(False)
    for name in dict.fromkeys(p for p, _ in CHAINS):
        out = out | ((parent == name) & child.isin([c for p, c in CHAINS if p == name]))
    return out


# Values several features read; they get a projection of their own so each is worked out once.
PREPARED = {
    "_command": lambda: F.coalesce("command_line", F.lit("")),
    "_low_command": lambda: F.lower(F.coalesce("command_line", F.lit(""))),
    "_image_name": lambda: F.lower(win_name(F.col("image"))),
    "_parent_name": lambda: F.lower(win_name(F.col("parent_image"))),
    "_target_name": lambda: F.lower(win_name(F.col("target_image"))),
    "_mask": lambda: mask_value(F.col("granted_access")),
}


@lru_cache(maxsize=4)
def _built(session: str) -> tuple[dict[str, Column], dict[str, Column]]:
    """(prepared columns, features), built once per session."""
    return {name: make() for name, make in PREPARED.items()}, feature_columns()


def prepared(events: DataFrame) -> DataFrame:
    return events.withColumns(_built(events.sparkSession.sparkContext.applicationId)[0])


def feature_columns() -> dict[str, Column]:
    """Each feature over the prepared record of its own event type."""
    command, low = F.col("_command"), F.col("_low_command")
    image, parent = F.col("_image_name"), F.col("_parent_name")
    port = F.coalesce("destination_port", F.lit(0))
    mask = F.col("_mask")
    wide_access = (
        (mask.bitwiseAND(F.lit(VM_READ | VM_WRITE)) != 0) | (mask.bitwiseAND(F.lit(ALL_ACCESS)) == ALL_ACCESS))
    return {
        "cmd_length": F.char_length(command),
        "cmd_entropy": entropy(command),
        "has_encoded_command": _flag(contains_any(low, ENCODED_MARKERS)),
        "has_download_keyword": _flag(contains_any(low, DOWNLOAD_WORDS)),
        "is_signed": F.lit(0),  # the event carries no such field
        "hour_of_day": hour_or_unknown(F.col("event_time")),
        "is_off_hours": off_hours(F.col("event_time")),
        "is_lolbin": _flag(image.isin(LOLBINS)),
        "is_suspicious_parent": _flag(parent.isin(LAUNCHERS)),
        "parent_cmd_length": F.char_length(F.coalesce("parent_command_line", F.lit(""))),
        "is_known_suspicious_chain": _flag(_chain(parent, image)),
        "parent_is_same_image": _flag(parent == image),
        "dns_query_length": F.char_length(F.coalesce("query_name", F.lit(""))),
        "dest_port": port.cast("int"),
        "is_suspicious_port": _flag(port.isin(ODD_PORTS)),
        "is_external_ip": is_external(F.col("destination_ip")),
        "network_event_count": F.lit(1),
        "image_load_count": F.lit(1),
        "unsigned_image_loaded": _flag(~F.col("signed")),
        "create_remote_thread_count": F.lit(1),
        "open_process_count": F.lit(1),
        "open_process_lsass_target": _flag(F.col("_target_name") == "lsass.exe"),
        "open_process_suspicious_access": _flag(wide_access),
    }


def vector_columns(session: str, features: Sequence[str] = FEATURES) -> list[Column]:
    """Window key, time and features over ``prepared`` events; other types' features keep their defaults."""
    columns = _built(session)[1]
    out = [F.col("id"), F.col("event_type_id"), F.col("event_time"),
           event_image().alias("image"), event_pid().alias("pid")]
    for name in features:
        value = default_value(name)
        if name in columns:
            of_type = F.col("event_type_id").isin(list(FEATURE_TYPES[name]))
            value = F.when(of_type, columns[name]).otherwise(value)
        out.append(value.alias(name))
    return out


def event_vectors(events: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """One vector per event. Features of rule hits stay 0: an event alone has none."""
    return prepared(events).select(*vector_columns(events.sparkSession.sparkContext.applicationId, features))


KEYS = ("image", "pid")  # of a window


def event_features() -> list[str]:
    return [f for f in FEATURES if FEATURE_TYPES[f]]


def merge_columns() -> list[Column]:
    """Sums and maxima of event rows. Rows of other types, or of hits, add nothing to them."""
    merged = [F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in SUMMED]
    return merged + [F.coalesce(F.max(f), F.lit(0)).alias(f) for f in ANY]


def first_of_windows(vectors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each window the values of its first event of each type that has such features.

    The smallest times are found by hash aggregation; only the events of those times are left to be told
    apart by id, so no row but these is ever sorted.
    """
    eid = F.col("event_type_id")
    able = vectors.filter(eid.isin(list(FIRST)))
    own = [F.col(k).alias(f"_{k}") for k in keys]
    earliest = able.groupBy(*own, eid.alias("_type")).agg(F.min("event_time").alias("_earliest"))
    same = (eid == F.col("_type")) & F.col("event_time").eqNullSafe(F.col("_earliest"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    tied = able.join(earliest, same, "left_semi")
    place = F.row_number().over(Window.partitionBy(*keys, "event_type_id").orderBy("id"))
    first = tied.withColumn("_place", place).filter("_place = 1")
    # One row per window and type is left: a maximum takes the only value there is.
    fields = [F.max(F.when(eid == t, F.col(f))).alias(f"_first_{f}") for t, names in FIRST.items() for f in names]
    return first.groupBy(*own).agg(*fields)


def merged_windows(rows: DataFrame, vectors: DataFrame, more: Sequence[Column], keys: Sequence[str] = KEYS) -> DataFrame:
    """``rows`` merged by ``keys``, with ``more`` aggregates; all of them fit hash aggregation. The first
    events are found apart, among the event types that can be first, and the two meet as windows."""
    merged = rows.groupBy(*keys).agg(*merge_columns(), *more)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return merged.join(first_of_windows(vectors, keys), same, "left").drop(*(f"_{k}" for k in keys))


def pick_first(features: Sequence[str]) -> list[Column]:
    """Merged columns in feature order, defaults where a window has no event that is first."""
    source = {f for fields in FIRST.values() for f in fields}
    return [F.coalesce(F.col(f"_first_{f}"), default_value(f)).alias(f) if f in source else F.col(f) for f in features]


def _finish(grouped: DataFrame, label: int | None, keys: Sequence[str] = KEYS) -> DataFrame:
    tail = [] if label is None else [F.lit(label).alias("label")]
    return grouped.select(*keys, *pick_first(FEATURES), *tail)


WINDOW_KEY = ("window_image", "window_pid")  # of a hit


def detect_with_window(events: DataFrame, rules: Sequence[Rule] | None = None, fired_at: datetime | None = None) -> DataFrame:
    """Hits that carry their event's window key, so that nothing joins them back to the events."""
    named = events.withColumns({"window_image": event_image(), "window_pid": event_pid()})
    return detect(named, rules, fired_at, keep=WINDOW_KEY)


def hits_per_window_rule(hits: DataFrame) -> DataFrame:
    """image, pid, rule_id and the number of hits, from hits that carry their window."""
    return hits.groupBy(F.col("window_image").alias("image"), F.col("window_pid").alias("pid"), "rule_id").agg(F.count("*").alias("_n"))


def rule_features(hits: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """The features of rule hits for each window with a hit, from ``detect_with_window`` rows alone: events
    are not read. NULL keys are keys like any other; an empty or NULL rule id counts as a hit of no rule."""
    per_rule = hits_per_window_rule(in_range(hits, start, end))
    return per_rule.groupBy(*KEYS).agg(*rule_aggregates())


def rule_aggregates() -> list[Column]:
    """Features of rule hits from rows per window and rule."""
    rule_id = F.nullif(F.col("rule_id"), F.lit(""))
    return [
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rule_hit_count"),
        F.count(rule_id).alias("unique_rules_fired"),
        *[F.coalesce(F.max(F.startswith(rule_id, F.lit(p)).cast("int")), F.lit(0)).alias(f)
          for f, p in RULE_FAMILIES.items()],
    ]


def window_features(
    events: DataFrame, hits: DataFrame, start: datetime | None = None, end: datetime | None = None,
    label: int | None = None,
) -> DataFrame:
    """One vector per (image, pid), NULLs being keys like any other.

    Hits shrink to one row per window and rule, then join the events' own grouping as extra rows:
    one shuffle by window, and no join that could multiply counts.
    """
    events = in_range(events, start, end, "event_time")
    vectors = event_vectors(events, event_features())
    per_rule = hits_with_events(in_range(hits, start, end), events).groupBy("image", "pid", "rule_id").agg(
        F.count("*").alias("_n"))
    rows = vectors.unionByName(per_rule, allowMissingColumns=True)
    return _finish(merged_windows(rows, vectors, rule_aggregates()), label)


def window_features_live(
    events: DataFrame, rules: Sequence[Rule] | None = None, start: datetime | None = None,
    end: datetime | None = None, label: int | None = None, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """The same vectors straight from events: hits are never stored or joined. Other ``keys`` than image and
    pid are columns of the events.

    Each event's rule bitmask is merged with ``bit_or``, so distinct rules per window are a bit
    count and the whole job is one shuffle of map-side combined rows.
    """
    rules = catalogue() if rules is None else rules
    words = rule_words(rules)
    events = in_range(events, start, end, "event_time")
    masked = with_masks(events, rules)
    fired = [f"fired_{i}" for i in range(len(words))]
    session = events.sparkSession.sparkContext.applicationId
    own = [k for k in keys if k not in KEYS]
    vectors = prepared(masked).select(*vector_columns(session, event_features()), *fired, *own)
    hit_bits = sum((F.bit_count(F.col(f)) for f in fired[1:]), F.bit_count(F.col(fired[0])))
    grouped = merged_windows(vectors, vectors, [F.sum(hit_bits).alias("rule_hit_count"), *[F.bit_or(f).alias(f) for f in fired]], keys)
    unique = sum((F.bit_count(F.col(f)) for f in fired[1:]), F.bit_count(F.col(fired[0])))
    families = {}
    for name, prefix in RULE_FAMILIES.items():
        any_hit = F.lit(False)
        for f, word in zip(fired, words):
            bits = sum(1 << i for i, r in enumerate(word) if r.id.startswith(prefix))
            any_hit = any_hit | (F.col(f).bitwiseAND(F.lit(bits).cast("bigint")) != 0)
        families[name] = any_hit.cast("int")
    return _finish(grouped.withColumns({"unique_rules_fired": unique.cast("bigint"), **families}), label, keys)


def labelled_windows(events: DataFrame, spans: Sequence[tuple[datetime | None, datetime | None, int]],
                     rules: Sequence[Rule] | None = None) -> DataFrame:
    """Vectors of labelled time spans (start, end, label), both ends included and either open: span, image, pid,
    the features and label. A process that lives in two spans has a window in each, and an event in two spans
    counts in both, as if each span were extracted by itself; the events are read once. Events without a time
    are in no span.
    """
    if not spans or any(label not in (0, 1) for _, _, label in spans):
        raise ValueError("name at least one span, each with label 0 or 1")
    inside = []
    for n, (start, end, _) in enumerate(spans):
        within = F.col("event_time").isNotNull()
        within = within if start is None else within & (F.col("event_time") >= lit_time(start))
        within = within if end is None else within & (F.col("event_time") <= lit_time(end))
        inside.append(F.when(within, F.lit(n)))
    spread = events.withColumn("span", F.explode(F.array_compact(F.array(*inside))))
    labels = F.array(*[F.lit(label) for _, _, label in spans])
    windows = window_features_live(spread, rules, keys=["span", *KEYS])
    return windows.withColumn("label", F.get(labels, F.col("span")))
