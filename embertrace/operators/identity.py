"""Process identity over time: which process an event belongs to, although hosts share and reuse pids.

A process is what one creation started: it has its pid on its host from its start until the next start of
that pid there. A process_guid, where an event has one, names it outright. Trees, parents and windows on
these keys stand beside those on the pid alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embertrace.operators.asof import latest_before
from embertrace.operators.features import window_features_live
from embertrace.operators.tables import event_pid, in_range
from embertrace.operators.tree import paths
from embertrace.rules import Rule
from embertrace.session import cut_lineage

STRETCH_SECONDS = 3600  # events of one pid and host that meet its starts in one group
HOST_PID = ["computer", "pid"]


def _micros(column: str) -> Column:
    return F.unix_micros(column)


def _guid(by_guid: bool) -> Column:
    return F.nullif(F.trim("process_guid"), F.lit("")) if by_guid else F.lit(None).cast("string")


def processes(events: DataFrame, by_guid: bool = True) -> DataFrame:
    """(process, computer, pid, guid, started, ended, image, command_line, parent_pid): one row for each
    process that a creation in ``events`` starts.

    ``process`` is the id of its creation. Creations of one host with one guid are the same process, the
    oldest counts; without ``by_guid``, or a guid, every creation starts a process. ``ended`` is the next start
    of its pid on its host, null if there is none; starts of one moment end together. Creations without pid or
    time start nothing; a host without name is a host like others.
    """
    made = events.filter((F.col("event_type_id") == 1) & F.col("process_id").isNotNull() & F.col("event_time").isNotNull())
    made = made.select(F.struct("event_time", "id").alias("started"), "computer", F.col("process_id").alias("pid"), _guid(by_guid).alias("guid"), "image", "command_line", F.col("parent_process_id").alias("parent_pid"))
    alone = F.when(F.col("guid").isNull(), F.col("started.id"))
    fields = F.struct("started", "pid", "image", "command_line", "parent_pid")
    first = made.groupBy("computer", "guid", alone.alias("alone")).agg(F.min(fields).alias("first"))
    rows = first.select(
        F.col("first.started.id").alias("process"), "computer", F.col("first.pid").alias("pid"), "guid", F.col("first.started.event_time").alias("started"),
        F.col("first.image").alias("image"), F.col("first.command_line").alias("command_line"), F.col("first.parent_pid").alias("parent_pid"))
    # The next start is the latest one before, on a clock that runs backwards.
    back = rows.withColumn("at", -_micros("started"))
    marks = back.select(*HOST_PID, "at", F.col("started").alias("mark"))
    ended = latest_before(back, marks, HOST_PID, STRETCH_SECONDS * 1_000_000, strict=True)
    return ended.select(*rows.columns[:5], F.col("found").alias("ended"), *rows.columns[5:])


def _started(known: DataFrame) -> DataFrame:
    return known.select(*HOST_PID, _micros("started").alias("at"), F.col("process").alias("mark"))


def with_process(events: DataFrame, known: DataFrame, by_guid: bool = True) -> DataFrame:
    """``events`` with ``process``: the process of ``known`` (``processes``) that the event's guid names, else
    the latest that had started with the event's pid on its host. Null where there is none. A column of that
    name is refused."""
    if "process" in {c.lower() for c in events.columns}:
        raise ValueError("events have a column named process already")
    keyed = events.select(F.struct(*(F.col(f"`{c}`") for c in events.columns)).alias("event"), "computer", event_pid().alias("pid"), _guid(by_guid).alias("guid"), _micros("event_time").alias("at"))
    timed = keyed.filter(F.col("pid").isNotNull() & F.col("at").isNotNull())
    found = latest_before(timed, _started(known), HOST_PID, STRETCH_SECONDS * 1_000_000)
    found = found.unionByName(keyed.filter(F.col("pid").isNull() | F.col("at").isNull()).withColumn("found", F.lit(None).cast(known.schema["process"].dataType)))
    if by_guid:
        named = known.filter("guid IS NOT NULL").select(F.col("computer").alias("_computer"), F.col("guid").alias("_guid"), F.col("process").alias("_named"))
        found = found.join(named, F.col("computer").eqNullSafe(F.col("_computer")) & (F.col("guid") == F.col("_guid")), "left")
        found = found.withColumn("found", F.coalesce("_named", "found"))
    return found.select("event.*", F.col("found").alias("process"))


def process_nodes(known: DataFrame) -> DataFrame:
    """``known`` with ``parent_process``: the latest process of its host with its parent's pid that had started
    before it, null if that start is unknown. No process is below itself, so the result has no cycles."""
    children = known.select(*known.columns, _micros("started").alias("at"))
    names = known.columns
    asked = children.select(F.struct(*names).alias("child"), "computer", F.col("parent_pid").alias("pid"), "at")
    found = latest_before(asked.filter("pid IS NOT NULL"), _started(known), HOST_PID, STRETCH_SECONDS * 1_000_000, strict=True)
    lone = asked.filter("pid IS NULL").withColumn("found", F.lit(None).cast(known.schema["process"].dataType))
    return found.unionByName(lone).select("child.*", F.col("found").alias("parent_process"))


def process_paths(nodes: DataFrame) -> DataFrame:
    """(process, root_process, depth) of every node of ``process_nodes``."""
    above = nodes.select(F.col("process").alias("pid"), F.col("parent_process").alias("parent_pid"))
    found, _ = paths(cut_lineage(above))  # every round of it reads the nodes
    return found.select(F.col("pid").alias("process"), F.col("root_pid").alias("root_process"), "depth")


def process_windows(
    events: DataFrame, rules: Sequence[Rule] | None = None, start: datetime | None = None, end: datetime | None = None,
    label: int | None = None, by_guid: bool = True,
) -> DataFrame:
    """The vectors of ``window_features_live`` per (computer, process) of the events in range; processes are
    known from all ``events``. Events of no known process are one window for each host and pid, of process null."""
    known = cut_lineage(processes(events, by_guid))
    owned = with_process(in_range(events, start, end, "event_time"), known, by_guid)
    pid = F.when(F.col("process").isNull(), event_pid())
    return window_features_live(owned.withColumn("stray_pid", pid), rules, label=label, keys=("computer", "process", "stray_pid"))
