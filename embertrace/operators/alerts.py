"""Alerts: one per hit, and their status as an append-only change log."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embertrace.operators.detect import detect
from embertrace.rules import Rule
from embertrace.schema import ALERT_COLUMNS, STATUSES


def process_image() -> Column:
    """Image, or for thread and access events the source image; '' falls through."""
    return F.coalesce(F.nullif(F.col("image"), F.lit("")), F.nullif(F.col("source_image"), F.lit("")))


def process_pid() -> Column:
    """Process id, or the source's; 0 falls through."""
    return F.coalesce(F.nullif(F.col("process_id"), F.lit(0)), F.nullif(F.col("source_process_id"), F.lit(0)))


def alert_identity(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("id").alias("event_fk"),
        process_image().alias("process_image"),
        process_pid().alias("process_pid"),
        "command_line",
        "parent_image",
    )


def _alert_columns() -> list[Column]:
    fixed = {
        "rule_hit_fk": F.col("id"), "status": F.lit("open"), "suspected_families": F.lit(None).cast("string")}
    return [fixed.get(c, F.col(c)).alias(c) for c in ALERT_COLUMNS]


def alerts_from_hits(hits: DataFrame, events: DataFrame) -> DataFrame:
    """One alert per hit: severity copied, status open, no merging.

    A hit whose event is gone keeps its alert with empty process columns.
    """
    joined = hits.drop("event_time").join(alert_identity(events), "event_fk", "left")
    return joined.select(*_alert_columns())


IDENTITY = ["process_image", "process_pid", "command_line", "parent_image"]


def detect_with_identity(events: DataFrame, rules: Sequence[Rule] | None = None, fired_at: datetime | None = None) -> DataFrame:
    """Hits that carry what an alert says about the process, so making alerts needs no join back
    to the events: of a large table only the rare firing rows move on."""
    named = events.withColumns({"process_image": process_image(), "process_pid": process_pid()})
    return detect(named, rules, fired_at, keep=IDENTITY)


def alerts_from_detected(detected: DataFrame) -> DataFrame:
    """The alerts of ``detect_with_identity`` rows; the same rows as ``alerts_from_hits``."""
    return detected.select(*_alert_columns())


def status_changes(changes: DataFrame, alerts: DataFrame | None = None) -> DataFrame:
    """Changes to a valid status. A row with another status, or one for an alert that ``alerts`` lacks, is an
    error that refuses the whole batch."""
    if alerts is not None:
        ids = alerts.select(F.col("id").alias("_alert"))
        unknown = F.raise_error(F.concat(F.lit("there is no alert "), F.coalesce("alert_id", F.lit("NULL"))))
        joined = changes.join(ids, F.col("alert_id") == F.col("_alert"), "left")
        changes = joined.withColumn("alert_id", F.when(F.col("_alert").isNotNull(), F.col("alert_id")).otherwise(unknown)).drop("_alert")
    valid = F.col("status").isin(STATUSES)
    message = F.concat(F.lit("an alert cannot become "), F.coalesce("status", F.lit("NULL")), F.lit("; it can be " + ", ".join(STATUSES)))
    return changes.withColumn("status", F.when(valid, F.col("status")).otherwise(F.raise_error(message)))


def unknown_changes(changes: DataFrame, alerts: DataFrame) -> DataFrame:
    """Changes that name no existing alert."""
    return changes.join(alerts.select(F.col("id").alias("alert_id")), "alert_id", "left_anti")


def with_status(alerts: DataFrame, changes: DataFrame) -> DataFrame:
    """Alerts with their latest status. The log is reduced per alert before the join."""
    latest = changes.groupBy("alert_id").agg(
        F.max(F.struct("changed_at", "status")).getField("status").alias("_latest"))
    joined = alerts.join(latest, alerts["id"] == latest["alert_id"], "left").drop("alert_id")
    return joined.withColumn("status", F.coalesce("_latest", "status")).drop("_latest")
