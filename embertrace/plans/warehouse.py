"""The stored tables, built once per session from the given data and then read like any other.

``telemetry`` holds wide records partitioned by event type, so a query on one type reads only
that type's files. ``hits`` and ``alerts`` come from detection over it, ``scores`` from
``raw_value``. All live in the shared folder.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embertrace.operators.alerts import alerts_from_detected, detect_with_identity, status_changes
from embertrace.operators.detect import detect
from embertrace.operators.features import detect_with_window
from embertrace.plans.telemetry import telemetry
from embertrace.session import shared_dir, tune

_built: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table for this session, written on first use."""
    tune(spark)
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir), name)
    if key not in _built:
        path = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}/{name}"
        _write(spark, sf_dir, name, path)
        _built[key] = path
    return spark.read.parquet(_built[key])


def _write(spark: SparkSession, sf_dir: str, name: str, path: str) -> None:
    if name == "telemetry":
        # Range-free redistribution by type would put a third of the rows in one task; rows are
        # written where they were read, each task splitting its own by type.
        telemetry(spark, sf_dir).write.partitionBy("event_type_id").parquet(path)
    elif name == "hits":
        detect(table(spark, sf_dir, "telemetry")).write.parquet(path)
    elif name == "window_hits":
        detect_with_window(table(spark, sf_dir, "telemetry")).write.parquet(path)
    elif name == "alerts":
        alerts_from_detected(detect_with_identity(table(spark, sf_dir, "telemetry"))).write.parquet(path)
    elif name == "status_changes":
        status_changes(demo_changes(table(spark, sf_dir, "alerts")), table(spark, sf_dir, "alerts")).write.parquet(path)
    elif name == "scores":
        demo_scores(table(spark, sf_dir, "telemetry")).write.parquet(path)
    else:
        raise KeyError(name)


def demo_scores(events: DataFrame) -> DataFrame:
    """Score rows made from ``raw_value``: model by parity of the id."""
    return events.select(
        F.col("id").alias("event_fk"),
        F.when(F.col("id") % 2 == 0, "isolation_forest").otherwise("random_forest").alias("model_type"),
        F.least(F.col("raw_value") / 500.0, F.lit(1.0)).alias("score"),
        F.col("event_time").alias("timestamp"),
        F.lit("event").alias("mode"),
    )


def demo_changes(alerts: DataFrame) -> DataFrame:
    """Two changes for two thirds of the alerts, a minute and an hour after each."""
    third = F.col("event_fk") % 3
    base = alerts.filter(third != 0)
    first = base.select(
        F.col("id").alias("alert_id"), F.lit("acknowledged").alias("status"),
        (F.col("timestamp") + F.expr("INTERVAL 1 MINUTE")).alias("changed_at"))
    second = base.filter(third == 2).select(
        F.col("id").alias("alert_id"), F.lit("resolved").alias("status"),
        (F.col("timestamp") + F.expr("INTERVAL 1 HOUR")).alias("changed_at"))
    return first.unionByName(second)
