"""Extension: process-window features over event-time windows, with bounded state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embertrace.operators.features import FIRST, event_features, event_vectors, merge_columns, pick_first


def first_columns() -> list[Column]:
    """The values of the first event of each type that has such features; one pass, as a stream needs it."""
    eid = F.col("event_type_id")
    return [F.min(F.when(eid == t, F.struct("event_time", "id", *fields))).alias(f"_first_{t}") for t, fields in FIRST.items()]


def windowed_features(events: DataFrame, length: str = "10 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Event features per (time window, image, pid). Rows later than ``lateness`` are left out and
    finished windows leave the state. Works on a stream (append mode) and on a batch."""
    vectors = event_vectors(events.withWatermark("event_time", lateness), event_features())
    grouped = vectors.groupBy(F.window("event_time", length), "image", "pid").agg(*merge_columns(), *first_columns())
    grouped = grouped.select("*", *(F.col(f"_first_{t}.{f}").alias(f"_first_{f}") for t, fields in FIRST.items() for f in fields))
    return grouped.select(
        F.col("window.start").alias("window_start"), "image", "pid", *pick_first(event_features()))
