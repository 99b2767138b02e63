"""Stored tables: their row forms, validity checks, writes, and feature CSV files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from embertrace.functions.clock import lit_time
from embertrace.functions.lines import payload_json
from embertrace.operators.features import FEATURES
from embertrace.operators.tables import event_image, event_pid
from embertrace.schema import EVENT_COLUMNS, MODEL_TYPES, SEVERITIES, STATUSES
from embertrace.session import folders


def event_rows(events: DataFrame, ingested_at: datetime | None = None) -> DataFrame:
    """Every event as a row of the events table, hit or not: flat pid and image, payload as JSON."""
    return events.select(
        "id", "event_type_id", F.col("event_time").alias("timestamp"), event_pid().alias("pid"),
        event_image().alias("image"), payload_json().alias("raw_json"),
        (F.lit(None).cast("timestamp") if ingested_at is None else lit_time(ingested_at)).alias("ingested_at"),
    ).select(*EVENT_COLUMNS)


# Ids are digits of a hash: most of what a stored row takes, and half of it is left by a codec that codes digits.
CODEC = "zstd"

# Rules each stored table puts on its rows.
def validity(kind: str) -> Column:
    tests = {
        "events": F.col("event_type_id").isNotNull() & F.col("timestamp").isNotNull(),
        "hits": F.col("severity").isin(SEVERITIES),
        "alerts": F.col("severity").isin(SEVERITIES) & F.col("status").isin(STATUSES),
        "scores": F.col("model_type").isin(MODEL_TYPES) & F.col("score").between(0.0, 1.0) & ~F.isnan("score"),
    }
    return F.coalesce(tests[kind], F.lit(False))


def split_valid(df: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(rows the table takes, rows it refuses)."""
    return df.filter(validity(kind)), df.filter(~validity(kind))


def append(df: DataFrame, path: str, kind: str, partition_by: tuple[str, ...] = ()) -> None:
    """Append the valid rows; refused rows go to a table beside it, so none is lost."""
    good, bad = split_valid(df, kind)
    good.write.mode("append").partitionBy(*partition_by).parquet(path)
    bad.write.mode("append").parquet(f"{path}_refused")


def batch_folder(path: str, batch_id: int, run: str) -> str:
    return f"{path}/run={run}/batch_id={batch_id}"


def write_batch(df: DataFrame, path: str, batch_id: int, run: str = "only", partition_by: tuple[str, ...] = ()) -> None:
    """Replace the folder of one batch of one run: replaying a batch leaves no second copy, and another run
    that counts its batches from 0 again replaces nothing. A run's name begins with a letter."""
    df.write.mode("overwrite").option("compression", CODEC).partitionBy(*partition_by).parquet(batch_folder(path, batch_id, run))


def batches(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(run, batch_id) of the batch folders of a table."""
    found = [at.rsplit("/", 2)[1:] for at in folders(spark, f"{path}/run=*/batch_id=*")]
    return [(run.removeprefix("run="), int(batch.removeprefix("batch_id="))) for run, batch in found]


def write_features_csv(vectors: DataFrame, path: str) -> None:
    """Features in registry order, header always, ``label`` last if there is one."""
    label = ["label"] if "label" in vectors.columns else []
    vectors.select(*FEATURES, *label).write.mode("overwrite").csv(path, header=True)


def read_features_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Named columns of a feature CSV (all features by default). Missing ones are an error."""
    wanted = FEATURES if columns is None else columns
    header = spark.read.csv(path, header=True)  # text columns: only the header is looked at here
    missing = [c for c in wanted if c not in header.columns]
    if missing:
        raise ValueError(f"the file has no columns {missing}")
    kinds = {"cmd_entropy": "double"}
    schema = ", ".join(f"`{c}` {kinds.get(c, 'bigint')}" for c in header.columns)
    extra = ["label"] if "label" in header.columns and "label" not in wanted else []
    return spark.read.schema(schema).csv(path, header=True).select(*wanted, *extra)
