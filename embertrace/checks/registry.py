"""Where queries register. A query reads the given tables through the stored tables built from them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embertrace.plans import warehouse
from embertrace.session import tune

NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)  # all ranges end here, so results are fixed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The stored tables of one scale directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return warehouse.table(self.spark, self.sf_dir, name)

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def comparable(df: DataFrame) -> DataFrame:
    """Result types any engine agrees on: microseconds for times, bigint for whole numbers and
    flags, doubles for fractions (not rounded: rounding makes a tie of what the engines sum in another order)."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.unix_micros(c.cast("timestamp"))
        elif isinstance(f.dataType, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = c.cast("double") + 0.0
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c = F.concat_ws(",", c)
        columns.append(c.alias(f.name))
    return df.select(*columns)


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under an operator's name."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return comparable(fn(Tables(tune(spark), sf_dir)))

        run.__doc__ = fn.__doc__
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return wrap
