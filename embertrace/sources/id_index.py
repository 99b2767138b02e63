"""Index of the ids that a stream's batches have stored, so that a batch need not read the tables for them.

Ids lie in parts: dates of event time for events, since equal ids mean equal times, and hash buckets for what
has no usable time. The name of a folder tells from when to when its ids are, so a batch opens only folders
of its own parts and times, and of large ones only the row groups. What it reads does not grow with what is
stored from other times.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embertrace.session import exists, folders, remove
from embertrace.sources.stored import CODEC

BUCKETS = 64
MOST_PARTS = 1000  # that are looked up by folder; a batch of more dates reads the whole index
MERGED = "merged"  # the run of merged ids


def by_time(ids: DataFrame, time: str) -> DataFrame:
    """(id, part, at) of events."""
    return ids.select("id", F.unix_date(F.to_date(time)).cast("bigint").alias("part"), F.unix_micros(time).alias("at"))


def by_hash(ids: DataFrame) -> DataFrame:
    """(id, part, at) of rows without a time."""
    return ids.select("id", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("bigint").alias("part"), F.xxhash64("id").alias("at"))


@dataclass
class IdIndex:
    """``path`` holds part=, run= and batch_id= folders of ids. Rows of unfinished batches do not count."""

    path: str

    def add(self, ids: DataFrame, batch_id: int, run: str) -> None:
        """Store ``ids`` (id, part, at) of a batch; what the batch has stored before is replaced."""
        spark = ids.sparkSession
        for path in folders(spark, f"{self.path}/part=*/run={run}/batch_id={batch_id}"):
            remove(spark, path)
        self._append(ids, batch_id, run)

    def _append(self, ids: DataFrame, batch_id: int, run: str) -> None:
        spans = ids.groupBy("part").agg(F.min("at").alias("low"), F.max("at").alias("high"))
        rows = ids.join(F.broadcast(spans), "part").select("id", "at", "part", F.lit(run).alias("run"), F.lit(batch_id).cast("bigint").alias("batch_id"), "low", "high")
        # One row per date or bucket is sent to the tasks; ids are not gathered by date for it.
        # A part's ids in few files, a very large part in several, ordered so that row groups can be skipped.
        dealt = rows.hint("rebalance", "part").sortWithinPartitions("part", "at")
        dealt.write.mode("append").option("compression", CODEC).partitionBy("part", "run", "batch_id", "low", "high").parquet(self.path)

    def known(self, ids: DataFrame, unfinished: list[tuple[str, int]]) -> DataFrame | None:
        """The stored ids that may be among ``ids`` (id, part, at); None if there are none."""
        spark = ids.sparkSession
        if not exists(spark, self.path):
            return None
        spans = {r.part: (r.low, r.high) for r in ids.groupBy("part").agg(F.min("at").alias("low"), F.max("at").alias("high")).limit(MOST_PARTS + 1).collect()}
        if not spans:
            return None
        if len(spans) > MOST_PARTS:
            return self._read(ids, [self.path], unfinished)
        paths = []
        for path in folders(spark, f"{self.path}/part={{{','.join(map(str, spans))}}}/run=*/batch_id=*/low=*/high=*"):
            part, run, batch, low, high = (p.split("=", 1)[1] for p in path.rsplit("/", 5)[1:])
            first, last = spans[int(part)]
            if (run, int(batch)) not in unfinished and int(low) <= last and int(high) >= first:
                paths.append(path)
        low, high = min(s[0] for s in spans.values()), max(s[1] for s in spans.values())
        return self._read(ids, paths, unfinished).filter(F.col("at").between(low, high)) if paths else None

    def _read(self, ids: DataFrame, paths: list[str], unfinished: list[tuple[str, int]]) -> DataFrame:
        schema = f"id {ids.schema['id'].dataType.simpleString()}, at bigint, part bigint, run string, batch_id bigint, low bigint, high bigint"
        rows = ids.sparkSession.read.schema(schema).option("basePath", self.path).parquet(*paths)
        for run, batch_id in unfinished:
            rows = rows.filter(~((F.col("run") == run) & (F.col("batch_id") == batch_id)))
        return rows.select("id", "part", "at")

    def compact(self, spark: SparkSession, covered: Callable[[str, int], bool], least: int = 2) -> int:
        """Merge what several batches have stored in a part; the number of parts merged. Only batches that are
        never done again (``covered``) may be merged: their ids then have no batch. The merged ids stand before
        the single ones go, and an id that is there twice is known all the same."""
        by_part: dict[str, list[str]] = {}
        for at in folders(spark, f"{self.path}/part=*/run=*/batch_id=*"):
            part, run, batch = at.rsplit("/", 3)[1:]
            run, batch = run.removeprefix("run="), int(batch.removeprefix("batch_id="))
            if run == MERGED or covered(run, batch):
                by_part.setdefault(part, []).append(at)
        crowded = {part: at for part, at in by_part.items() if len(at) >= least}
        if crowded:
            single = [p for at in crowded.values() for p in at]
            merged = folders(spark, f"{self.path}/part=*/run={MERGED}/batch_id=*")
            number = 1 + max([int(p.rsplit("=", 1)[1]) for p in merged], default=0)
            stored = spark.read.option("basePath", self.path).parquet(*single)
            self._append(self._read(stored, single, []).distinct(), number, MERGED)
            for path in single:
                remove(spark, path)
        return len(crowded)
