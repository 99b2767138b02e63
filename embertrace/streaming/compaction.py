"""Compaction of a stream's batches: many small folders become few large ones by date, under readers' eyes.

A manifest names the folders of merged rows and the batches whose rows they are. Manifests are numbered and
never changed; the next one appears by a rename, and the highest number counts. A reader takes one manifest
and reads what it names and the batch folders that it does not cover, so each row is read once whatever runs
beside it. Covered folders stay until ``vacuum``, for readers that have begun.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embertrace.session import folders, read_text, remove, write_new
from embertrace.sources.stored import CODEC, batches

DATED = {"records": "event_time", "events": "timestamp", "hits": "event_time", "alerts": "timestamp", "scores": "timestamp"}
MOST_SEGMENTS = 8  # compactions whose folders stand side by side; the next one merges them


@dataclass
class Manifest:
    version: int = 0
    segments: list[str] = field(default_factory=list)  # folders of merged rows, one below it for each table
    covered: dict[str, list[list[int]]] = field(default_factory=dict)  # run -> ranges of its merged batches

    def covers(self, run: str, batch_id: int) -> bool:
        return any(low <= batch_id <= high for low, high in self.covered.get(run, []))

    def with_batches(self, done: list[tuple[str, int]]) -> dict[str, list[list[int]]]:
        ids = {run: [n for low, high in ranges for n in range(low, high + 1)] for run, ranges in self.covered.items()}
        for run, batch_id in done:
            ids.setdefault(run, []).append(batch_id)
        out: dict[str, list[list[int]]] = {}
        for run, numbers in ids.items():
            for n in sorted(set(numbers)):
                ranges = out.setdefault(run, [])
                if ranges and ranges[-1][1] == n - 1:
                    ranges[-1][1] = n
                else:
                    ranges.append([n, n])
        return out


def current(spark: SparkSession, out: str) -> Manifest:
    found = sorted(folders(spark, f"{out}/manifests/*.json"))
    return Manifest(**json.loads(read_text(spark, found[-1]))) if found else Manifest()


def has_files(spark: SparkSession, path: str) -> bool:
    """Whether a table's folder has rows' files: one of no rows may have none, and so no schema."""
    return bool(folders(spark, f"{path}/*.parquet") or folders(spark, f"{path}/*=*"))


def merged_rows(spark: SparkSession, manifest: Manifest, name: str) -> DataFrame | None:
    """The rows of a table that compactions have merged, with run and batch_id; ``event_date`` is the
    partition of tables that have times."""
    parts = [spark.read.parquet(path) for s in manifest.segments if has_files(spark, path := f"{s}/{name}")]
    rows = None
    for part in parts:
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return rows


def batch_rows(spark: SparkSession, out: str, name: str, wanted: list[tuple[str, int]]) -> DataFrame | None:
    paths = [p for run, batch in wanted if has_files(spark, p := f"{out}/{name}/run={run}/batch_id={batch}")]
    return spark.read.option("basePath", f"{out}/{name}").parquet(*paths) if paths else None


def tables(spark: SparkSession, out: str) -> list[str]:
    return sorted({p.rsplit("/", 2)[1] for p in folders(spark, f"{out}/*/run=*")} - {"staged"})


def compact(spark: SparkSession, out: str, least: int = 2) -> Manifest:
    """Merge the batches that have finished and are not merged yet, if there are ``least`` of them; the
    manifest that counts afterwards. One compaction runs at a time: of two, the later rename fails, and what
    it wrote is never read."""
    manifest = current(spark, out)
    running = set(batches(spark, f"{out}/staged"))
    done = [b for b in batches(spark, f"{out}/records") if b not in running and not manifest.covers(*b)]
    if len(done) < least:
        return manifest
    segment = f"{out}/segments/{uuid.uuid4().hex}"
    merges = manifest.segments if len(manifest.segments) >= MOST_SEGMENTS else []
    older = Manifest(segments=merges)
    for name in tables(spark, out):
        rows = batch_rows(spark, out, name, done)
        before = merged_rows(spark, older, name) if merges else None
        if rows is None:
            rows = before
        elif before is not None:
            rows = before.unionByName(rows, allowMissingColumns=True)
        if rows is None:
            continue
        if name in DATED:
            # A date's rows go to few files, however many batches they come from; salted, so that one date is several tasks.
            rows = rows.withColumn("event_date", F.to_date(DATED[name]))
            rows.repartition("event_date", F.pmod(F.xxhash64("id" if "id" in rows.columns else "event_fk"), F.lit(4))).write.option("compression", CODEC).partitionBy("event_date").parquet(f"{segment}/{name}")
        else:
            rows.coalesce(8).write.option("compression", CODEC).parquet(f"{segment}/{name}")
    following = Manifest(manifest.version + 1, [*(s for s in manifest.segments if s not in merges), segment], manifest.with_batches(done))
    write_new(spark, f"{out}/manifests/{following.version:08d}.json", json.dumps(following.__dict__))
    return following


def vacuum(spark: SparkSession, out: str) -> int:
    """Remove the folders that the current manifest has merged, and older manifests; the number of folders.
    To be run when no reader that began before the last compaction is still at work."""
    manifest = current(spark, out)
    gone = [f"{out}/{name}/run={run}/batch_id={batch}" for name in tables(spark, out) for run, batch in batches(spark, f"{out}/{name}") if manifest.covers(run, batch)]
    gone += [s for s in folders(spark, f"{out}/segments/*") if s.rsplit("/", 1)[1] not in {k.rsplit("/", 1)[1] for k in manifest.segments}]
    for path in [*gone, *sorted(folders(spark, f"{out}/manifests/*.json"))[:-1]]:
        remove(spark, path)
    return len(gone)
