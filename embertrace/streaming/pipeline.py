"""Live pipeline: XML stream -> records -> events, hits, alerts, scores and findings tables."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from embertrace.functions.clock import event_time
from embertrace.models.iforest import IsolationForest
from embertrace.models.scoring import score_events
from embertrace.operators.alerts import alerts_from_detected, detect_with_identity
from embertrace.operators.corroborate import findings
from embertrace.operators.tables import in_range
from embertrace.rules import Rule, catalogue
from embertrace.schema import HIT_COLUMNS
from embertrace.session import remove
from embertrace.sources.id_index import IdIndex, by_hash, by_time
from embertrace.sources.stored import CODEC, batch_folder, batches, event_rows, write_batch
from embertrace.sources.xml_events import POLL, accepted, parse, rejected
from embertrace.streaming.compaction import DATED, Manifest, batch_rows, compact, current, merged_rows

log = logging.getLogger(__name__)

TIME = "<TimeCreated\\s[^>]{0,200}?SystemTime\\s*=\\s*['\"]([^'\"]{0,64})['\"]"  # of a document that is not parsed yet
TASK_ROWS = 250_000  # records that a task takes at most, on average; it may have to sort them


def dealt(records: DataFrame, rows: int) -> DataFrame:
    """Records of a batch of ``rows``, dealt by id to more tasks if those that read or join them would get more
    than ``TASK_ROWS`` each: stored bytes say little about the memory of decoded rows, and a stream's joins
    have a fixed number of tasks."""
    needed, joined = -(-rows // TASK_ROWS), int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if needed <= min(joined, records.rdd.getNumPartitions()):
        return records
    return records.repartition(max(needed, joined), "id")


@dataclass
class TelemetryPipeline:
    """Every table has one folder per run and batch, replaced as a whole: a replay adds no rows, and runs
    add to each other. A stream's run is the id that its checkpoint keeps. An event that another batch has
    stored already is not stored again.

    A batch has its staged folder from before its first write until after its last. What a batch has written
    that stopped half way is not in ``table`` and not compared with, so its events are fresh to any later
    batch; files read by path may hold such leavings.

    ``since`` drops older events (a file stream cannot start at its end). ``fired_at`` fixes the
    evaluation clock; without it hits carry event time, and events without a usable time are rejected.

    Ids of stored events and rejects are indexed (``sources.id_index``); a batch reads the index where its own
    ids fall, not the tables, and does not parse the text of a stored event again. ``compact`` merges the folders
    of finished batches by date (``streaming.compaction``); a merged batch that is replayed is done already.
    """

    out: str
    rules: Sequence[Rule] = field(default_factory=catalogue)
    forest: IsolationForest | None = None
    classifier: PipelineModel | None = None
    since: datetime | None = None
    fired_at: datetime | None = None

    @property
    def ids(self) -> IdIndex:
        return IdIndex(f"{self.out}/index/events")

    @property
    def reject_ids(self) -> IdIndex:
        return IdIndex(f"{self.out}/index/rejects")

    def table(self, spark: SparkSession, name: str, days: tuple[date, date] | None = None) -> DataFrame:
        """The rows of the batches that have finished, merged ones among them. With ``days`` (first, last)
        only those of these dates; of merged rows then only these dates' files are read."""
        manifest, running = current(spark, self.out), set(batches(spark, f"{self.out}/staged"))
        fresh = [b for b in batches(spark, f"{self.out}/{name}") if b not in running and not manifest.covers(*b)]
        rows, merged = batch_rows(spark, self.out, name, fresh), merged_rows(spark, manifest, name)
        if name in DATED and days is not None:
            within = lambda c: c.between(F.lit(days[0]), F.lit(days[1]))
            rows = rows if rows is None else rows.filter(within(F.to_date(DATED[name])))
            merged = merged if merged is None else merged.filter(within(F.col("event_date")))
        if merged is not None and name != "records":
            merged = merged.drop("event_date")
        if rows is None and merged is None:  # nothing has finished: the table's columns and no rows
            return spark.read.parquet(f"{self.out}/{name}").limit(0)
        return merged if rows is None else rows if merged is None else rows.unionByName(merged, allowMissingColumns=True)

    def compact(self, spark: SparkSession, least: int = 2) -> Manifest:
        """Merge finished batches, and what they have indexed."""
        manifest = compact(spark, self.out, least)
        for index in (self.ids, self.reject_ids):
            index.compact(spark, manifest.covers)
        return manifest

    def process(self, raw: DataFrame, batch_id: int, run: str | None = None) -> None:
        """One batch. The parse is written once and read back, so that nothing repeats it; records are
        stored by date, and each later step scans their typed columns."""
        spark = raw.sparkSession
        run = run or f"r-{spark.sparkContext.getLocalProperty('sql.streaming.queryId') or uuid.uuid4().hex}"
        if current(spark, self.out).covers(run, batch_id):
            return
        staged = batch_folder(f"{self.out}/staged", batch_id, run)
        parsed = parse(self._unseen(raw, [*batches(spark, f"{self.out}/staged"), (run, batch_id)]), self.fired_at)
        parsed.write.mode("overwrite").option("compression", CODEC).parquet(staged)
        parsed = spark.read.schema(parsed.schema).parquet(staged)
        timed = F.col("event_time").isNotNull()
        untimed = parsed.filter(F.col("reject_reason").isNull() & ~timed).withColumn("reject_reason", F.lit("event time"))
        refused = rejected(parsed).unionByName(rejected(untimed)).dropDuplicates(["id"])
        unfinished = batches(spark, f"{self.out}/staged")
        known = self.reject_ids.known(by_hash(refused), unfinished)
        if known is not None:
            refused = refused.join(known.select("id").distinct(), "id", "left_anti").select(refused.columns)
        write_batch(refused, f"{self.out}/rejects", batch_id, run)
        refused = spark.read.schema(refused.schema).parquet(batch_folder(f"{self.out}/rejects", batch_id, run))
        self.reject_ids.add(by_hash(refused), batch_id, run)
        usable = in_range(accepted(parsed).filter(timed), self.since, None, "event_time")
        usable = dealt(usable, parsed.count())
        fresh = self._fresh(usable, unfinished).withColumn("event_date", F.to_date("event_time"))
        write_batch(fresh, f"{self.out}/records", batch_id, run, ("event_date",))
        records = spark.read.schema(fresh.schema).parquet(batch_folder(f"{self.out}/records", batch_id, run)).drop("event_date")
        self.ids.add(by_time(records, "event_time"), batch_id, run)
        store = lambda df, name: write_batch(df, f"{self.out}/{name}", batch_id, run)
        store(event_rows(records, self.fired_at), "events")
        detected = detect_with_identity(records, self.rules, self.fired_at).persist()  # few rows
        try:
            store(detected.select(*HIT_COLUMNS), "hits")
            store(alerts_from_detected(detected), "alerts")
        finally:
            detected.unpersist()
        hits = spark.read.parquet(batch_folder(f"{self.out}/hits", batch_id, run))
        self._guarded("findings", batch_id, lambda: store(findings(records, hits), "findings"))
        if self.forest is not None or self.classifier is not None:
            self._guarded("scores", batch_id, lambda: store(score_events(records, self.forest, self.classifier), "scores"))
        remove(spark, staged)

    def _unseen(self, raw: DataFrame, unfinished: list[tuple[str, int]]) -> DataFrame:
        """Documents without those whose text is that of a stored event: an id is the text's hash, so they need
        no parse. The index is read by the time that a pattern finds in the text; a document that it does not
        find so is parsed, and ``_fresh`` looks for it by its parsed time."""
        at = event_time(F.regexp_extract("xml", TIME, 1))
        times = by_time(raw.select(F.md5("xml").alias("id"), at.alias("event_time")).filter("event_time IS NOT NULL"), "event_time")
        known = self.ids.known(times, unfinished)
        if known is None:
            return raw
        known = known.select("id").distinct()
        if times.join(known, "id", "left_semi").isEmpty():
            return raw
        return raw.select("xml", F.md5("xml").alias("id")).join(known, "id", "left_anti").select("xml")

    def _fresh(self, usable: DataFrame, unfinished: list[tuple[str, int]]) -> DataFrame:
        """Each event once, without those that finished batches have stored. Both are found on the keys alone;
        full rows meet only keys that there are, and only repeated rows are compared in full width."""
        ids = usable.select("id")
        repeated = ids.groupBy("id").count().filter("count > 1").select("id")
        fresh = usable
        if not repeated.isEmpty():
            once = usable.join(repeated, "id", "left_anti")
            fresh = once.unionByName(usable.join(repeated, "id", "left_semi").dropDuplicates(["id"]))
        known = self.ids.known(by_time(usable, "event_time"), unfinished)
        if known is not None:
            known = known.select("id").distinct()
            if not ids.join(known, "id", "left_semi").isEmpty():
                fresh = fresh.join(known, "id", "left_anti")
        return fresh.select(usable.columns)

    @staticmethod
    def _guarded(step: str, batch_id: int, action) -> None:
        """Enrichment and scoring may fail without stopping storage; storage itself may not."""
        try:
            action()
        except Exception:
            log.exception("Step %s failed for batch %s; its tables lack that batch", step, batch_id)

    def start(self, raw_stream: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        """``raw_stream`` has one document per row in ``xml``. ``once`` stops when input is used up."""
        writer = raw_stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL)).start()
