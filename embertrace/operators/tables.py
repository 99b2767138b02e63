"""Filters, ordering, paging, lookups and joins over the stored tables."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import datetime
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embertrace.functions.clock import lit_time
from embertrace.schema import SOURCE_IMAGE_TYPES
from embertrace.session import cut_lineage

MOST_ROWS = 500  # of a page
SECOND = 1_000_000  # microseconds
SPANS = (30 * 86_400 * SECOND, 86_400 * SECOND, 3_600 * SECOND, 60 * SECOND, SECOND)


# --- filters and order ----------------------------------------------------------------------

def in_range(df: DataFrame, start: datetime | None, end: datetime | None, column: str = "timestamp") -> DataFrame:
    """Inclusive at both ends; either may be missing."""
    if start is not None:
        df = df.filter(F.col(column) >= lit_time(start))
    if end is not None:
        df = df.filter(F.col(column) <= lit_time(end))
    return df


def newest_first(column: str = "timestamp", key: str = "id") -> list[Column]:
    """Newest first; the key settles ties so a page is the same every time."""
    return [F.col(column).desc(), F.col(key).desc()]


def recent(df: DataFrame, k: int, column: str = "timestamp", key: str = "id") -> DataFrame:
    return df.orderBy(*newest_first(column, key)).limit(k)


def latest_after(hits: DataFrame, moment: datetime) -> DataFrame:
    """The newest hit strictly after a moment; no row if there is none."""
    return recent(hits.filter(F.col("timestamp") > lit_time(moment)), 1)


def rules_text(rules: DataFrame, text: str = "", severity: str = "") -> DataFrame:
    """Rules whose name or id contains the text, and of a severity if one is given."""
    wanted = F.lit(text.lower())
    hit = F.contains(F.lower("rule_name"), wanted) | F.contains(F.lower("rule_id"), wanted)
    return rules.filter(hit & (F.col("severity") == severity if severity else F.lit(True)))


# --- paging ---------------------------------------------------------------------------------

MOST_CANDIDATES = 100_000  # scores that are broadcast, at most
SORTED_ROWS = 100_000  # that a page may be sorted out of; more are narrowed further


@dataclass
class Page:
    items: DataFrame
    total: int
    number: int
    size: int

    @property
    def pages(self) -> int:
        return max(1, math.ceil(self.total / self.size))


def page(df: DataFrame, number: int = 1, size: int = 50, column: str = "timestamp", key: str = "id") -> Page:
    """Page ``number`` (from 1) of ``size`` rows (1 to 500; other sizes are an error), newest first, with
    the total.

    Counts per month-long span, then per day, hour, minute and second inside what is left narrow the rows
    down until few enough are left to sort, at most to the seconds that the page lies in: a top-k over
    everything would send skip + size rows of every task to one place. A level's counts are few: they lie
    inside the spans that the level before it chose.
    """
    if not 1 <= size <= MOST_ROWS:
        raise ValueError(f"a page holds 1 to {MOST_ROWS} rows, not {size}")
    number = max(1, number)
    rows, skip, total = df, (number - 1) * size, None
    for span in SPANS:
        at = F.floor(F.unix_micros(column) / span)
        counts = {r[0]: r[1] for r in rows.groupBy(at.alias("at")).count().collect()}
        total = sum(counts.values()) if total is None else total
        chosen, have = [], 0
        for t in sorted(counts, key=lambda t: (t is not None, t), reverse=True):  # rows without a time last
            if not chosen and skip >= counts[t]:
                skip -= counts[t]
                continue
            chosen.append(t)
            have += counts[t]
            if have >= skip + size:
                break
        if not chosen:
            return Page(df.limit(0), total, number, size)
        timed, inside = [t for t in chosen if t is not None], F.lit(False)
        if timed:
            since, until = F.timestamp_micros(F.lit(min(timed) * span)), F.timestamp_micros(F.lit((max(timed) + 1) * span))
            inside = (F.col(column) >= since) & (F.col(column) < until)
        if None in chosen:
            inside = inside | F.col(column).isNull()
        rows = df.filter(inside)
        if sum(counts[t] for t in chosen) <= SORTED_ROWS:
            break
    return Page(rows.orderBy(*newest_first(column, key)).offset(skip).limit(size), total, number, size)


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Consecutive numbers from 0 in the given order, without one task seeing all rows.

    Rows are range-sorted and written once (so the layout is fixed), each partition is counted,
    and a row's number is its place in its partition plus the rows of earlier partitions. Only one
    count per partition reaches the driver. ``order`` must end in a unique key.
    """
    fixed = cut_lineage(df.orderBy(*order))
    placed = fixed.withColumn("_at", F.monotonically_increasing_id())
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(placed.groupBy(part.alias("p")).count().collect())  # one row per partition
    before = [0, *accumulate(n for _, n in sizes)]
    offsets = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "_part bigint, _before bigint")
    placed = placed.withColumns({"_part": part, "_place": place}).join(offsets, "_part")
    return placed.withColumn(name, F.col("_place") + F.col("_before")).drop("_at", "_part", "_place", "_before")


# --- stored event rows ----------------------------------------------------------------------

def event_pid() -> Column:
    return F.when(F.col("event_type_id").isin(SOURCE_IMAGE_TYPES), F.col("source_process_id")).otherwise(F.col("process_id"))


def event_image() -> Column:
    return F.when(F.col("event_type_id").isin(SOURCE_IMAGE_TYPES), F.col("source_image")).otherwise(F.col("image"))


def alert_detail(alerts: DataFrame, events: DataFrame, alert_id: str) -> DataFrame:
    """One alert beside its event (prefixed ``event_``). The alert filter runs before the join."""
    one = alerts.filter(F.col("id") == alert_id)
    named = events.select(
        F.col("id").alias("event_key"), F.col("event_type_id").alias("event_type"),
        F.col("timestamp").alias("event_timestamp"), F.col("pid").alias("event_pid"),
        F.col("image").alias("event_image"), F.col("raw_json").alias("event_raw_json"))
    return one.join(named, F.col("event_fk") == F.col("event_key"), "left").drop("event_key")


# --- joins ----------------------------------------------------------------------------------

def hits_with_events(hits: DataFrame, events: DataFrame) -> DataFrame:
    """Hits beside their event's window key; a hit whose event is not there is dropped."""
    keys = events.select(F.col("id").alias("event_fk"), event_image().alias("image"), event_pid().alias("pid"))
    return hits.join(keys, "event_fk", "inner")


def rules_with_counts(rules: DataFrame, hits: DataFrame) -> DataFrame:
    """Every rule with its number of hits. Hits shrink to one row per rule before the join."""
    counts = hits.groupBy("rule_id").agg(F.count("*").alias("hit_count"))
    return rules.join(counts, "rule_id", "left").withColumn("hit_count", F.coalesce("hit_count", F.lit(0)))


def rules_without_hits(rules: DataFrame, hits: DataFrame) -> DataFrame:
    return rules.join(hits.groupBy("rule_id").count(), "rule_id", "left_anti")


def with_parent(events: DataFrame) -> DataFrame:
    """Process creations beside their parent's creation.

    A pid that is reused often would meet every reuse, so parents are first reduced to one row
    per pid, its oldest creation, as in the process tree.
    """
    made = events.filter((F.col("event_type_id") == 1) & F.col("process_id").isNotNull())
    first = made.groupBy("process_id").agg(
        F.min(F.struct("event_time", "id", "image")).alias("_first"))
    parents = first.select(
        F.col("process_id").alias("parent_process_id"), F.col("_first.id").alias("parent_event"),
        F.col("_first.image").alias("parent_event_image"))
    return made.join(parents, "parent_process_id", "left")


def recent_scores(scores: DataFrame, events: DataFrame, k: int = 20) -> DataFrame:
    """The newest scores with their event type.

    The newest keys come first: a few times ``k`` scores meet the events by broadcast, and only if orphans
    among them leave fewer than ``k`` rows, more are taken. Neither table is shuffled until so many orphans
    are met that their number is no longer small.
    """
    order = [F.col("event_fk").desc(), F.col("model_type").desc()]
    kinds = events.select(F.col("id").alias("event_fk"), "event_type_id")
    taken = 4 * k
    while taken <= MOST_CANDIDATES:
        newest = cut_lineage(scores.orderBy(*order).limit(taken))
        found = cut_lineage(F.broadcast(newest).join(kinds, "event_fk"))
        if found.count() >= k or newest.count() < taken:
            return found.orderBy(*order).limit(k)
        taken *= 16
    return scores.join(kinds, "event_fk").orderBy(*order).limit(k)


def orphans(children: DataFrame, events: DataFrame) -> DataFrame:
    """Rows whose event does not exist. Rows that name no event are not orphans."""
    keys = events.select(F.col("id").alias("event_fk"))
    return children.filter(F.col("event_fk").isNotNull()).join(keys, "event_fk", "left_anti")


def labelled(benign: DataFrame, suspicious: DataFrame) -> DataFrame:
    """Both sets with label 0 and 1; repeated rows stay."""
    return benign.withColumn("label", F.lit(0)).unionByName(suspicious.withColumn("label", F.lit(1)))
