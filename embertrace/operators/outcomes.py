"""What became of exercised rules: labelled time spans met with hits, without pairing them.

Whoever exercises rules notes a span per session, rule and path (one way to set the rule off). Spans and hits
are laid on one line per rule and swept once: the hits before a span's end less those before its start are the
hits in it, and a hit at which no span is open was not planned. The cost is one range sort of spans and hits; a
hot rule is spread over tasks, and spans that overlap cost no more than others.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embertrace.session import cut_lineage

START, HIT, END = 0, 1, 2  # their order at one moment, so that both ends of a span belong to it
SPAN = ["session", "rule_id", "path", "start", "end", "blocked", "skipped"]


def running_totals(df: DataFrame, order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """The whole-number ``columns`` replaced by their sums up to and with each row, in the given order.

    Rows are range-sorted and written once, so that their layout is fixed. Each partition's sums, a row per
    partition, reach the driver; a task begins with the sum of earlier partitions and adds up batch by batch.
    """
    fixed = cut_lineage(df.orderBy(*order))
    sums = sorted(fixed.groupBy(F.spark_partition_id().alias("p")).agg(*[F.sum(c) for c in columns]).collect())
    before = {c: dict(zip([s[0] for s in sums], accumulate((s[i] for s in sums), initial=0))) for i, c in enumerate(columns, 1)}
    names, schema = fixed.columns, T.StructType(
        [T.StructField(f.name, T.LongType()) if f.name in columns else f for f in fixed.schema.fields])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        total = {c: before[c].get(part, 0) for c in columns}
        for batch in batches:
            if not batch.num_rows:
                continue
            arrays = dict(zip(names, batch.columns))
            for c in columns:
                summed = total[c] + np.cumsum(arrays[c].to_numpy(zero_copy_only=False).astype(np.int64))
                arrays[c], total[c] = pa.array(summed), int(summed[-1])
            yield pa.RecordBatch.from_arrays([arrays[n] for n in names], names=names)

    return fixed.mapInArrow(add, schema)


def sweep(spans: DataFrame, hits: DataFrame) -> DataFrame:
    """rule_id, at, kind, span, hit, n_hits, n_open: every end of a span and every hit in its rule's order of
    time, with the hits so far and the spans open there. Spans need ``span``, rule_id, start and end, hits need
    id, rule_id and timestamp; rows without rule or time, and spans that end before they begin, stay out."""
    able = spans.filter(F.col("rule_id").isNotNull() & (F.col("start") <= F.col("end")))
    none = F.lit(None)
    ends = [
        able.select("rule_id", F.col(c).alias("at"), F.lit(kind).alias("kind"), "span", none.cast("string").alias("hit"))
        for c, kind in (("start", START), ("end", END))]
    points = hits.filter(F.col("rule_id").isNotNull() & F.col("timestamp").isNotNull()).select(
        "rule_id", F.col("timestamp").alias("at"), F.lit(HIT).alias("kind"), none.cast("bigint").alias("span"),
        F.col("id").cast("string").alias("hit"))
    line = ends[0].unionByName(ends[1]).unionByName(points).withColumns({
        "n_hits": (F.col("kind") == HIT).cast("bigint"), "n_open": (F.lit(1) - F.col("kind")).cast("bigint")})
    return running_totals(line, [F.col(c) for c in ("rule_id", "at", "kind", "span", "hit")], ["n_hits", "n_open"])


def hits_in_spans(spans: DataFrame, hits: DataFrame) -> DataFrame:
    """Each span with ``n_hits``, the hits of its rule from start to end, both included. A span without a rule
    or an end, or that ends before it begins, has none. Spans keep their other columns and repeated rows; a
    column named ``span`` or ``n_hits`` is refused."""
    clash = {"span", "n_hits"} & set(spans.columns)
    if clash:
        raise ValueError(f"spans have columns {sorted(clash)} of the result")
    numbered = cut_lineage(spans.withColumn("span", F.monotonically_increasing_id()))
    first, last = numbered.agg(F.min("start"), F.max("end")).first()
    near = hits.filter(F.col("timestamp").between(F.lit(first), F.lit(last)))  # reaches the scan of stored hits
    at_ends = sweep(numbered, near).filter(F.col("kind") != HIT)
    sign = F.when(F.col("kind") == END, 1).otherwise(-1)
    counts = at_ends.groupBy("span").agg(F.sum(sign * F.col("n_hits")).alias("n_hits"))
    return numbered.join(counts, "span", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0).cast("bigint"))).drop("span")


def path_outcomes(paths: DataFrame, hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Spans (session, rule_id, path, start, end, blocked, skipped) with ``n_hits`` and ``outcome``.

    SKIP where the path was skipped or its rule is not in ``rules``; PASS with a hit; PARTIAL without one where
    the host is known to stop the attempt before it leaves an event; FAIL otherwise. Null flags are false.
    """
    live = rules.select("rule_id").distinct().withColumn("_live", F.lit(True))
    counted = hits_in_spans(paths, hits).join(live, "rule_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    outcome = (
        F.when(yes("skipped") | ~yes("_live"), "SKIP").when(F.col("n_hits") > 0, "PASS")
        .when(yes("blocked"), "PARTIAL").otherwise("FAIL"))
    return counted.withColumn("outcome", outcome).drop("_live")


def rule_outcomes(paths: DataFrame) -> DataFrame:
    """session, rule_id, n_paths, n_hits, n_pass, n_partial, n_fail, n_skip, outcome from path outcomes.

    SKIP if all paths are skipped; PASS if all others pass; FAIL if all others fail; PARTIAL in between.
    Spans may overlap, so a hit can count for more than one path.
    """
    n = {o: F.count_if(F.col("outcome") == o.upper()).alias(f"n_{o}") for o in ("pass", "partial", "fail", "skip")}
    grouped = paths.groupBy("session", "rule_id").agg(F.count("*").alias("n_paths"), F.sum("n_hits").alias("n_hits"), *n.values())
    ran = F.col("n_paths") - F.col("n_skip")
    return grouped.withColumn("outcome", F.when(ran == 0, "SKIP").when(F.col("n_pass") == ran, "PASS").when(
        F.col("n_fail") == ran, "FAIL").otherwise("PARTIAL"))


def unplanned_hits(paths: DataFrame, hits: DataFrame) -> DataFrame:
    """rule_id, timestamp, id of the hits that lie in no span of their rule: what to leave out of labelled
    rows. Hits without a rule or a time are not placed anywhere and not returned."""
    spans = cut_lineage(paths.select("rule_id", "start", "end").distinct()).withColumn("span", F.monotonically_increasing_id())
    return sweep(spans, hits).filter((F.col("kind") == HIT) & (F.col("n_open") == 0)).select(
        "rule_id", F.col("at").alias("timestamp"), F.col("hit").alias("id"))
