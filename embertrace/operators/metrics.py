"""Time-ranged summaries. All are hash aggregations with partial and final stages; levels and
buckets that must show zero come from small fixed frames joined after the aggregation."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embertrace.functions.clock import as_utc, lit_time, timeline_step
from embertrace.operators.tables import in_range
from embertrace.schema import MODEL_TYPES, SEVERITIES
from embertrace.session import cut_lineage


def _levels(spark, values: list[str], name: str) -> DataFrame:
    """A one-column frame of fixed values."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name))


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity), F.lit(0))


def stats(alerts: DataFrame, events: DataFrame, hits: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """One row: alerts, events, hits, distinct rules, and alerts per severity.

    Each table is reduced to one row first; the three rows are then folded, not joined.
    """
    names = ["total_alerts", "total_events", "total_rule_hits", "rules_fired", *[f"severity_{s.lower()}" for s in SEVERITIES]]
    a = in_range(alerts, start, end).agg(
        F.count("*").alias("total_alerts"),
        *[F.count_if(F.col("severity") == s).alias(f"severity_{s.lower()}") for s in SEVERITIES])
    e = in_range(events, start, end).agg(F.count("*").alias("total_events"))
    h = in_range(hits, start, end).groupBy("rule_id").count().agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_rule_hits"), F.count("rule_id").alias("rules_fired"))
    rows = a.unionByName(e, allowMissingColumns=True).unionByName(h, allowMissingColumns=True)
    return rows.agg(*[F.max(n).alias(n) for n in names])


def severity_distribution(alerts: DataFrame, start: datetime, end: datetime) -> DataFrame:
    counts = in_range(alerts, start, end).groupBy("severity").agg(F.count("*").alias("n"))
    levels = _levels(alerts.sparkSession, SEVERITIES, "severity")
    return levels.join(counts, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def timeline(alerts: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Alerts per step from the start of the range (not the clock), zero where there are none.

    Buckets start while start <= end, so a row exactly at the end can have a bucket of its own.
    """
    start, end = as_utc(start), as_utc(end)
    label, step = timeline_step(start, end)
    micros = int(step.total_seconds() * 1_000_000)
    last = (end - start) // step
    index = F.floor((F.unix_micros("timestamp") - F.unix_micros(lit_time(start))) / micros)
    counts = in_range(alerts, start, end).groupBy(index.alias("bucket_index")).agg(F.count("*").alias("n"))
    buckets = alerts.sparkSession.range(last + 1).withColumnRenamed("id", "bucket_index")
    return buckets.join(counts, "bucket_index", "left").select(
        F.timestamp_micros(F.unix_micros(lit_time(start)) + F.col("bucket_index") * micros).alias("bucket"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.lit(label).alias("interval"),
    )


def top_rules(hits: DataFrame, start: datetime | None, end: datetime | None, limit: int | None = 10) -> DataFrame:
    """Most frequent rules with the highest severity seen; an unknown severity ranks below Low. Without a
    limit, all rules."""
    rank = F.greatest(F.max(severity_rank(F.col("severity"))), F.lit(1))
    names = F.array(*[F.lit(s) for s in SEVERITIES])
    ranked = (
        in_range(hits, start, end)
        .groupBy("rule_id", "rule_name")
        .agg(F.count("*").alias("hit_count"), F.element_at(names, rank.cast("int")).alias("top_severity"))
        .orderBy(F.desc("hit_count"), "rule_id", "rule_name")
    )
    return ranked if limit is None else ranked.limit(max(0, limit))


def hits_per_rule_since(hits: DataFrame, moment: datetime) -> DataFrame:
    return hits.filter(F.col("timestamp") >= lit_time(moment)).groupBy("rule_id").agg(F.count("*").alias("hit_count"))


def hit_span(hits: DataFrame, prefix: str, moment: datetime) -> DataFrame:
    """First and last hit of the rules with an id prefix since a moment."""
    chosen = hits.filter(F.startswith(F.col("rule_id"), F.lit(prefix)) & (F.col("timestamp") >= lit_time(moment)))
    return chosen.agg(F.min("timestamp").alias("first_hit"), F.max("timestamp").alias("last_hit"))


def hit_band(count: Column) -> Column:
    """Fixed bands of hit counts."""
    return (
        F.when(count <= 0, "0").when(count <= 5, "1-5").when(count <= 20, "6-20").otherwise(">20")
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# --- scores ---------------------------------------------------------------------------------

# Ten equal brackets; the last one includes 1.0.
SCORE_BOUNDS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


def score_bin(score: Column) -> Column:
    """0..9 by comparing with the literal bounds, so no value lands beside its bracket."""
    out = F.lit(0)
    for bound in SCORE_BOUNDS:
        out = out + (score >= F.lit(bound)).cast("int")
    return out


def exact_median(df: DataFrame, keys: list[str], value: str, grid: int = 1 << 16) -> DataFrame:
    """Median per key of values in [0, 1], interpolated, at any row count.

    A plain median keeps every distinct value of a key in one buffer. Here two counting passes
    over ``grid`` bins each close in on the bin of the middle rows, and only the distinct values of
    a 1/grid^2 wide bin are ranked. Both passes pre-aggregate, so a hot key or value is harmless. The
    first pass gives the counts per key as well, and each pass's few ranks are stored before the next reads
    the rows, so the rows are read three times in all.
    """
    data = df.select(
        *keys, F.col(value).alias("_v"),
        F.floor(F.col(value) * grid).alias("_b1"),
        F.floor(F.col(value) * grid * grid).alias("_b2"),
    ).filter(F.col("_v").isNotNull())
    by_bin = cut_lineage(data.groupBy(*keys, "_b1").agg(F.count("*").alias("_c")))
    totals = by_bin.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    wanted = totals.select(
        *keys, F.explode(F.array(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2))).alias("_rank")).distinct()

    def narrow(ranks: DataFrame, counts: DataFrame, inside: list[str], by: str) -> DataFrame:
        """For each wanted rank: the ``by`` it falls on, and the rank left within it."""
        order = Window.partitionBy(*keys, *inside).orderBy(by)
        running = counts.withColumn("_end", F.sum("_c").over(order)).withColumn("_start", F.col("_end") - F.col("_c"))
        hit = running.join(ranks, [*keys, *inside]).filter(
            (F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_end")))
        return hit.select(*keys, by, "_first_rank", (F.col("_rank") - F.col("_start")).alias("_rank"))

    ranks = wanted.withColumn("_first_rank", F.col("_rank"))
    for inside, by in (([], "_b1"), (["_b1"], "_b2"), (["_b2"], "_v")):
        if inside:
            rows = data.join(ranks.select(*keys, *inside).distinct(), [*keys, *inside], "left_semi")
            counts = rows.groupBy(*keys, *inside, by).agg(F.count("*").alias("_c"))
        else:
            counts = by_bin
        ranks = cut_lineage(narrow(ranks, counts, inside, by))
    return ranks.groupBy(*keys).agg(F.avg("_v").alias("median"))


def score_summary(scores: DataFrame) -> DataFrame:
    """Per model: trained flag, count, min, max, mean, median (unrounded; NULL without rows)."""
    plain = scores.groupBy("model_type").agg(
        F.count("*").alias("total_scored"), F.min("score").alias("score_min"),
        F.max("score").alias("score_max"), F.avg("score").alias("score_mean"))
    middle = exact_median(scores, ["model_type"], "score").withColumnRenamed("median", "score_median")
    models = _levels(scores.sparkSession, MODEL_TYPES, "model_type")
    out = models.join(plain, "model_type", "left").join(middle, "model_type", "left")
    total = F.coalesce("total_scored", F.lit(0))
    return out.withColumns({"total_scored": total, "trained": total > 0})


def score_bins(scores: DataFrame, model: str) -> DataFrame:
    """Count and percent per bracket, zero filled when the model has any score."""
    own = scores.filter(F.col("model_type") == model)
    counts = own.groupBy(score_bin(F.col("score")).alias("bin")).agg(F.count("*").alias("n"))
    bins = scores.sparkSession.range(10).select(F.col("id").cast("int").alias("bin"))
    filled = bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # over ten rows
    return filled.withColumn("_total", total).filter("_total > 0").select(
        "bin", "n", (F.lit(100.0) * F.col("n") / F.col("_total")).alias("pct"))


def score_trend(scores: DataFrame, now: datetime, hours: int = 24, model: str = "isolation_forest") -> DataFrame:
    """Mean score per clock hour over the last hours; hours without rows are left out."""
    since = F.timestamp_micros(F.unix_micros(lit_time(now)) - F.lit(hours).cast("bigint") * 3_600_000_000)
    own = scores.filter((F.col("model_type") == model) & (F.col("timestamp") >= since))
    return own.groupBy(F.date_trunc("hour", "timestamp").alias("hour")).agg(
        F.avg("score").alias("avg_score"), F.count("*").alias("n")).orderBy("hour")


def model_status(scores: DataFrame) -> DataFrame:
    counts = scores.groupBy("model_type").agg(F.count("*").alias("scored_events"))
    models = _levels(scores.sparkSession, MODEL_TYPES, "model_type")
    n = F.coalesce("scored_events", F.lit(0))
    return models.join(counts, "model_type", "left").select(
        "model_type", (n > 0).alias("trained"), n.alias("scored_events"))


def activation(vectors: DataFrame, features: list[str]) -> DataFrame:
    """Share of rows with each binary feature set, one row per feature."""
    wide = vectors.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in features])
    return wide.unpivot([], features, "feature", "share")


def score_groups(scores: DataFrame, key: str) -> DataFrame:
    """Score distribution per group, with the shares above 0.5 and 0.3."""
    s = F.col("score")
    return scores.groupBy(key).agg(
        F.count("*").alias("n"), F.min(s).alias("score_min"), F.max(s).alias("score_max"),
        F.avg(s).alias("score_mean"),
        F.avg((s > 0.5).cast("double")).alias("share_above_05"),
        F.avg((s > 0.3).cast("double")).alias("share_above_03"))


def sample_per_type(events: DataFrame, k: int = 200, seed: int = 42) -> DataFrame:
    """Up to ``k`` events per type in an order fixed by a seeded hash.

    Spark keeps only the best ``k`` per type in each task before the shuffle, so a type holding
    most rows costs no more than the others.
    """
    lot = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    order = Window.partitionBy("event_type_id").orderBy(lot, "id")
    return events.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= k).drop("_place")
