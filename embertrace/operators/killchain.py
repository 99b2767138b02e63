"""Kill-chain view: tactics in fixed order with the rules that fired for them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embertrace.operators.tables import in_range
from embertrace.rules import Rule, catalogue
from embertrace.schema import TACTICS


def tactics_frame(spark: SparkSession) -> DataFrame:
    rows = F.array(*[
        F.struct(F.lit(i).alias("tactic_id"), F.lit(n).alias("tactic_name"), F.lit(p).alias("display_order"))
        for p, (i, n) in enumerate(TACTICS, 1)])
    return spark.range(1).select(F.inline(rows))


def rules_frame(spark: SparkSession, rules: Sequence[Rule] | None = None) -> DataFrame:
    """The rule set as a frame, by id."""
    rules = catalogue() if rules is None else rules
    rows = [
        (r.id, r.name, r.description, r.severity, r.mitre_tactic, r.mitre_technique, list(r.event_ids), r.logic,
         [(c.field, c.operator, c.value, list(c.values), c.reference_field, c.allow_null) for c in r.conditions])
        for r in sorted(rules, key=lambda r: r.id)
    ]
    return spark.createDataFrame(
        rows,
        "rule_id string, rule_name string, description string, severity string, mitre_tactic string, "
        "mitre_technique string, event_ids array<int>, logic string, conditions array<struct<field: string, "
        "operator: string, value: string, `values`: array<string>, reference_field: string, allow_null: boolean>>",
    )


def tactic_map(rules: DataFrame) -> DataFrame:
    """Rule to tactic: by tactic name in any case or by tactic id; otherwise UNKNOWN."""
    tactics = tactics_frame(rules.sparkSession)
    wanted = F.trim(F.coalesce("mitre_tactic", F.lit("")))
    base = rules.select("rule_id", "rule_name", F.col("mitre_technique").alias("technique_id"), wanted.alias("_t"))
    by_name = tactics.select(F.lower("tactic_name").alias("_key"), "tactic_id", F.col("tactic_name").alias("_name"))
    by_id = tactics.select(F.col("tactic_id").alias("_id"), F.col("tactic_name").alias("_id_name"))
    joined = base.join(by_name, F.lower("_t") == F.col("_key"), "left").join(by_id, F.col("_t") == F.col("_id"), "left")
    unknown = F.when(F.col("_t") == "", F.lit("")).otherwise(F.lit("UNKNOWN"))
    return joined.select(
        "rule_id", "rule_name", "technique_id",
        F.coalesce("tactic_id", "_id", unknown).alias("tactic_id"),
        F.coalesce("_name", "_id_name", "_t").alias("tactic_name"))


def rule_hits_in_range(hits: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Hits shrink to one row per rule before anything is joined."""
    return in_range(hits, start, end).groupBy("rule_id").agg(
        F.count("*").alias("hit_count"), F.max("timestamp").alias("last_seen"))


def tactic_status(hits: DataFrame, mapping: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """All tactics in order: fired, hits, last seen, fired rules (by hits, then id), mapped rules."""
    fired = rule_hits_in_range(hits, start, end)
    per_rule = mapping.join(fired, "rule_id", "left")
    entry = F.struct(
        (-F.col("hit_count")).alias("order"), "rule_id", "rule_name", "technique_id", "hit_count", "last_seen")
    grouped = per_rule.groupBy("tactic_id").agg(
        F.coalesce(F.sum("hit_count"), F.lit(0)).alias("hit_count"),
        F.max("last_seen").alias("last_seen"),
        F.array_sort(F.collect_list(F.when(F.col("hit_count") > 0, entry))).alias("_fired"),
        F.count("*").alias("total_rules_mapped"),
        F.array_sort(F.collect_list("rule_id")).alias("all_rule_ids"),  # bounded by the rule set
    )
    return tactics_frame(hits.sparkSession).join(grouped, "tactic_id", "left").select(
        "tactic_id", "tactic_name", "display_order",
        (F.coalesce("hit_count", F.lit(0)) > 0).alias("fired"),
        F.coalesce("hit_count", F.lit(0)).alias("hit_count"),
        "last_seen",
        F.transform("_fired", lambda r: r.dropFields("order")).alias("fired_rules"),
        F.coalesce("total_rules_mapped", F.lit(0)).alias("total_rules_mapped"),
        F.coalesce("all_rule_ids", F.array().cast("array<string>")).alias("all_rule_ids"),
    ).orderBy("display_order")


def tactic_detail(hits: DataFrame, mapping: DataFrame, tactic_id: str, start: datetime, end: datetime) -> DataFrame:
    """Rules of one tactic that fired, most hits first; an unknown tactic has none."""
    known = tactic_id in dict(TACTICS)
    rules = mapping.filter((F.col("tactic_id") == tactic_id) & F.lit(known))
    return (
        rules.join(rule_hits_in_range(hits, start, end), "rule_id", "inner")
        .select("rule_id", "rule_name", "technique_id", "hit_count", "last_seen")
        .orderBy(F.desc("hit_count"), "rule_id")
    )


def tactics_fired(status: DataFrame) -> DataFrame:
    return status.agg(F.count_if("fired").alias("tactics_fired"), F.count("*").alias("tactics_total"))
