"""Checks on a rules table, as one pass of Columns: each row gets the list of its problems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embertrace.rules.model import FIELD_OPERATORS, LIST_OPERATORS, OPERATORS
from embertrace.schema import SEVERITIES

# What every rule must have.
REQUIRED = [
    "rule_id", "rule_name", "description", "mitre_technique", "mitre_tactic", "severity", "event_ids",
    "logic", "conditions",
]


def missing_keys() -> Column:
    absent = F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in REQUIRED])
    return F.array_sort(F.filter(absent, lambda k: k.isNotNull()))


def bad_enum() -> Column:
    operators_ok = F.forall("conditions", lambda c: F.coalesce(c["operator"].isin(sorted(OPERATORS)), F.lit(False)))
    return (
        F.when(~F.coalesce(F.col("severity").isin(SEVERITIES), F.lit(False)), "severity")
        .when(~F.coalesce(F.col("logic").isin("AND", "OR"), F.lit(False)), "logic")
        .when(~F.coalesce(operators_ok, F.lit(False)), "operator")
    )


def bad_event_ids() -> Column:
    ok = (F.size("event_ids") > 0) & F.forall("event_ids", lambda e: e.isNotNull())
    return ~F.coalesce(ok, F.lit(False))


def bad_operands() -> Column:
    """True if a condition lacks the operand its operator needs, or there is no condition."""

    def ok(c: Column) -> Column:
        op = c["operator"]
        named = F.coalesce(c["field"] != "", F.lit(False))
        operand = (
            F.when(op.isin(sorted(LIST_OPERATORS)), F.size(c["values"]) > 0)
            .when(op.isin(sorted(FIELD_OPERATORS)), c["reference_field"] != "")
            .otherwise(c["value"] != "")
        )
        return named & F.coalesce(operand, F.lit(False))

    return ~F.coalesce((F.size("conditions") > 0) & F.forall("conditions", ok), F.lit(False))


def checked(rules: DataFrame) -> DataFrame:
    """Rules plus ``problems``; an empty list means the rule is usable. Repeated ids are refused."""
    repeated = rules.groupBy("rule_id").count().filter("count > 1").select("rule_id", F.lit(True).alias("_repeated"))
    marked = rules.join(repeated, "rule_id", "left")
    problems = F.array(
        F.when(F.size(missing_keys()) > 0, F.concat(F.lit("missing keys: "), F.array_join(missing_keys(), ", "))),
        F.concat(F.lit("invalid "), bad_enum()),
        F.when(bad_event_ids(), F.lit("event_ids must be a non-empty list of ints")),
        F.when(bad_operands(), F.lit("a condition lacks its operand")),
        F.when(F.col("_repeated"), F.lit("repeated id")),
    )
    return marked.withColumn("problems", F.filter(problems, lambda p: p.isNotNull())).drop("_repeated")
