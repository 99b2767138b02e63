"""As-of join: for each row the latest of the other side's rows that is not later."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_before(rows: DataFrame, marks: DataFrame, keys: list[str], width: int, strict: bool = False) -> DataFrame:
    """``rows`` (keys, at, ...) with ``found``: of the ``marks`` (keys, at, mark) of the same keys the ``mark``
    of the latest with ``at`` not after the row's (before it, if ``strict``), null if there is none. Of marks
    of one time the greatest counts. ``at`` is a whole number, ``mark`` is orderable and not null; null keys
    are keys like others. Rows stay as they are, repeated ones too.

    Both sides meet by keys and stretch of ``width``, so a key of very many rows is spread over its stretches.
    What a stretch takes over from before it comes from the last mark of each stretch alone.
    """
    stretch = F.floor(F.col("at") / F.lit(width))
    names = rows.columns
    held = F.struct(*(F.col(f"`{c}`") for c in names))
    left = rows.select(*keys, "at", stretch.alias("_stretch"), F.lit(0 if strict else 1).alias("_kind"), F.lit(None).cast(marks.schema["mark"].dataType).alias("mark"), held.alias("_row"))
    right = marks.select(*keys, "at", stretch.alias("_stretch"), F.lit(1 if strict else 0).alias("_kind"), "mark", F.lit(None).cast(left.schema["_row"].dataType).alias("_row"))
    last = marks.groupBy(*keys, stretch.alias("_stretch")).agg(F.max(F.struct("at", "mark")).alias("_last"))
    empty = left.select(*keys, "_stretch", F.lit(None).cast(last.schema["_last"].dataType).alias("_last")).distinct()
    places = last.unionByName(empty).groupBy(*keys, "_stretch").agg(F.max("_last").alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = places.select(*(F.col(c).alias(f"{c}_") for c in [*keys, "_stretch"]), F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    inside = Window.partitionBy(*keys, "_stretch").orderBy("at", "_kind", "mark").rowsBetween(Window.unboundedPreceding, 0)
    met = left.unionByName(right).withColumn("_inside", F.last("mark", ignorenulls=True).over(inside)).where("_row IS NOT NULL")
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"{c}_")) for c in [*keys, "_stretch"]))
    out = met.join(carried, same, "left")
    return out.select(*(F.col(f"_row.`{c}`").alias(c) for c in names), F.coalesce("_inside", "_carried.mark").alias("found"))
