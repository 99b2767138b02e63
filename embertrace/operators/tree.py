"""Process tree: nodes, edges, roots, and the depth and root of every node."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embertrace.operators.tables import in_range, recent
from embertrace.session import cut_lineage


def nodes(events: DataFrame, start: datetime | None, end: datetime | None, cap: int | None = None) -> DataFrame:
    """One node per pid from all creations in range, or from the newest ``cap`` of them where a cap is asked for.

    Of several creations with one pid the oldest counts. Rows without a pid are skipped, after
    the cap.
    """
    made = in_range(events.filter(F.col("event_type_id") == 1), start, end, "event_time")
    if cap is not None:
        made = recent(made, cap, "event_time")
    first = F.min(F.struct("event_time", "id", "image", "command_line", "parent_process_id"))
    return (
        made.filter(F.col("process_id").isNotNull())
        .groupBy(F.col("process_id").alias("pid"))
        .agg(first.alias("n"))
        .select("pid", F.col("n.parent_process_id").alias("parent_pid"), "n.image", "n.command_line",
                F.col("n.event_time").alias("timestamp"))
    )


def edges(tree: DataFrame) -> DataFrame:
    """Parent and child pids where both are nodes."""
    parents = tree.select(F.col("pid").alias("parent_pid"))
    return tree.select("pid", "parent_pid").join(parents, "parent_pid", "left_semi").select("parent_pid", "pid")


def roots(tree: DataFrame) -> DataFrame:
    """Nodes whose parent is not a node."""
    parents = tree.select(F.col("pid").alias("parent_pid"))
    return tree.join(parents, "parent_pid", "left_anti").select(*tree.columns)


def paths(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pid, root_pid, depth) of every node below a root, and the pids in or below a cycle.

    Pointer doubling: after round k a node knows its ancestor 2^k steps up, so a tree of depth d
    takes log2(d) joins. Nodes that reached a root leave the join, which also takes the most popular
    ancestors out of it. A round that finishes nobody leaves only cycles: had an unfinished node a
    root at all, one of its ancestors would have finished in that round.
    """
    top = roots(tree).select("pid")
    done = cut_lineage(top.select("pid", F.col("pid").alias("up"), F.lit(0).cast("bigint").alias("steps")))
    rest = tree.join(top, "pid", "left_anti")
    active = cut_lineage(rest.select("pid", F.col("parent_pid").alias("up"), F.lit(1).cast("bigint").alias("steps")))
    left = active.count()
    while left:
        known = done.withColumn("_done", F.lit(True)).unionByName(active.withColumn("_done", F.lit(False)))
        above = known.select(
            F.col("pid").alias("up"), F.col("up").alias("_up"), F.col("steps").alias("_steps"), "_done")
        moved = cut_lineage(active.join(above, "up").select(
            "pid", F.col("_up").alias("up"), (F.col("steps") + F.col("_steps")).alias("steps"), "_done"))
        done = cut_lineage(done.unionByName(moved.filter("_done").drop("_done")))
        active = moved.filter("NOT _done").drop("_done")
        before, left = left, active.count()
        if left == before:
            break
    return (
        done.select("pid", F.col("up").alias("root_pid"), F.col("steps").alias("depth")),
        active.select("pid"),
    )
