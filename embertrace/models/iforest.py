"""Isolation Forest: trees grown in parallel from bounded samples, rows scored in Arrow batches.

Training looks at ``trees * sample`` rows at most, chosen from all rows by a seeded hash; each
tree is one group of ``sample`` rows. The model is a node table of at most
``trees * (2 * sample - 1)`` rows, so it is small enough to broadcast whatever the data size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T

from embertrace.models.permute import distinct, paired_rows
from embertrace.operators.features import FEATURES
from embertrace.session import cut_lineage

TREES, SAMPLE, SEED = 100, 256, 42  # fixed values: the usual forest defaults
NODE_SCHEMA = (
    "tree int, node int, feature int, threshold double, left_node int, right_node int, path double")


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points: the path still to go in a leaf of n."""
    n = np.asarray(n, dtype=float)
    big = np.where(n > 2, n, 3)
    far = 2.0 * (np.log(big - 1.0) + np.euler_gamma) - 2.0 * (big - 1.0) / big
    return np.where(n > 2, far, np.where(n == 2, 1.0, 0.0))


def grow(points: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes of one tree: split a random varying feature at a random point until alone or deep."""
    nodes: list[list] = []

    def add(rows: np.ndarray, depth: int) -> int:
        number = len(nodes)
        nodes.append([number, -1, 0.0, -1, -1, depth + float(average_path(len(rows)))])
        if depth >= limit or len(rows) <= 1:
            return number
        low, high = rows.min(axis=0), rows.max(axis=0)
        varying = np.flatnonzero(high > low)
        if not len(varying):
            return number
        feature = int(rng.choice(varying))
        cut = float(rng.uniform(low[feature], high[feature]))
        left = rows[:, feature] <= cut
        here = nodes[number]
        here[1], here[2] = feature, cut
        here[3] = add(rows[left], depth + 1)
        here[4] = add(rows[~left], depth + 1)
        return number

    add(points, 0)
    return [tuple(n) for n in nodes]


def draw_order(keys: list[str], seed: int) -> list[Column]:
    """Rows in the order of the md5 of seed and key, which any engine can repeat; keys settle ties."""
    texts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return [F.md5(F.concat_ws(":", F.lit(str(seed)), *texts)), *[F.col(k) for k in keys]]


def tree_samples(rows: DataFrame, keys: list[str], trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """``sample`` distinct rows per tree (all rows if there are fewer), tagged with ``tree``.

    The pool is the ``trees * sample`` lowest rows in draw order. Digests are uniform, so a bar at four times
    the pool's share leaves enough of them and drops all others where they are; should it not, that is an
    error. Tree t takes ``sample`` positions of the pool from ``t * sample`` on, starting over at its end.
    """
    wanted, total = trees * sample, rows.count()
    digest, *ties = draw_order(keys, seed)
    bar = f"{min(int(4 * wanted / max(total, 1) * 16**8), 16**8 - 1):08x}" + "g"  # above every digest that begins so
    pool = rows.withColumn("_draw", digest).filter(F.col("_draw") < F.lit(bar)).orderBy("_draw", *ties).limit(wanted)
    pool = cut_lineage(pool)  # at most trees * sample rows
    size = pool.count()
    if size < min(wanted, total):
        raise RuntimeError(f"the draw left {size} of {min(wanted, total)} rows: do the keys tell rows apart?")
    placed = pool.withColumn("_place", F.row_number().over(Window.orderBy("_draw", *ties)) - 1).drop("_draw")
    tree, step = F.floor(F.col("id") / sample).cast("int"), F.col("id") % sample
    picks = rows.sparkSession.range(trees * sample).filter(step < size).select(tree.alias("tree"), (F.col("id") % max(size, 1)).alias("_place"))
    return picks.join(placed, "_place").drop("_place")


class Scorer:
    """The node table as flat arrays; sent to the tasks once."""

    def __init__(self, nodes: pd.DataFrame, sample: int):
        nodes = nodes.sort_values(["tree", "node"])
        sizes = nodes.groupby("tree").size().to_numpy()
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        base = np.repeat(self.starts, sizes)
        self.feature = nodes["feature"].to_numpy()
        self.threshold = nodes["threshold"].to_numpy()
        self.left = nodes["left_node"].to_numpy() + base
        self.right = nodes["right_node"].to_numpy() + base
        self.path = nodes["path"].to_numpy()
        self.norm = float(average_path(sample)) or 1.0

    def paths(self, rows: np.ndarray, start: int, asked: np.ndarray | None = None) -> np.ndarray:
        """Path length of each row in the tree that begins at ``start``. ``asked`` (rows x features) is set where
        a row meets a node that asks for a feature. Rows in a leaf leave the walk."""
        node = np.full(len(rows), start)
        live = np.arange(len(rows))
        while len(live):
            at = node[live]
            feature = self.feature[at]
            inner = feature >= 0
            live, at, feature = live[inner], at[inner], feature[inner]
            if asked is not None:
                asked[live, feature] = True
            node[live] = np.where(rows[live, feature] <= self.threshold[at], self.left[at], self.right[at])
        return self.path[node]

    def rescored(self, total: np.ndarray) -> np.ndarray:
        return -np.exp2(-(total / len(self.starts)) / self.norm)

    def raw(self, points: np.ndarray) -> np.ndarray:
        """Score of each row, in (-1, 0); lower is more anomalous. Equal rows are scored once."""
        points = np.ascontiguousarray(points, dtype=float) + 0.0  # no negative zeros
        if not len(points):
            return np.zeros(0)
        rows, back = distinct(points)
        total = np.zeros(len(rows))
        for start in self.starts:
            total += self.paths(rows, start)
        return self.rescored(total)[back]

    def swapped_sums(self, own: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Per feature the summed change of the score when a row takes the feature from its partner.

        All trees walk the rows once and keep which features each row was asked for. A row whose partner has the
        same value does not change, nor does its path in a tree that did not ask it for the feature; only the
        other paths are walked again, and their difference moves the row's total.
        """
        rows, back = distinct(own)
        total = np.zeros(len(rows))
        lengths, asked = [], np.zeros((len(self.starts), *rows.shape), dtype=bool)
        for tree, start in enumerate(self.starts):
            lengths.append(self.paths(rows, start, asked[tree]))
            total += lengths[tree]
        base = self.rescored(total)
        sums = np.zeros(own.shape[1])
        for f in range(own.shape[1]):
            moved = np.flatnonzero(own[:, f] != other[:, f])
            if not len(moved):
                continue
            pairs, place = distinct(np.column_stack([back[moved], other[moved, f]]))  # a row and its new value
            origin = pairs[:, 0].astype(np.int64)
            variants = rows[origin]
            variants[:, f] = pairs[:, 1]
            changed = total[origin]
            for tree, start in enumerate(self.starts):
                again = np.flatnonzero(asked[tree, origin, f])
                if len(again):
                    changed[again] += self.paths(variants[again], start) - lengths[tree][origin[again]]
            sums[f] = (self.rescored(changed) - base[origin])[place].sum()
        return sums


@dataclass
class IsolationForest:
    nodes: DataFrame
    features: list[str]
    sample: int
    train_min: float
    train_max: float
    _shared: Any = field(default=None, repr=False)

    # --- fitting ---
    @classmethod
    def fit(cls, rows: DataFrame, keys: list[str], features: list[str] = FEATURES, trees: int = TREES,
            sample: int = SAMPLE, seed: int = SEED) -> IsolationForest:
        """``keys`` tell rows apart; they decide which rows a tree draws."""
        data = cut_lineage(rows.select(*keys, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features]))
        drawn = tree_samples(data, keys, trees, sample, seed).select("tree", *features)
        size = min(sample, data.limit(sample).count())
        limit = max(1, math.ceil(math.log2(max(size, 2))))

        def build(group: pd.DataFrame) -> pd.DataFrame:
            tree = int(group["tree"].iloc[0])
            points = group[features].to_numpy(float)
            points = points[np.lexsort(points.T[::-1])]  # the same tree whatever order rows come in
            grown = grow(points, np.random.default_rng([seed, tree]), limit)
            out = pd.DataFrame(grown, columns=["node", "feature", "threshold", "left_node", "right_node", "path"])
            out.insert(0, "tree", tree)
            return out

        nodes = cut_lineage(drawn.groupBy("tree").applyInPandas(build, NODE_SCHEMA))
        model = cls(nodes, list(features), size, 0.0, 0.0)
        return model.with_bounds(data)

    def with_bounds(self, training: DataFrame) -> IsolationForest:
        """Score range of the training rows; kept with the model, never taken from a batch."""
        low, high = self.raw(training, []).agg(F.min("raw"), F.max("raw")).first()
        return replace(self, train_min=low or 0.0, train_max=high or 0.0)

    def shared(self):
        """The node table on the executors: at most ``trees * (2 * sample - 1)`` rows, sent once per model."""
        if self._shared is None:
            self._shared = self.nodes.sparkSession.sparkContext.broadcast(Scorer(self.nodes.toPandas(), self.sample))
        return self._shared

    # --- scoring ---
    def raw(self, rows: DataFrame, keep: list[str], name: str = "raw") -> DataFrame:
        """The ``keep`` columns and the raw score. A missing feature, column or value, is 0.

        Arrow batches go through unchanged but for the score, which the shared node table gives.
        """
        shared = self.shared()
        names = [f"_x{i}" for i in range(len(self.features))]
        vector = [
            (F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in rows.columns else F.lit(0.0)).alias(x)
            for f, x in zip(self.features, names)]
        data = rows.select(*keep, *vector)
        schema = T.StructType([data.schema[c] for c in keep] + [T.StructField(name, T.DoubleType())])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                points = np.column_stack([batch.column(x).to_numpy(zero_copy_only=False) for x in names])
                kept = [batch.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(shared.value.raw(points))], names=[*keep, name])

        return data.mapInArrow(score, schema)

    def rescale(self, raw: Column) -> Column:
        """0..1, higher is more anomalous; outside the training range it is clipped."""
        span = self.train_max - self.train_min
        if span == 0:
            return F.when(raw.isNotNull(), F.lit(0.0))
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(self.train_max) - raw) / F.lit(span)))

    def score(self, rows: DataFrame, keep: list[str], name: str = "score") -> DataFrame:
        """The ``keep`` columns and the score in 0..1."""
        return self.raw(rows, keep, name).withColumn(name, self.rescale(F.col(name)))

    # --- reports ---
    def report(self, rows: DataFrame) -> DataFrame:
        s = F.col("s")
        return self.score(rows, [], "s").agg(
            F.min(s).alias("score_min"), F.max(s).alias("score_max"), F.avg(s).alias("score_mean"),
            F.stddev_pop(s).alias("score_std"), F.count_if(s > 0.5).alias("n_above_05"), F.count("*").alias("n_total"))

    def importance(self, rows: DataFrame, keys: list[str], repeats: int = 10, seed: int = SEED) -> DataFrame:
        """Mean change of the raw score when one feature is permuted, most negative first.

        Every row is scored with each feature in turn taken from its partner row, inside its Arrow batch
        (``Scorer.swapped_sums``); a task returns sums per feature, not rows.
        """
        names = self.features
        pairs = paired_rows(rows, keys, names, repeats, seed)
        shared = self.shared()

        def deltas(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    sums = shared.value.swapped_sums(np.stack(batch["own"].to_numpy()), np.stack(batch["other"].to_numpy()))
                    yield pd.DataFrame({"feature": names, "delta": sums, "n": len(batch)})

        parts = pairs.select("own", "other").mapInPandas(deltas, "feature string, delta double, n bigint")
        return parts.groupBy("feature").agg((F.sum("delta") / F.sum("n")).alias("mean_delta")).orderBy("mean_delta", "feature")

    # --- storage ---
    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        meta = self.nodes.sparkSession.createDataFrame(
            [(self.features, self.sample, self.train_min, self.train_max)],
            "features array<string>, sample int, train_score_min double, train_score_max double")
        meta.write.mode("overwrite").parquet(f"{path}/bounds")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IsolationForest:
        meta = spark.read.parquet(f"{path}/bounds").first()
        return cls(spark.read.parquet(f"{path}/nodes"), list(meta[0]), meta[1], meta[2], meta[3])

    def bounds(self) -> DataFrame:
        return self.nodes.sparkSession.createDataFrame(
            [(self.train_min, self.train_max)], "train_score_min double, train_score_max double")
