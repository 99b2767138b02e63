"""A fitted Random Forest as a node table: stored, joined in SQL, and walked in Arrow batches.

MLlib grows the trees; this reads them back as rows and scores with flat arrays. One batch answers many
variants of its rows, which permutation importance needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embertrace.models.permute import distinct, paired_rows
from embertrace.session import cut_lineage, remove, shared_dir

MOST_NODES = 20_000_000  # of a forest that is sent to the tasks: 32 bytes each


class TooManyNodes(ValueError):
    """The forest is too large to be sent to every task as arrays."""


class Walker:
    """The node table as flat arrays. A leaf has feature -1."""

    def __init__(self, nodes: pd.DataFrame):
        nodes = nodes.sort_values(["tree", "node"])
        sizes = nodes.groupby("tree").size().to_numpy()
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        base = np.repeat(self.starts, sizes)
        self.feature = nodes["feature"].to_numpy(np.int32)
        self.threshold = nodes["threshold"].to_numpy(float)
        self.left = (nodes["left_node"].to_numpy() + base).astype(np.int32)
        self.right = (nodes["right_node"].to_numpy() + base).astype(np.int32)
        self.share = nodes["share"].to_numpy(float)
        ends = np.append(self.starts[1:], len(nodes))
        self.asks = [set(self.feature[a:b].tolist()) - {-1} for a, b in zip(self.starts, ends)]

    def votes(self, points: np.ndarray, tree: int) -> np.ndarray:
        """Share of label 1 in the leaf of ``tree`` that each row reaches. Rows in a leaf leave the walk."""
        node = np.full(len(points), self.starts[tree], dtype=np.int32)
        live = np.arange(len(points))
        while len(live):
            at = node[live]
            feature = self.feature[at]
            inner = feature >= 0
            live, at, feature = live[inner], at[inner], feature[inner]
            goes_left = points[live, feature] <= self.threshold[at]
            node[live] = np.where(goes_left, self.left[at], self.right[at])
        return self.share[node]

    def probability(self, points: np.ndarray) -> np.ndarray:
        """Mean vote of all trees. Equal rows are walked once."""
        rows, back = distinct(points)
        total = np.zeros(len(rows))
        for tree in range(len(self.starts)):
            total += self.votes(rows, tree)
        return (total / len(self.starts))[back]

    def swapped_sums(self, own: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Per feature the summed change of the probability when a row takes the feature from its partner.

        A row whose partner has the same value does not change, nor does the vote of a tree that never
        asks for the feature; neither is walked.
        """
        sums = np.zeros(own.shape[1])
        for f in range(own.shape[1]):
            moved = np.flatnonzero(own[:, f] != other[:, f])
            trees = [t for t, asks in enumerate(self.asks) if f in asks]
            if not len(moved) or not trees:
                continue
            before = own[moved]
            after = before.copy()
            after[:, f] = other[moved, f]
            rows, back = distinct(np.concatenate([before, after]))
            total = np.zeros(len(rows))
            for tree in trees:
                total += self.votes(rows, tree)
            scores = total[back]
            sums[f] = (scores[len(moved):] - scores[:len(moved)]).sum() / len(self.starts)
        return sums


@dataclass
class FlatForest:
    """tree, node, feature, threshold, left_node, right_node, share: a row per node, ``share`` being the
    share of label 1 among the training weights that reached it."""

    nodes: DataFrame
    features: list[str]
    _shared: Any = field(default=None, repr=False)

    @classmethod
    def of(cls, model: PipelineModel) -> FlatForest:
        """The node table of an assembler and forest fitted by MLlib, read from its stored form."""
        features, forest = model.stages[0].getInputCols(), model.stages[1]
        if forest.totalNumNodes > MOST_NODES:
            raise TooManyNodes(f"the forest has {forest.totalNumNodes} nodes, over {MOST_NODES}")
        spark = SparkSession.active()
        path = f"{shared_dir(spark)}/forest-{forest.uid}"
        forest.write().overwrite().save(path)
        n, stats, split = F.col("nodeData"), F.col("nodeData.impurityStats"), F.col("nodeData.split")
        leaf = n.leftChild < 0
        nodes = spark.read.parquet(f"{path}/data").select(
            F.col("treeID").alias("tree"), n.id.alias("node"),
            F.when(leaf, -1).otherwise(split.featureIndex).alias("feature"),
            F.when(leaf, 0.0).otherwise(F.get(split.leftCategoriesOrThreshold, F.lit(0))).alias("threshold"),
            n.leftChild.alias("left_node"), n.rightChild.alias("right_node"),
            F.coalesce(F.get(stats, F.lit(1)) / F.aggregate(stats, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)).alias("share"))
        nodes = cut_lineage(nodes)
        remove(spark, path)
        return cls(nodes, list(features))

    def shared(self):
        """The node table on the executors, at most ``MOST_NODES`` rows, sent once per model."""
        if self._shared is None:
            self._shared = self.nodes.sparkSession.sparkContext.broadcast(Walker(self.nodes.toPandas()))
        return self._shared

    def score(self, rows: DataFrame, keep: list[str], name: str = "rf_score") -> DataFrame:
        """The ``keep`` columns and P(suspicious). A missing feature, column or value, is 0."""
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
                yield pa.RecordBatch.from_arrays([*kept, pa.array(shared.value.probability(points))], names=[*keep, name])

        return data.mapInArrow(score, schema)

    def importance(self, rows: DataFrame, keys: list[str], repeats: int, seed: int) -> DataFrame:
        """Mean change of P(suspicious) when one feature is permuted, largest first. A task returns a sum
        per feature and batch; no variant of a row leaves it."""
        shared, names = self.shared(), self.features
        pairs = paired_rows(rows, keys, names, repeats, seed).select("own", "other")

        def deltas(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    sums = shared.value.swapped_sums(np.stack(batch["own"].to_numpy()), np.stack(batch["other"].to_numpy()))
                    yield pd.DataFrame({"feature": names, "delta": sums, "n": len(batch)})

        parts = pairs.mapInPandas(deltas, "feature string, delta double, n bigint")
        return parts.groupBy("feature").agg((F.sum("delta") / F.sum("n")).alias("mean_delta")).orderBy(F.desc("mean_delta"), "feature")

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.nodes.sparkSession.createDataFrame([(self.features,)], "features array<string>").write.mode("overwrite").parquet(f"{path}/features")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FlatForest:
        return cls(spark.read.parquet(f"{path}/nodes"), list(spark.read.parquet(f"{path}/features").first()[0]))
