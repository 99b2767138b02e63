"""Random Forest on MLlib: balanced weights, stratified cross-validation, importance, scoring."""

from __future__ import annotations

import json
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embertrace.models.flat_forest import MOST_NODES, FlatForest
from embertrace.models.permute import paired_rows
from embertrace.operators.features import FOREST_FEATURES
from embertrace.operators.tables import number_rows
from embertrace.session import cut_lineage

TREES, SEED, FOLDS = 100, 42, 5  # fixed values
DEPTH = 30  # trees are meant to grow out; MLlib stops at 30
FITS = 3  # folds fitted at once: MLlib keeps the bagged rows of each in the executors' memory


def require_columns(df: DataFrame, columns: list[str]) -> None:
    missing = sorted(c for c in columns if c not in df.columns)
    if missing:
        raise ValueError(f"the training rows have no columns {missing}")


def balanced(rows: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``weight`` = n / (2 * n_label)."""
    other = rows.filter(F.col(label).isNull() | ~F.col(label).isin(0, 1)).limit(1).count()
    if other:
        raise ValueError(f"{label} must be 0 or 1 in every row")
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # two rows
    n, weight = sum(counts.values()), F.lit(1.0)
    for value, count in counts.items():
        weight = F.when(F.col(label) == value, F.lit(n / (len(counts) * count))).otherwise(weight)
    return rows.withColumn("weight", weight)


def assembled(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")


def classifier(trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed)


def train(rows: DataFrame, features: list[str] = FOREST_FEATURES, trees: int = TREES, depth: int = DEPTH,
          seed: int = SEED) -> PipelineModel:
    require_columns(rows, [*features, "label"])
    return Pipeline(stages=[assembled(features), classifier(trees, depth, seed)]).fit(balanced(filled(rows, features)))


def filled(rows: DataFrame, features: list[str]) -> DataFrame:
    """A missing feature, column or value, is 0."""
    present = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features if f in rows.columns}
    return rows.withColumns(present | {f: F.lit(0.0) for f in features if f not in rows.columns})


def suspicious_probability() -> Column:
    return F.get(vector_to_array("probability"), F.lit(1))


def score(model: PipelineModel, rows: DataFrame, name: str = "rf_score") -> DataFrame:
    """Rows plus P(suspicious)."""
    features = model.stages[0].getInputCols()
    kept = filled(rows, features)
    scored = model.transform(kept).withColumn(name, suspicious_probability())
    return scored.select(*[c for c in kept.columns if c in rows.columns], name)


def with_folds(rows: DataFrame, keys: list[str], folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Adds ``fold``, equal shares of each label. Numbering by (label, hash) does it for any label
    size without gathering a label in one task."""
    order = [F.col("label"), F.xxhash64(F.lit(seed), *keys), *[F.col(k) for k in keys]]
    return number_rows(rows, order, "_n").withColumn("fold", (F.col("_n") % folds).cast("int")).drop("_n")


def cross_validate(rows: DataFrame, keys: list[str], features: list[str] = FOREST_FEATURES, folds: int = FOLDS,
                   **options) -> DataFrame:
    """fold, precision, recall, f1, roc_auc: one row per fold.

    Vectors are assembled once: a fit reads its rows six times before the first level. ``FITS`` folds are
    fitted side by side: between two levels of its forest a fit leaves the executors idle, and another's tasks
    run meanwhile.
    """
    spark = rows.sparkSession
    vectors = assembled(features).transform(filled(rows, features)).select(*keys, "label", "features")
    data = cut_lineage(with_folds(vectors, keys, folds))

    def tested(fold: int) -> tuple:
        model = classifier(**options).fit(balanced(data.filter(F.col("fold") != fold)))
        return fold, *held_out_metrics(model, data.filter(F.col("fold") == fold))

    with ThreadPool(min(FITS, folds)) as pool:
        out = pool.map(inheritable_thread_target(spark)(tested), range(folds), chunksize=1)
    return spark.createDataFrame(out, "fold int, precision double, recall double, f1 double, roc_auc double")


def held_out_metrics(model: RandomForestClassificationModel, rows: DataFrame) -> tuple[float, float, float, float]:
    """precision, recall, f1, roc_auc. The rows are scored once for all four."""
    scored = model.transform(rows).select("label", "prediction", "probability").persist()
    try:
        hit, said = F.col("label") == 1, F.col("prediction") == 1
        tp, fp, fn = scored.agg(F.count_if(hit & said), F.count_if(~hit & said), F.count_if(hit & ~said)).first()
        precision = tp / (tp + fp) if tp + fp else 0.0
        recall = tp / (tp + fn) if tp + fn else 0.0
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        auc = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="probability", metricName="areaUnderROC")
        return precision, recall, f1, float(auc.evaluate(scored))
    finally:
        scored.unpersist()


def importance(model: PipelineModel, rows: DataFrame, keys: list[str], repeats: int = 10, seed: int = SEED) -> DataFrame:
    """Mean change of P(suspicious) when one feature is permuted, largest first.

    The variants of a row are scored inside its Arrow batch by the node table. A forest that is too large to
    be sent as one goes through MLlib, a row per variant, with the same result.
    """
    if model.stages[1].totalNumNodes <= MOST_NODES:
        return FlatForest.of(model).importance(rows, keys, repeats, seed)
    return importance_by_rows(model, rows, keys, repeats, seed)


def importance_by_rows(model: PipelineModel, rows: DataFrame, keys: list[str], repeats: int, seed: int) -> DataFrame:
    """Each paired row becomes one variant per feature inside its own task; nothing but the sums is shuffled
    after the pairing join."""
    features, forest = model.stages[0].getInputCols(), model.stages[1]
    pairs = paired_rows(rows, keys, features, repeats, seed)
    swapped = pairs.select(
        "own", "other", F.explode(F.sequence(F.lit(-1), F.lit(len(features) - 1))).alias("f"))
    vector = F.transform("own", lambda x, i: F.when(i == F.col("f"), F.get("other", i)).otherwise(x))
    scored = forest.transform(swapped.select("f", array_to_vector(vector).alias("features")))
    means = scored.groupBy("f").agg(F.avg(suspicious_probability()).alias("m"))
    names = F.array(*[F.lit(n) for n in features])
    based = means.withColumn("base", F.max(F.when(F.col("f") == -1, F.col("m"))).over(Window.partitionBy()))  # a row per feature
    return based.filter("f >= 0").select(F.get(names, F.col("f")).alias("feature"), (F.col("m") - F.col("base")).alias("mean_delta")).orderBy(
        F.desc("mean_delta"), "feature")


def metrics_json(rows: DataFrame, folds: DataFrame, ranked: DataFrame, features: list[str] = FOREST_FEATURES) -> str:
    """Counts, per-fold values with mean and spread, and importances: tens of numbers in all."""
    counts = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    table = folds.orderBy("fold").toPandas()
    results = {
        m: {"mean": float(table[m].mean()), "std": float(table[m].std(ddof=0)), "per_fold": [float(v) for v in table[m]]}
        for m in ("precision", "recall", "f1", "roc_auc")
    }
    return json.dumps({
        "n_benign": counts.get(0, 0), "n_suspicious": counts.get(1, 0), "n_total": sum(counts.values()),
        "feature_set": list(features), "dropped_features": ["open_process_suspicious_access", "hour_of_day"],
        "cv_folds": len(table), "cv_results": results,
        "feature_importance": {r.feature: r.mean_delta for r in ranked.collect()},
    }, indent=2)
