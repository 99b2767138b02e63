"""Cross-validation of the Random Forest: how the folds are fitted and scored, and by which rows."""

import threading

import pytest
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import functions as F

from embertrace.models import rforest

SMALL = {"folds": 3, "trees": 4, "depth": 4}


@pytest.fixture(scope="module")
def points(spark):
    return spark.range(240).select(
        "id", (F.col("id") * 37 % 101).cast("double").alias("a"), F.when(F.col("id") % 9 > 0, F.col("id") % 7).alias("b"),
        (F.col("id") * 37 % 101 + F.col("id") % 5 * 9 > 70).cast("int").alias("label")).persist()


def test_folds_are_fitted_side_by_side_with_the_same_results(points, monkeypatch):
    def folds():
        return sorted(rforest.cross_validate(points, ["id"], ["a", "b"], **SMALL).collect())

    together, weighted = threading.Barrier(3), rforest.balanced

    def met(rows):
        together.wait(timeout=30)  # broken if the folds come one after another
        return weighted(rows)

    monkeypatch.setattr(rforest, "balanced", met)
    at_once = folds()
    monkeypatch.setattr(rforest, "balanced", weighted)
    monkeypatch.setattr(rforest, "FITS", 1)
    assert at_once == folds()
    assert [r.fold for r in at_once] == [0, 1, 2] and all(0 < r.f1 < 1 and 0.5 < r.roc_auc < 1 for r in at_once)


def test_held_out_rows_are_scored_once(spark, points, monkeypatch):
    scored, plain = spark.sparkContext.accumulator(0), RandomForestClassificationModel._transform

    @F.udf(VectorUDT())
    def seen(vector):
        scored.add(1)
        return vector

    monkeypatch.setattr(RandomForestClassificationModel, "_transform", lambda self, rows: plain(
        self, rows.withColumn("features", seen("features"))))
    rforest.cross_validate(points, ["id"], ["a", "b"], **SMALL)
    assert scored.value == 240


def test_a_failed_fold_fails_the_validation(points):
    with pytest.raises(ValueError, match="label must be 0 or 1"):
        rforest.cross_validate(points.withColumn("label", F.col("label") + 1), ["id"], ["a", "b"], **SMALL)


def test_metrics_of_known_predictions(spark):
    class Given:
        def transform(self, rows):
            return rows.withColumn("prediction", (F.col("p") > 0.5).cast("double")).withColumn(
                "probability", rforest.array_to_vector(F.array(1 - F.col("p"), F.col("p"))))

    rows = [(1, 0.9), (1, 0.8), (1, 0.2), (0, 0.7), (0, 0.3), (0, 0.1)]
    precision, recall, f1, auc = rforest.held_out_metrics(Given(), spark.createDataFrame(rows, "label int, p double"))
    assert (precision, recall, f1, auc) == pytest.approx((2 / 3, 2 / 3, 2 / 3, 7 / 9))
    assert rforest.held_out_metrics(Given(), spark.createDataFrame([(1, 0.1), (0, 0.2)], "label int, p double"))[:3] == (0, 0, 0)
