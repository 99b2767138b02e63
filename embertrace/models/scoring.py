"""Score rows: one pass computes both models' scores, then a row per model."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embertrace.models import rforest
from embertrace.models.iforest import IsolationForest
from embertrace.operators.features import event_vectors
from embertrace.schema import SCORE_COLUMNS


def score_vectors(vectors: DataFrame, forest: IsolationForest | None, classifier: PipelineModel | None, mode: str) -> DataFrame:
    """Rows of the scores table from vectors that carry ``event_fk`` and ``timestamp``.

    A row without an event key is scored but not stored, so it is left out here.
    """
    rows, models = vectors.filter(F.col("event_fk").isNotNull()), []
    if classifier is not None:
        rows, models = rforest.score(classifier, rows, "random_forest"), ["random_forest"]
    if forest is not None:
        rows = forest.score(rows, ["event_fk", "timestamp", *models], "isolation_forest")
        models = ["isolation_forest", *models]
    if not models:
        raise ValueError("No model to score with.")
    long = rows.select("event_fk", "timestamp", *models).unpivot(["event_fk", "timestamp"], models, "model_type", "score")
    return long.withColumn("mode", F.lit(mode)).select(*SCORE_COLUMNS)


def score_events(events: DataFrame, forest: IsolationForest | None, classifier: PipelineModel | None = None) -> DataFrame:
    """Each event by its own vector, as live scoring does; features of rule hits stay 0."""
    vectors = event_vectors(events).withColumnRenamed("id", "event_fk").withColumnRenamed("event_time", "timestamp")
    return score_vectors(vectors, forest, classifier, "event")


def score_windows(windows: DataFrame, forest: IsolationForest | None, classifier: PipelineModel | None = None) -> DataFrame:
    """Each process window by its merged vector, the form the models learn from: image, pid, model_type,
    score, mode. Image and pid are the window's key, and a null stays apart from an empty image."""
    keyed = windows.withColumns({"event_fk": F.struct("image", "pid"), "timestamp": F.lit(None).cast("timestamp")})
    return score_vectors(keyed, forest, classifier, "window").select("event_fk.image", "event_fk.pid", "model_type", "score", "mode")
