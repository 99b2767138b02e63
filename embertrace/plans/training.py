"""From labelled time spans to stored models in one call, and back from a folder to scores."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from embertrace.functions.clock import bounds
from embertrace.models import rforest
from embertrace.models.iforest import SAMPLE, TREES, IsolationForest
from embertrace.models.scoring import score_events, score_windows
from embertrace.operators.features import FOREST_FEATURES, labelled_windows
from embertrace.session import exists, folders, read_text, write_new
from embertrace.sources.stored import write_features_csv

KEYS = ["span", "image", "pid"]
REPORT = "report.json"


@dataclass(frozen=True)
class Models:
    """What one training run stored. ``classifier`` is None where only one label was seen."""

    forest: IsolationForest
    classifier: PipelineModel | None
    report: dict

    def score_events(self, events: DataFrame) -> DataFrame:
        return score_events(events, self.forest, self.classifier)

    def score_windows(self, windows: DataFrame) -> DataFrame:
        return score_windows(windows, self.forest, self.classifier)


def train_models(events: DataFrame, spans: Sequence[tuple[str | None, str | None, int]], folder: str, trees: int = TREES,
                 sample: int = SAMPLE, depth: int = rforest.DEPTH, folds: int = rforest.FOLDS, repeats: int = 10) -> str:
    """Extract, fit, validate, report and store; returns the run's folder under ``folder``.

    ``spans`` are (since, until, label) as in ``bounds``. Windows are written once and every step reads them
    back: a CSV of the features, the Isolation Forest of the windows with label 0, and with both labels the
    Random Forest with its cross-validation and importances. The report is written last, so a run that stopped
    has none, and ``load_models`` passes it over; each call makes a run of its own. Repeated windows are one
    (grouped), ties settle by key, null features are 0. No window with label 0 is an error.
    """
    spark, run = events.sparkSession, f"{folder}/run-{uuid.uuid4().hex}"
    labelled_windows(events, [(*bounds(since, until), label) for since, until, label in spans]).write.parquet(f"{run}/windows")
    windows = spark.read.parquet(f"{run}/windows")
    write_features_csv(windows, f"{run}/features")

    benign = windows.filter("label = 0")
    counts = {r[0]: r[1] for r in windows.groupBy("label").count().collect()}  # two rows
    if not counts.get(0):
        raise ValueError("no window has label 0: there is nothing to learn the usual from")
    forest = IsolationForest.fit(benign, KEYS, trees=trees, sample=sample)
    forest.save(f"{run}/isolation_forest")
    report = {"spans": [list(s) for s in spans], "windows": {str(k): counts.get(k, 0) for k in (0, 1)}}
    for label in sorted(counts):
        report[f"isolation_forest_label_{label}"] = forest.report(windows.filter(f"label = {label}")).first().asDict()

    if counts.get(1):
        tested = rforest.cross_validate(windows, KEYS, folds=folds, trees=trees, depth=depth)
        classifier = rforest.train(windows, trees=trees, depth=depth)
        ranked = rforest.importance(classifier, windows, KEYS, repeats)
        classifier.write().save(f"{run}/random_forest")
        report["random_forest"] = json.loads(rforest.metrics_json(windows, tested, ranked, FOREST_FEATURES))
    write_new(spark, f"{run}/{REPORT}", json.dumps(report, indent=2))
    return run


def finished_runs(spark: SparkSession, folder: str) -> list[str]:
    return sorted(path.rsplit("/", 1)[0] for path in folders(spark, f"{folder}/run-*/{REPORT}"))


def load_models(spark: SparkSession, run: str) -> Models:
    """The stored models of one run. A run without a report did not finish and is refused."""
    if not exists(spark, f"{run}/{REPORT}"):
        raise ValueError(f"{run} holds no finished training run")
    forest = IsolationForest.load(spark, f"{run}/isolation_forest")
    stored = f"{run}/random_forest"
    classifier = PipelineModel.load(stored) if exists(spark, stored) else None
    return Models(forest, classifier, json.loads(read_text(spark, f"{run}/{REPORT}")))
