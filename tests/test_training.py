"""Labelled spans to stored models; hits that carry their window; findings from masks."""

import json

import pytest
from pyspark.sql import functions as F

from embertrace.operators.corroborate import findings, findings_detected
from embertrace.operators.detect import detect
from embertrace.operators.features import (
    FEATURES, RULE_FAMILIES, detect_with_window, labelled_windows, rule_features, window_features, window_features_live)
from embertrace.functions.clock import bounds
from embertrace.plans.telemetry import telemetry
from embertrace.plans.training import finished_runs, load_models, train_models
from embertrace.session import cut_lineage

SF = "/root/testdata/sf0.001"
SPANS = [(None, "2024-01-15 23:59:59", 0), ("2024-01-14 00:00:00", None, 1)]


@pytest.fixture(scope="module")
def events(spark):
    return cut_lineage(telemetry(spark, SF))


def test_each_span_equals_its_own_extraction(spark, events):
    spans = [(*bounds(a, b), label) for a, b, label in SPANS]
    rows = labelled_windows(events, spans)
    for n, (start, end, label) in enumerate(spans):
        own = window_features_live(events, start=start, end=end, label=label).select("image", "pid", *FEATURES, "label")
        part = rows.filter(F.col("span") == n).select(*own.columns)
        assert own.count() > 0 and own.exceptAll(part).count() == part.exceptAll(own).count() == 0
    with pytest.raises(ValueError):
        labelled_windows(events, [])
    with pytest.raises(ValueError):
        labelled_windows(events, [(None, None, 2)])
    assert labelled_windows(events.limit(0), spans).count() == 0


def test_training_run_is_stored_and_scores_again(spark, events, tmp_path):
    folder = str(tmp_path / "models")
    run = train_models(events, SPANS, folder, trees=5, sample=64, depth=4, folds=2, repeats=1)
    assert [r.split("/")[-1] for r in finished_runs(spark, folder)] == [run.split("/")[-1]]
    models = load_models(spark, run)
    windows = spark.read.parquet(f"{run}/windows")
    counts = {str(r[0]): r[1] for r in windows.groupBy("label").count().collect()}
    assert models.report["windows"] == counts and models.report["random_forest"]["n_total"] == sum(counts.values())
    assert models.report["isolation_forest_label_0"]["score_min"] == 0.0 and models.report["isolation_forest_label_0"]["score_max"] == 1.0
    assert set(models.report["random_forest"]["cv_results"]) == {"precision", "recall", "f1", "roc_auc"}
    scored = models.score_windows(windows.filter("span = 0")).groupBy("model_type").count().collect()
    assert {r[0]: r[1] for r in scored} == {"isolation_forest": counts["0"], "random_forest": counts["0"]}
    assert models.score_events(events).filter("score < 0 OR score > 1").count() == 0


def test_one_label_trains_no_classifier_and_a_stopped_run_is_refused(spark, events, tmp_path):
    run = train_models(events, [(None, None, 0)], str(tmp_path), trees=3, sample=16)
    models = load_models(spark, run)
    assert models.classifier is None and "random_forest" not in models.report
    with pytest.raises(ValueError, match="label 0"):
        train_models(events, [(None, None, 1)], str(tmp_path), trees=3, sample=16)
    stopped = [p for p in tmp_path.iterdir() if not (p / "report.json").exists()]
    assert len(stopped) == 1 and len(finished_runs(spark, str(tmp_path))) == 1
    with pytest.raises(ValueError, match="no finished"):
        load_models(spark, str(stopped[0]))
    assert json.loads((tmp_path / run.split("/")[-1] / "report.json").read_text())["spans"] == [[None, None, 0]]


def test_hits_with_windows_need_no_events(spark, wide):
    events = wide(
        {"image": "C:\\w\\powershell.exe", "process_id": 1, "command_line": "powershell -enc " + "A" * 40},
        {"image": "C:\\w\\powershell.exe", "process_id": 1, "command_line": "powershell -nop -w hidden iex x"},
        {"image": None, "process_id": None, "command_line": "powershell -enc " + "A" * 40},
        {"image": "quiet.exe", "process_id": 3},
        {"event_type_id": 10, "source_image": "C:\\t\\a.exe", "source_process_id": 9, "target_image": "C:\\w\\lsass.exe", "granted_access": "0x1fffff"})
    hits = detect_with_window(events)
    columns = ["image", "pid", "rule_hit_count", "unique_rules_fired", *RULE_FAMILIES]
    got = rule_features(hits).select(*columns)
    want = window_features(events, detect(events)).filter("rule_hit_count > 0").select(*columns)
    assert want.count() >= 2 and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    stored = cut_lineage(hits)
    assert "Join" not in rule_features(stored)._jdf.queryExecution().executedPlan().toString()
    assert rule_features(stored.limit(0)).count() == 0


def test_findings_without_stored_hits(spark, events, wide):
    encoded = "JABjAD0ATgBlAHcALQBPAGIAagBlAGMAdAAgAE4AZQB0AC4AVwBlAGIAQwBsAGkAZQBuAHQA"  # $c=New-Object Net.WebClient
    own = wide(
        {"image": "C:\\w\\powershell.exe", "process_id": 1, "command_line": f"powershell -enc {encoded}"},
        {"image": None, "process_id": 2, "command_line": f"x -enc {encoded}"}, {"image": "b", "process_id": 3})
    for data in (own, events, own.limit(0)):
        got, want = findings_detected(data), findings(data, detect(data))
        assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert {r.standalone for r in findings_detected(own).collect()} <= {True, False} and findings_detected(own).count() == 2
    assert "Join" not in findings_detected(own)._jdf.queryExecution().executedPlan().toString()
