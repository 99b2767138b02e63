"""XML, corroboration, streaming, features, models."""

import base64
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from embertrace.models import rforest
from embertrace.models.iforest import IsolationForest, Scorer
from embertrace.models.scoring import score_events
from embertrace.operators.corroborate import decode_command, findings
from embertrace.operators.detect import detect
from embertrace.operators.features import FEATURES, window_features, window_features_live
from embertrace.plans.batch import run_batch
from embertrace.plans.telemetry import telemetry
from embertrace.sources.stored import read_features_csv, write_features_csv
from embertrace.sources.xml_events import accepted, parse, read_xml_files, rejected, render, stream_xml
from embertrace.streaming.pipeline import TelemetryPipeline
from embertrace.streaming.windowed import windowed_features

SF = "/root/testdata/sf0.001"
NS = "xmlns='http://schemas.microsoft.com/win/2004/08/events/event'"
NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)


def document(eid, data, time="2024-01-01T10:00:00.1234567Z", computer="pc"):
    stamp = "" if time is None else f"<TimeCreated SystemTime='{time}'/>"
    host = "" if computer is None else f"<Computer>{computer}</Computer>"
    body = "".join(f"<Data Name='{n}'>{v}</Data>" for n, v in data)
    return f"<Event {NS}><System><EventID>{eid}</EventID>{stamp}{host}</System><EventData>{body}</EventData></Event>"


def parsed(spark, *docs):
    return parse(spark.createDataFrame([(d,) for d in docs], "xml string"), NOW)


def test_xml_fields(spark):
    good = document(1, [("ProcessId", "7"), ("Image", " C:\\a b.exe "), ("Image", "second"), ("CommandLine", ""), ("User", "-"), ("Extra", "x"), ("ParentProcessId", "no")])
    net = document(3, [("ProcessId", "8"), ("Initiated", "TRUE"), ("DestinationPort", "443"), ("Image", "a&lt;b")], time=None, computer=None)
    bom = "\ufeff<?xml version='1.0' encoding='utf-8'?>" + document(8, [("SourceProcessId", "1"), ("TargetProcessId", "2"), ("CommandLine", "not its field")])
    rows = {r.event_type_id: r for r in accepted(parsed(spark, good, net, bom)).collect()}
    one, three, eight = rows[1], rows[3], rows[8]
    assert (one.process_id, one.image, one.command_line, one.user, one.parent_process_id) == (7, " C:\\a b.exe ", None, "-", None)
    assert one.event_time == datetime(2024, 1, 1, 10, 0, 0, 123456) and one.process_guid == "" and one.computer == "pc"
    assert (three.initiated, three.destination_port, three.image, three.computer) == (True, 443, "a<b", "")
    assert three.event_time == NOW.replace(tzinfo=None)  # no usable time: the given clock
    assert (eight.source_image, eight.command_line, eight.image) == ("", None, None)


def test_xml_rejects(spark):
    docs = {
        "malformed": ["<Event", "", "text", document("x1", []), f"<Event {NS}></Event>"],
        "event type": [document(5, [("ProcessId", "1")])],
        "process id": [document(1, [("ProcessId", "abc")]), document(10, [("SourceProcessId", "1")]), f"<Event {NS}><System><EventID>22</EventID></System></Event>"],
    }
    got = rejected(parsed(spark, *[d for group in docs.values() for d in group])).groupBy("reject_reason").count().collect()
    assert {r.reject_reason: r["count"] for r in got} == {k: len(v) for k, v in docs.items()}


def test_xml_files_oldest_first_without_seen_ones(spark, tmp_path):
    import os

    for i in range(4):
        path = tmp_path / f"{i}.xml"
        path.write_text(document(22, [("ProcessId", str(i)), ("Image", "x")]))
        os.utime(path, (1000 - i, 1000 - i))
    (tmp_path / "note.txt").write_text("no")
    first = read_xml_files(spark, str(tmp_path), limit=2)
    assert sorted(r.process_id for r in accepted(parse(first)).collect()) == [2, 3]
    rest = read_xml_files(spark, str(tmp_path), seen=first)
    assert sorted(r.process_id for r in accepted(parse(rest)).collect()) == [0, 1]
    unlimited = read_xml_files(spark, str(tmp_path), seen=first, limit=None)
    assert sorted(r.process_id for r in accepted(parse(unlimited)).collect()) == [0, 1]
    assert read_xml_files(spark, str(tmp_path), seen=read_xml_files(spark, str(tmp_path), limit=None)).count() == 0


def encoded(raw: bytes) -> str:
    return base64.b64encode(raw).decode()


@pytest.mark.parametrize("raw", [
    "plain".encode("utf-16-le"), "naïve 😀 測試".encode("utf-16-le"), b"ABC", b"\x00\xd8A\x00", b"A\x00\x00\xdc", b"\x00\xd8\x00\xd8\x00\xdc",
    b"\x3d\xd8\x00\xde\x00\xdc", b"\x00\x00", bytes(range(256))])
def test_decoding_matches_python(spark, raw):
    text = f"powershell -EnC  {encoded(raw)} tail"
    got = spark.createDataFrame([(text,)], "c string").select(decode_command(F.col("c"))).first()[0]
    assert got == raw.decode("utf-16-le", errors="replace")


@pytest.mark.parametrize("command", ["-enc", "-enc A", "-enc QQ", "-enc QUJDR", "no flag", "", None, "-enc ===="])
def test_undecodable_commands_are_null(spark, command):
    assert spark.createDataFrame([(command,)], "c string").select(decode_command(F.col("c"))).first()[0] is None


def test_known_hash_alone_makes_no_hit(wide):
    events = wide({"image": "C:\\tool.exe", "hashes": "SHA256=61C0810A23580CF492A6BA4F7654566108331E7A4134C968C2D6A05261B2D8A1"})
    hits = detect(events)
    got = findings(events, hits).collect()
    assert hits.count() == 0 and [(r.hash_matches, r.standalone) for r in got] == [(["Mimikatz-2.2.0"], True)]


def test_stream_batch_and_replay_agree(spark, tmp_path):
    records = telemetry(spark, SF).filter("image is not null or source_image is not null").limit(300)
    render(records).select(F.col("xml").alias("value")).repartition(5).write.text(str(tmp_path / "in"))
    live, batch = TelemetryPipeline(str(tmp_path / "live")), TelemetryPipeline(str(tmp_path / "batch"))
    for checkpoint in ("one", "two"):  # the second run repeats the first run's batch numbers
        source = stream_xml(spark, str(tmp_path / "in"), files_per_trigger=2)
        live.start(source, str(tmp_path / checkpoint), once=True).awaitTermination()
    run_batch(spark, str(tmp_path / "in"), batch)
    for name in ("records", "events", "hits", "alerts", "findings", "rejects"):
        a, b = live.table(spark, name).drop("batch_id", "run"), batch.table(spark, name).drop("batch_id", "run")
        assert a.count() == b.count() and a.exceptAll(b).count() == 0, name
    assert live.table(spark, "records").select("batch_id").distinct().count() == 3


def test_runs_add_to_each_other(spark, tmp_path):
    pipeline = TelemetryPipeline(str(tmp_path / "out"))
    for n in (1, 2, 1):  # the third folder repeats the first folder's event
        (tmp_path / f"in{n}").mkdir(exist_ok=True)
        (tmp_path / f"in{n}" / "A.XML").write_text(document(22, [("ProcessId", str(n)), ("Image", "x")]))
        (tmp_path / f"in{n}" / "b.xml").write_text(document(22, [("ProcessId", str(n)), ("Image", "x")], time="not a time"))
        run_batch(spark, str(tmp_path / f"in{n}"), pipeline, whole_files=True)
    assert sorted(r.process_id for r in pipeline.table(spark, "records").collect()) == [1, 2]
    assert {r.reject_reason for r in pipeline.table(spark, "rejects").collect()} == {"event time"}
    run_batch(spark, str(tmp_path / "in1"), pipeline, whole_files=True, run="named")
    assert pipeline.table(spark, "records").count() == 2 and not (tmp_path / "out" / "staged" / "run=named" / "batch_id=0").exists()


@pytest.mark.parametrize("step", ["write_batch", "detect_with_identity", "alerts_from_detected", "findings"])
def test_a_run_that_stops_half_way_is_done_again(spark, tmp_path, monkeypatch, step):
    from embertrace.streaming import pipeline as module

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text(document(1, [("ProcessId", "1"), ("Image", "C:\\mshta.exe")]))
    (tmp_path / "in" / "b.xml").write_text(document(22, [("ProcessId", "2"), ("Image", "x")], time="not a time"))
    pipeline = TelemetryPipeline(str(tmp_path / "out"))

    def lost(*_, **__):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(module, step, lost)
        with pytest.raises(KeyboardInterrupt):
            run_batch(spark, str(tmp_path / "in"), pipeline, whole_files=True)
    for _ in range(2):  # the second call finds everything stored
        run_batch(spark, str(tmp_path / "in"), pipeline, whole_files=True)
        for name, count in (("records", 1), ("events", 1), ("hits", 1), ("alerts", 1), ("rejects", 1)):
            assert pipeline.table(spark, name).count() == count, name


def test_new_files_after_a_restart_are_the_only_ones_read(spark, tmp_path):
    pipeline = TelemetryPipeline(str(tmp_path / "out"), since=datetime(2024, 1, 1, tzinfo=timezone.utc))
    (tmp_path / "in").mkdir()
    for n in range(3):
        old = "2023-01-01T00:00:00Z" if n == 2 else "2024-02-01T00:00:00Z"
        (tmp_path / "in" / f"{n}.xml").write_text(document(22, [("ProcessId", str(n)), ("Image", "x")], time=old))
        source = stream_xml(spark, str(tmp_path / "in"), whole_files=True)
        pipeline.start(source, str(tmp_path / "cp"), once=True).awaitTermination()
    assert sorted(r.process_id for r in pipeline.table(spark, "records").collect()) == [0, 1]


def test_a_failing_model_does_not_stop_storage(spark, tmp_path):
    class Broken:
        def score(self, *_):
            raise RuntimeError("no model")

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text(document(1, [("ProcessId", "1"), ("Image", "C:\\mshta.exe")]))
    pipeline = TelemetryPipeline(str(tmp_path / "out"), forest=Broken())
    run_batch(spark, str(tmp_path / "in"), pipeline, whole_files=True)
    assert pipeline.table(spark, "hits").count() == 1 and not (tmp_path / "out" / "scores").exists()


def test_windowed_features_stream_drops_late_rows(spark, tmp_path, wide):
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    for i, hour in enumerate((10, 14, 9)):  # the last batch is far behind the watermark
        wide({"id": i, "event_type_id": 7, "image": "a", "process_id": 1, "event_time": at(hour)}).write.parquet(str(tmp_path / "in" / f"b{i}"))
    schema = wide({}).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in" / "*"))
    query = windowed_features(stream).writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.sql("select window_start, image_load_count from w").collect()
    assert (at(10), 1) in [tuple(r) for r in rows] and all(r.window_start.hour != 9 for r in rows)


# --- features and models --------------------------------------------------------------------

def test_windows_keep_null_keys_and_the_first_event(wide):
    at = lambda m: datetime(2024, 1, 10, 9, m)
    events = wide(
        {"id": 1, "image": "a", "process_id": 1, "command_line": "later", "event_time": at(5)},
        {"id": 2, "image": "a", "process_id": 1, "command_line": None, "event_time": at(1)},
        {"id": 3, "event_type_id": 3, "image": "a", "process_id": 1, "destination_port": 0, "event_time": at(0)},
        {"id": 4, "event_type_id": 3, "image": "a", "process_id": 1, "destination_port": 4444, "event_time": at(2)},
        {"id": 5, "event_type_id": 22, "image": None, "process_id": None, "query_name": "abc"},
        {"id": 6, "event_type_id": 22, "image": None, "process_id": None, "query_name": "abcdef", "event_time": at(0)})
    rows = {r.pid: r for r in window_features(events, detect(events)).collect()}
    assert len(rows) == 2
    assert (rows[1].cmd_length, rows[1].dest_port, rows[1].is_suspicious_port, rows[1].network_event_count) == (0, 0, 0, 2)
    assert rows[None].dns_query_length == 6 and rows[None].hour_of_day == -1


def test_stored_and_live_windows_agree_and_bounds_apply_to_hits(spark):
    events = telemetry(spark, SF)
    start, end = datetime(2024, 1, 5, tzinfo=timezone.utc), datetime(2024, 1, 9, tzinfo=timezone.utc)
    stored = window_features(events, detect(events), start, end, label=1)
    live = window_features_live(events, None, start, end, label=1)
    kinds = [F.col(c).cast("double") for c in FEATURES]
    a, b = stored.select("image", "pid", *kinds), live.select("image", "pid", *kinds)
    assert a.count() > 50 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert window_features(events, detect(events, fired_at=NOW), start, end).agg(F.sum("rule_hit_count")).first()[0] == 0


@pytest.fixture(scope="module")
def blobs(spark):
    rows = [(i, float(i % 5), float(i % 7), 0) for i in range(600)] + [(1000 + i, 60.0 + i, -40.0, 1) for i in range(40)]
    return spark.createDataFrame(rows, "id int, a double, b double, label int").repartition(3).cache()


def test_isolation_forest_properties(spark, blobs, tmp_path):
    benign = blobs.filter("label = 0")
    model = IsolationForest.fit(benign, ["id"], ["a", "b"], trees=40, sample=128)
    again = IsolationForest.fit(benign.repartition(7), ["id"], ["a", "b"], trees=40, sample=128)
    assert sorted(model.nodes.collect()) == sorted(again.nodes.collect())
    assert model.nodes.select("tree").distinct().count() == 40
    scored = {r.id: (r.s, r.label) for r in model.score(blobs, ["id", "label"], "s").collect()}
    assert all(0.0 <= s <= 1.0 for s, _ in scored.values())
    inside = [s for s, l in scored.values() if l == 0]
    assert min(inside) == 0.0 and max(inside) == 1.0  # training bounds are reached
    outside = [s for s, l in scored.values() if l == 1]
    assert sum(outside) / len(outside) > sum(inside) / len(inside) + 0.2
    model.save(str(tmp_path / "m"))
    loaded = IsolationForest.load(spark, str(tmp_path / "m"))
    one = loaded.score(blobs.filter("id = 1003"), [], "s").first().s  # a row alone scores as in a batch
    assert one == scored[1003][0]
    flat = IsolationForest.fit(benign.limit(1), ["id"], ["a", "b"], trees=3)
    assert flat.score(benign, [], "s").agg(F.max("s")).first()[0] == 0.0
    ranked = model.importance(benign, ["id"], repeats=2).collect()
    assert {r.feature for r in ranked} == {"a", "b"} and ranked[0].mean_delta <= ranked[1].mean_delta


@pytest.mark.parametrize("n", [0, 10, 50, 5000])
def test_tree_samples_follow_the_draw_order(spark, n):
    from hashlib import md5

    from embertrace.models.iforest import tree_samples

    drawn = tree_samples(spark.range(n), ["id"], trees=3, sample=20, seed=7)
    pool = sorted(range(n), key=lambda i: (md5(f"7:{i}".encode()).hexdigest(), i))[:60]
    want = [(t, pool[(20 * t + i) % len(pool)]) for t in range(3) for i in range(min(20, len(pool)))]
    assert sorted((r.tree, r.id) for r in drawn.collect()) == sorted(want)


def test_scorer_against_a_walk_by_hand(spark, blobs):
    import numpy as np

    model = IsolationForest.fit(blobs, ["id"], ["a", "b"], trees=5, sample=64)
    nodes = model.nodes.toPandas()
    points = np.array([[0.0, 0.0], [70.0, -40.0], [2.5, 3.0], [0.0, 0.0]])
    scorer, table = Scorer(nodes, model.sample), {(n.tree, n.node): n for n in nodes.itertuples()}
    for point, got in zip(points, scorer.raw(points)):
        total = 0.0
        for tree in range(5):
            node = table[tree, 0]
            while node.feature >= 0:
                node = table[tree, node.left_node if point[node.feature] <= node.threshold else node.right_node]
            total += node.path
        assert got == pytest.approx(-(2 ** (-(total / 5) / scorer.norm)))


def test_random_forest(spark, blobs):
    folds = rforest.with_folds(blobs, ["id"]).groupBy("label", "fold").count().collect()
    assert all(abs(r["count"] - (120 if r.label == 0 else 8)) <= 1 for r in folds) and len(folds) == 10
    cv = rforest.cross_validate(blobs, ["id"], ["a", "b"], folds=3, trees=5, depth=4).collect()
    assert len(cv) == 3 and all(r.roc_auc > 0.9 and 0 <= r.f1 <= 1 for r in cv)
    model = rforest.train(blobs, ["a", "b"], trees=5, depth=4)
    means = {r.label: r.m for r in rforest.score(model, blobs).groupBy("label").agg(F.avg("rf_score").alias("m")).collect()}
    assert means[1] > 0.8 > 0.2 > means[0]
    assert rforest.score(model, blobs.drop("b")).columns == ["id", "a", "label", "rf_score"]  # a missing feature is 0
    ranked = rforest.importance(model, blobs, ["id"], repeats=2).collect()
    assert [r.feature for r in ranked] and ranked[0].mean_delta >= ranked[-1].mean_delta
    with pytest.raises(ValueError, match="zzz"):
        rforest.train(blobs, ["a", "zzz"])
    assert '"cv_folds": 3' in rforest.metrics_json(blobs, spark.createDataFrame(cv), spark.createDataFrame(ranked), ["a", "b"])


def test_event_scores_have_one_row_per_model(spark, wide, tmp_path):
    events = wide({"image": "a", "process_id": 1, "command_line": "x y"}, {"event_type_id": 7, "image": "b", "process_id": 2})
    windows = window_features_live(telemetry(spark, SF))
    forest = IsolationForest.fit(windows, ["image", "pid"], trees=10)
    rows = score_events(events, forest).collect()
    assert sorted((r.event_fk, r.model_type, r["mode"]) for r in rows) == [(1, "isolation_forest", "event"), (2, "isolation_forest", "event")]
    with pytest.raises(ValueError):
        score_events(events, None)
    write_features_csv(windows.limit(0), str(tmp_path / "csv"))
    assert read_features_csv(spark, str(tmp_path / "csv")).columns == FEATURES
