"""Search errors, paging, numbering, medians, timelines, trees, alerts, sinks."""

import random
import statistics
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from embertrace.operators import metrics, tables, tree
from embertrace.operators.alerts import alerts_from_hits, status_changes, unknown_changes, with_status
from embertrace.operators.detect import detect
from embertrace.operators.search import Fields, SearchError, search, where
from embertrace.sources.stored import append, read_features_csv, split_valid, write_batch

UTC = timezone.utc
T0 = datetime(2024, 1, 10, tzinfo=UTC)


def stamped(spark, minutes, extra="'High'"):
    rows = [(i, T0 + timedelta(minutes=m)) for i, m in enumerate(minutes)]
    return spark.createDataFrame(rows, "id int, timestamp timestamp").withColumn("severity", F.expr(extra))


def test_search_errors(spark):
    a = Fields("alerts")
    with pytest.raises(SearchError, match="the fields there: command_line, mitre_tactic"):
        a.plain("nope", "x")
    for build in (lambda: Fields("logs"), lambda: a.plain("process_pid", "x"), lambda: a.between("process_pid", "1", "z"),
                  lambda: a.between("timestamp", "soon", "*"), lambda: a.between("status", "*", "*"),
                  lambda: search({}, "logs", None, T0, T0), lambda: search({}, "alerts", None, T0, T0)):
        with pytest.raises(SearchError):
            build()


def test_search_text_rules(spark):
    df = spark.createDataFrame([("C:\\Win\\a_b.exe",), ("C:\\Win\\axb.exe",), ("50% off",), (None,)], "command_line string")
    a = Fields("alerts")
    count = lambda p: where(df, p).count()
    assert count(a.plain("command_line", "WIN\\A_B")) == 2  # '_' is a wildcard
    assert count(a.quoted("command_line", "\\win\\")) == 2
    assert count(a.plain("command_line", "0% o")) == 1
    assert count(a.wildcard("command_line", "c:*b.EXE")) == 2 and count(a.wildcard("command_line", "win*")) == 0
    assert count(~a.plain("command_line", "win")) == 1  # NULL matches neither way
    assert count(None) == 4


def test_pages_deep_and_shallow_agree(spark):
    rng = random.Random(5)
    minutes = [rng.choice([0, 0, 0, 0, 0, 7, 8, 90, 200, 201]) for _ in range(503)]
    df = stamped(spark, minutes).repartition(7)
    want = [i for _, i in sorted(((m, i) for i, m in enumerate(minutes)), reverse=True)]
    for n in (1, 2, 4, 7, 11, 12):
        got = [r.id for r in tables.page(df, n, 50).items.collect()]
        assert got == want[(n - 1) * 50:n * 50]
    got = tables.page(df, -3, 500)
    assert (got.total, got.pages, got.number, got.size) == (503, 2, 1, 500)
    for size in (0, 501, 9999):
        with pytest.raises(ValueError):
            tables.page(df, 1, size)
    assert tables.page(df.limit(0)).pages == 1


def test_pages_put_rows_without_a_time_last(spark):
    df = stamped(spark, [5, 1, 3]).unionByName(stamped(spark, [9, 9]).withColumns({"id": F.col("id") + 10, "timestamp": F.lit(None).cast("timestamp")}))
    assert [[r.id for r in tables.page(df, n, 2).items.collect()] for n in (1, 2, 3)] == [[0, 2], [1, 11], [10]]


def test_row_numbers_are_consecutive(spark):
    df = spark.range(1000).withColumn("k", F.lit(1)).repartition(5)
    numbered = tables.number_rows(df, [F.col("k"), F.col("id").desc()], "n").collect()
    assert sorted((r.n, r.id) for r in numbered) == [(i, 999 - i) for i in range(1000)]
    assert tables.number_rows(df.limit(0), [F.col("id")], "n").count() == 0


@pytest.mark.parametrize("values", [
    [0.3], [0.2, 0.4], [0.5] * 400 + [0.1, 0.9], [0.0, 1.0, 1.0], [i / 997 for i in range(300)],
    [0.5 + i * 1e-13 for i in range(101)]])
def test_exact_median(spark, values):
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 0.25)], "m string, v double")
    got = {r.m: r.median for r in metrics.exact_median(df, ["m"], "v").collect()}
    assert got["a"] == pytest.approx(statistics.median(values), abs=1e-15) and got["b"] == 0.25


def test_score_bins_and_summary(spark):
    scores = [0.02, 0.05, 0.08, 0.3412, 0.42, 0.51, 1.0, 0.3]
    df = spark.createDataFrame([("isolation_forest", s, T0) for s in scores], "model_type string, score double, timestamp timestamp")
    bins = {r.bin: (r.n, round(r.pct, 1)) for r in metrics.score_bins(df, "isolation_forest").collect()}
    assert [bins[i][0] for i in range(10)] == [3, 0, 0, 2, 1, 1, 0, 0, 0, 1] and bins[0][1] == 37.5
    assert metrics.score_bins(df, "random_forest").count() == 0
    rows = {r.model_type: r for r in metrics.score_summary(df).collect()}
    assert rows["random_forest"].trained is False and rows["random_forest"].score_min is None
    assert rows["isolation_forest"].score_median == pytest.approx(statistics.median(scores))


def test_timeline_starts_at_the_range_and_keeps_the_last_edge(spark):
    alerts = stamped(spark, [0, 4, 5, 59, 60, 61])
    rows = metrics.timeline(alerts, T0, T0 + timedelta(minutes=60)).orderBy("bucket").collect()
    assert len(rows) == 13 and [r.n for r in rows] == [2, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1]
    assert rows[0].interval == "5m"


def test_severity_and_top_rules(spark):
    alerts = stamped(spark, range(6), "element_at(array('High', 'Odd', 'Low'), id % 3 + 1)")
    got = {r.severity: r.n for r in metrics.severity_distribution(alerts, T0, T0 + timedelta(hours=1)).collect()}
    assert got == {"Low": 2, "Medium": 0, "High": 2, "Critical": 0}
    hits = alerts.withColumns({"rule_id": F.lit("R"), "rule_name": F.lit("n")})
    top = metrics.top_rules(hits, T0, T0 + timedelta(hours=1)).collect()
    assert [(r.hit_count, r.top_severity) for r in top] == [(6, "High")]
    odd = metrics.top_rules(hits.filter("severity = 'Odd'"), T0, T0 + timedelta(hours=1)).first()
    assert odd.top_severity == "Low"


def test_sampling_keeps_whole_small_types(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 5, 1).otherwise(3).alias("event_type_id"))
    counts = {r.event_type_id: r["count"] for r in metrics.sample_per_type(df, 50).groupBy("event_type_id").count().collect()}
    assert counts == {1: 5, 3: 50}


def test_sampling_drops_rows_before_the_shuffle(spark):
    events = spark.range(100_000).withColumn("event_type_id", F.col("id") % 3)
    plan = metrics.sample_per_type(events)._jdf.queryExecution().executedPlan().toString()
    before_shuffle = plan[plan.index("Exchange"):]  # plans print from the result down
    assert "WindowGroupLimit" in before_shuffle


def test_tree_chain_fork_and_cycles(wide):
    chain = [{"process_id": n, "parent_process_id": n - 1} for n in range(1, 40)]  # root 1, its parent is no node
    fork = [{"process_id": 100 + n, "parent_process_id": 20} for n in range(30)]
    loop = [{"process_id": 201, "parent_process_id": 202}, {"process_id": 202, "parent_process_id": 203},
            {"process_id": 203, "parent_process_id": 201}, {"process_id": 300, "parent_process_id": 300},
            {"process_id": 301, "parent_process_id": 300}, {"process_id": 400, "parent_process_id": None},
            {"process_id": None, "parent_process_id": 1}]
    nodes = tree.nodes(wide(*chain, *fork, *loop), None, None)
    paths, cycles = tree.paths(nodes)
    got = {r.pid: (r.root_pid, r.depth) for r in paths.collect()}
    assert got == {**{n: (1, n - 1) for n in range(1, 40)}, **{100 + n: (1, 20) for n in range(30)}, 400: (400, 0)}
    assert {r.pid for r in cycles.collect()} == {201, 202, 203, 300, 301}
    assert {r.pid for r in tree.roots(nodes).collect()} == {1, 400}
    assert tree.edges(nodes).count() == 38 + 30 + 5


def test_tree_takes_the_newest_rows_but_the_oldest_of_a_pid(wide):
    at = lambda s: datetime(2024, 1, 10, 12, 0, s)
    events = wide({"process_id": 1, "image": "old", "event_time": at(1)}, {"process_id": 1, "image": "mid", "event_time": at(2)},
                  {"process_id": 1, "image": "new", "event_time": at(3)})
    assert tree.nodes(events, None, None, cap=2).first().image == "mid"
    assert tree.nodes(events, None, None).first().image == "old"


def test_alert_status_log(wide, spark):
    events = wide({"image": "C:\\mshta.exe", "process_id": 0}, {"event_type_id": 8, "source_image": "C:\\winword.exe", "source_process_id": 9})
    alerts = alerts_from_hits(detect(events), events)
    got = {r.event_fk: (r.process_image, r.process_pid, r.status) for r in alerts.collect()}
    assert got == {1: ("C:\\mshta.exe", None, "open"), 2: ("C:\\winword.exe", 9, "open")}
    key = alerts.filter("event_fk = 1").first().id
    changes = spark.createDataFrame(
        [(key, "resolved", T0), (key, "acknowledged", T0 + timedelta(1)), ("gone", "open", T0)], "alert_id string, status string, changed_at timestamp")
    assert [r.status for r in with_status(alerts, status_changes(changes)).orderBy("event_fk").collect()] == ["acknowledged", "open"]
    assert [r.alert_id for r in unknown_changes(changes, alerts).collect()] == ["gone"]
    with pytest.raises(Exception, match="there is no alert gone"):
        status_changes(changes, alerts).collect()
    with pytest.raises(Exception, match="cannot become"):
        status_changes(changes.withColumn("status", F.lit("closed"))).collect()


def test_hits_of_lost_events_keep_their_alert(wide):
    events = wide({"image": "C:\\mshta.exe"})
    alerts = alerts_from_hits(detect(events), events.limit(0)).collect()
    assert len(alerts) == 1 and alerts[0].process_image is None


def test_refused_rows_are_kept_beside_the_table(spark, tmp_path):
    rows = [("isolation_forest", 0.5), ("other", 0.5), ("random_forest", 1.5), ("random_forest", float("nan")), ("random_forest", None)]
    df = spark.createDataFrame(rows, "model_type string, score double")
    good, bad = split_valid(df, "scores")
    assert (good.count(), bad.count()) == (1, 4)
    append(df, str(tmp_path / "scores"), "scores")
    assert spark.read.parquet(str(tmp_path / "scores_refused")).count() == 4


def test_writing_a_batch_again_leaves_one_copy(spark, tmp_path):
    for _ in range(2):
        write_batch(spark.range(5), str(tmp_path / "t"), 3)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5


def test_feature_csv_names_missing_columns(spark, tmp_path):
    (tmp_path / "f.csv").write_text("cmd_length,label\n3,1\n")
    with pytest.raises(ValueError, match="cmd_entropy"):
        read_features_csv(spark, str(tmp_path / "f.csv"))
    assert read_features_csv(spark, str(tmp_path / "f.csv"), ["cmd_length"]).first().asDict() == {"cmd_length": 3, "label": 1}


@pytest.mark.parametrize("most", [0, 5, 100_000])
def test_recent_scores_look_past_orphans(spark, most, monkeypatch):
    monkeypatch.setattr(tables, "MOST_CANDIDATES", most)
    scores = spark.createDataFrame([(n, m, n / 100) for n in range(100) for m in ("a", "b")], "event_fk bigint, model_type string, score double")
    events = spark.createDataFrame([(n, n % 3) for n in range(0, 90, 2)], "id bigint, event_type_id int")
    got = [(r.event_fk, r.model_type, r.event_type_id) for r in tables.recent_scores(scores, events, 5).collect()]
    assert got == [(88, "b", 1), (88, "a", 1), (86, "b", 2), (86, "a", 2), (84, "b", 0)]
    assert tables.recent_scores(scores, events.limit(0), 5).count() == 0


@pytest.mark.parametrize("most", [0, 3, 100_000])
def test_pages_are_the_same_however_far_rows_are_narrowed(spark, most, monkeypatch):
    monkeypatch.setattr(tables, "SORTED_ROWS", most)
    rows = [(n, datetime(2024, 1 + n % 3, 1 + n % 20, n % 5, n % 7, n % 11)) for n in range(200)]
    df = spark.createDataFrame(rows, "id bigint, timestamp timestamp")
    want = [n for n, _ in sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)]
    assert [r.id for n in (1, 2, 5) for r in tables.page(df, n, 40).items.collect()] == want[:80] + want[160:]
