"""As-of joins and process identity against brute force."""

import random
from datetime import datetime, timedelta

import pytest

from embertrace.operators import identity
from embertrace.operators.asof import latest_before
from embertrace.operators.features import FEATURES, window_features_live


@pytest.mark.parametrize("strict", [False, True])
def test_latest_before(spark, strict):
    rng = random.Random(5)
    key = lambda: (rng.choice(["a", "b", None]), rng.choice([1, 2, None]))
    rows = [(*key(), rng.randint(-40, 60), n % 7, "x") for n in range(300)] + [("hot", 1, n // 3, n, "x") for n in range(200)]
    rows += rows[:3]
    marks = [(*key(), rng.randint(-40, 60), n) for n in range(40)] + [("hot", 1, 10, 900), ("hot", 1, 10, 901), ("hot", 1, 55, 902)]
    got = latest_before(
        spark.createDataFrame(rows, "k string, l int, at bigint, mark int, _row string"), spark.createDataFrame(marks, "k string, l int, at bigint, mark bigint"), ["k", "l"], 7, strict)
    assert got.columns == ["k", "l", "at", "mark", "_row", "found"]

    def want(row):
        able = [m[2:] for m in marks if m[:2] == row[:2] and (m[2] < row[2] or m[2] == row[2] and not strict)]
        return max(able)[1] if able else -1

    assert sorted(((*r[:5], -1 if r.found is None else r.found) for r in got.collect()), key=str) == sorted(((*r, want(r)) for r in rows), key=str)
    nothing = spark.createDataFrame([], "k string, l int, at bigint, mark bigint")
    assert {r.found for r in latest_before(got.drop("found"), nothing, ["k", "l"], 7).collect()} == {None}
    assert latest_before(nothing, nothing, ["k", "l"], 7).count() == 0


T = datetime(2024, 1, 10, 12)


def at(minutes):
    return T + timedelta(minutes=minutes)


@pytest.fixture
def reused(wide):
    """Pid 7 on host a runs twice, on host b once; pid 8 is its child each time, and once its own parent."""
    made = {"event_type_id": 1}
    return wide(
        {**made, "id": 1, "computer": "a", "process_id": 7, "event_time": at(0), "image": "one", "process_guid": "{A}"},
        {**made, "id": 2, "computer": "a", "process_id": 8, "parent_process_id": 7, "event_time": at(1), "image": "kid", "process_guid": ""},
        {**made, "id": 3, "computer": "a", "process_id": 7, "event_time": at(200), "image": "two", "process_guid": None},
        {**made, "id": 4, "computer": "a", "process_id": 8, "parent_process_id": 7, "event_time": at(300), "image": "kid", "process_guid": "{A}"},
        {**made, "id": 5, "computer": "b", "process_id": 7, "parent_process_id": 9, "event_time": at(50), "image": "three"},
        {**made, "id": 6, "computer": "b", "process_id": 8, "parent_process_id": 8, "event_time": at(60), "image": "self"},
        {**made, "id": 7, "computer": None, "process_id": None, "event_time": at(60), "image": "none"},
        {"id": 10, "event_type_id": 3, "computer": "a", "process_id": 7, "event_time": at(199), "process_guid": None},
        {"id": 11, "event_type_id": 3, "computer": "a", "process_id": 7, "event_time": at(200), "process_guid": None},
        {"id": 12, "event_type_id": 3, "computer": "a", "process_id": 7, "event_time": at(400), "process_guid": "{A}"},
        {"id": 13, "event_type_id": 8, "computer": "b", "source_process_id": 7, "event_time": at(49)},
        {"id": 14, "event_type_id": 8, "computer": "b", "source_process_id": 7, "event_time": at(99_000)},
        {"id": 15, "event_type_id": 22, "computer": "a", "process_id": None, "event_time": at(5)})


def test_reused_pids_are_processes_of_their_own(reused):
    known = identity.processes(reused, by_guid=False)
    assert {(r.process, r.ended and round((r.ended - T).total_seconds() / 60)) for r in known.collect()} == {(1, 200), (2, 300), (3, None), (4, None), (5, None), (6, None)}
    nodes = identity.process_nodes(known)
    assert {r.process: r.parent_process for r in nodes.collect()} == {1: None, 2: 1, 3: None, 4: 3, 5: None, 6: None}
    assert {(r.process, r.root_process, r.depth) for r in identity.process_paths(nodes).collect()} == {(1, 1, 0), (2, 1, 1), (3, 3, 0), (4, 3, 1), (5, 5, 0), (6, 6, 0)}
    owned = {r.id: r.process for r in identity.with_process(reused, known, by_guid=False).collect()}
    assert owned == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: None, 10: 1, 11: 3, 12: 3, 13: None, 14: 5, 15: None}
    with pytest.raises(ValueError):
        identity.with_process(reused.withColumnRenamed("image", "Process"), known)


def test_a_guid_names_its_process(reused):
    known = identity.processes(reused)
    assert sorted(r.process for r in known.collect()) == [1, 2, 3, 5, 6]  # 4 has the guid of 1
    owned = {r.id: r.process for r in identity.with_process(reused, known).collect()}
    assert owned[12] == 1 and owned[4] == 1 and owned[11] == 3 and owned[10] == 1


def test_windows_of_processes(reused):
    rows = {(r.computer, r.process, r.stray_pid): r for r in identity.process_windows(reused, by_guid=False).collect()}
    assert rows["a", 1, None].network_event_count == 1 and rows["a", 3, None].network_event_count == 2
    assert rows["b", None, 7].create_remote_thread_count == 1 and ("a", None, None) in rows and (None, None, None) in rows
    by_pid = {r.pid: r.network_event_count for r in window_features_live(reused.filter("computer = 'a' AND event_type_id = 3")).collect()}
    assert by_pid == {7: 3} and list(rows["a", 1, None].asDict())[3:] == FEATURES
    assert identity.process_windows(reused.limit(0)).count() == 0
