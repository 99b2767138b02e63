"""Spans and hits against loops over all pairs; forests against a walk of their stored nodes in SQL."""

import random
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from embertrace.models import rforest
from embertrace.models.flat_forest import FlatForest, Walker
from embertrace.models.iforest import IsolationForest, average_path
from embertrace.operators.outcomes import hits_in_spans, path_outcomes, rule_outcomes, running_totals, unplanned_hits

T0 = datetime(2024, 1, 10)
SPANS = "session string, rule_id string, path string, start timestamp, end timestamp, blocked boolean, skipped boolean, kind string"
HITS = "id string, rule_id string, timestamp timestamp, kind string"


def at(minute):
    return None if minute is None else T0 + timedelta(minutes=minute)


def exercised(rng, n_spans, n_hits):
    """Half of all rows on one rule, whole minutes so that ends and hits meet, repeats, nulls, empty spans."""
    rule = lambda: rng.choice(["hot"] * 4 + ["a", "b", "gone", None])
    spans = []
    for i in range(n_spans):
        start = rng.choice([None, *range(0, 200)]) if i % 9 == 0 else rng.randrange(200)
        end = None if start is None or i % 17 == 0 else start + rng.randrange(-3, 25)
        spans.append((f"s{i % 3}", rule(), f"p{i % 4}", at(start), at(end), rng.choice([True, False, None]), rng.choice([True, False, False, None]), "own"))
    hits = [(f"h{i}", rule(), at(rng.choice([None, *range(0, 260)])), "hit") for i in range(n_hits)]
    return spans + spans[:5], hits + hits[:5]


def covers(span, hit):
    return None not in (span[1], span[3], span[4], hit[1], hit[2]) and span[1] == hit[1] and span[3] <= hit[2] <= span[4]


@pytest.mark.parametrize("seed,n_spans,n_hits", [(1, 60, 300), (2, 200, 40), (3, 0, 30), (4, 30, 0), (5, 0, 0)])
def test_outcomes_against_all_pairs(spark, seed, n_spans, n_hits):
    spans, hits = exercised(random.Random(seed), n_spans, n_hits)
    rules = spark.createDataFrame([("hot",), ("a",), ("b",), ("a",)], "rule_id string")
    paths = path_outcomes(spark.createDataFrame(spans, SPANS), spark.createDataFrame(hits, HITS), rules)
    want = []
    for s in spans:
        n = sum(covers(s, h) for h in hits)
        out = "SKIP" if s[6] or s[1] not in ("hot", "a", "b") else "PASS" if n else "PARTIAL" if s[5] else "FAIL"
        want.append((*s, n, out))
    order = lambda rows: sorted(rows, key=repr)
    columns = [c.split()[0] for c in SPANS.split(", ")] + ["n_hits", "outcome"]
    assert order(tuple(r) for r in paths.select(*columns).collect()) == order(want)

    by_rule = {}
    for w in want:
        by_rule.setdefault((w[0], w[1]), []).append(w[-1])
    got = {(r.session, r.rule_id): (r.n_paths, r.outcome) for r in rule_outcomes(paths).collect()}
    for key, outs in by_rule.items():
        ran = [o for o in outs if o != "SKIP"]
        whole = "SKIP" if not ran else "PASS" if set(ran) == {"PASS"} else "FAIL" if set(ran) == {"FAIL"} else "PARTIAL"
        assert got.pop(key) == (len(outs), whole)
    assert not got

    stray = unplanned_hits(spark.createDataFrame(spans, SPANS), spark.createDataFrame(hits, HITS))
    expected = [h[0] for h in hits if h[1] is not None and h[2] is not None and not any(covers(s, h) for s in spans)]
    assert sorted(r.id for r in stray.collect()) == sorted(expected)


def test_spans_refuse_columns_of_the_result(spark):
    with pytest.raises(ValueError, match="n_hits"):
        hits_in_spans(spark.createDataFrame([], SPANS + ", n_hits int"), spark.createDataFrame([], HITS))


def test_running_totals_over_many_partitions(spark):
    rows = spark.range(5000, numPartitions=7).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 5 - 1).alias("v"))
    got = [tuple(r) for r in running_totals(rows, [F.col("k")], ["v"]).orderBy("k").collect()]
    value = {i * 7919 % 5000: i % 5 - 1 for i in range(5000)}
    assert got == list(zip(range(5000), np.cumsum([value[k] for k in range(5000)]).tolist()))


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    xs = np.round(rng.normal(size=(400, 3)) * 4)  # whole numbers: many equal rows and ties with thresholds
    label = (xs[:, 0] + xs[:, 1] + rng.normal(size=400) > 3).astype(int)
    return spark.createDataFrame([(i, *map(float, x), int(y)) for i, (x, y) in enumerate(zip(xs, label))], "id long, a double, b double, c double, label int").cache()


def walk_sql(value):
    """Every row from the root of every tree down to its leaf, as a recursive join."""
    return f"""
WITH RECURSIVE at_node AS (
  SELECT p.id, p.x, n.* FROM points p, nodes n WHERE n.node = 0
  UNION ALL
  SELECT a.id, a.x, n.* FROM at_node a JOIN nodes n ON n.tree = a.tree
    AND n.node = CASE WHEN a.x[a.feature + 1] <= a.threshold THEN a.left_node ELSE a.right_node END WHERE a.feature >= 0)
SELECT id, avg({value}) AS m FROM at_node WHERE feature < 0 GROUP BY id"""


def walked(points, nodes, value):
    points = points.select("id", F.array("a", "b", "c").alias("x")).toPandas()  # noqa: F841: read by name below
    nodes = nodes.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("points", points)
    con.register("nodes", nodes)
    return dict(con.execute(walk_sql(value)).fetchall())


def test_flat_forest_equals_mllib_and_sql(spark, points, tmp_path):
    model = rforest.train(points, ["a", "b", "c"], trees=12, depth=8)
    flat = FlatForest.of(model)
    assert flat.nodes.count() == model.stages[1].totalNumNodes
    mllib = {r.id: r.rf_score for r in rforest.score(model, points).collect()}
    ours = {r.id: r.rf_score for r in flat.score(points, ["id"]).collect()}
    by_sql = walked(points, flat.nodes, "share")
    assert mllib.keys() == ours.keys() == by_sql.keys()
    assert all(ours[i] == pytest.approx(mllib[i], abs=1e-12) and by_sql[i] == pytest.approx(mllib[i], abs=1e-12) for i in mllib)
    assert 0.2 < max(mllib.values()) - min(mllib.values())
    flat.save(str(tmp_path / "flat"))
    again = FlatForest.load(spark, str(tmp_path / "flat"))
    assert {r.id: r.rf_score for r in again.score(points.drop("label"), ["id"]).collect()} == ours
    assert flat.score(points.limit(0), ["id"]).count() == 0
    gone = {r.id: r.rf_score for r in flat.score(points.drop("b"), ["id"]).collect()}  # a missing feature is 0
    assert gone == pytest.approx({r.id: r.rf_score for r in rforest.score(model, points.drop("b")).collect()})


def test_importance_in_batches_equals_a_row_per_variant(points):
    model = rforest.train(points, ["a", "b", "c"], trees=7, depth=6)
    fast = {r.feature: r.mean_delta for r in rforest.importance(model, points, ["id"], repeats=3).collect()}
    plain = {r.feature: r.mean_delta for r in rforest.importance_by_rows(model, points, ["id"], 3, rforest.SEED).collect()}
    assert fast == pytest.approx(plain, abs=1e-12) and any(abs(v) > 1e-4 for v in fast.values())


def test_forest_of_one_label_is_never_suspicious(points):
    model = rforest.train(points.withColumn("label", F.lit(0)), ["a", "b"], trees=3, depth=3)
    assert Walker(FlatForest.of(model).nodes.toPandas()).probability(np.zeros((2, 2))).tolist() == [0.0, 0.0]


def test_isolation_forest_scores_equal_a_walk_in_sql(points):
    model = IsolationForest.fit(points, ["id"], ["a", "b", "c"], trees=20, sample=64)
    depths = walked(points, model.nodes, "path")
    raw = {r.id: r.raw for r in model.raw(points, ["id"]).collect()}
    assert raw == pytest.approx({i: -(2 ** (-d / float(average_path(model.sample)))) for i, d in depths.items()})
    assert max(raw.values()) - min(raw.values()) > 0.05


def test_a_command_is_decoded_once(spark):
    """No step of the decoding is written twice into the plan, and texts of paired surrogates are not mended."""
    import base64

    from embertrace.operators.corroborate import decode_command, indicators

    texts = ["a\U0001f600b" * 50, "iwr x; IEX", "x\udc00y\ud800", "é" * 3000]
    rows = [(n, "p -enc " + base64.b64encode(t.encode("utf-16-le", "surrogatepass")).decode()) for n, t in enumerate(texts)]
    commands = spark.createDataFrame(rows, "n int, c string")
    decoded = commands.select("n", decode_command(F.col("c")).alias("d"))
    plan = decoded._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("-EncodedCommand") == 1 and plan.count("[A-Za-z0-9+/]*") == 1
    got = {r.n: (r.d, r.found) for r in decoded.select("n", "d", indicators(F.col("d")).alias("found")).collect()}
    assert got[0] == (texts[0], []) and got[3] == (texts[3], []) and got[2] == ("x�y�", [])
    assert got[1] == (texts[1], ["decoded:download-cradle:iwr", "decoded:execution:IEX"])


def test_findings_test_each_rule_once(spark, wide):
    """The rules stand beside the filter of the mask's bits, not inside it, where they would run once per bit."""
    from embertrace.operators.corroborate import findings_detected

    plan = findings_detected(wide({"command_line": "-enc QUJD"}))._jdf.queryExecution().optimizedPlan().toString()
    bits = [line for line in plan.split("\n") if "getbit" in line]
    assert len(bits) == 1 and "_lower_" not in bits[0]


def test_swapped_sums_walk_only_paths_that_change():
    """The Isolation Forest's change per feature is that of scoring every variant; paths that did not ask a row
    for the feature are not walked again."""
    from embertrace.models.iforest import Scorer, grow

    rng = np.random.default_rng(3)
    points = np.column_stack([rng.integers(0, k, 300) for k in (1, 2, 3, 40, 5, 2, 30)]).astype(float)
    nodes = [(t, *r) for t in range(20) for r in grow(points[rng.choice(300, 64, False)], rng, 6)]
    scorer = Scorer(pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left_node", "right_node", "path"]), 64)
    own, other = points[:200], points[100:]
    wanted = []
    for f in range(points.shape[1]):
        variant = own.copy()
        variant[:, f] = other[:, f]
        wanted.append((scorer.raw(variant) - scorer.raw(own)).sum())
    walked, paths = [], scorer.paths
    scorer.paths = lambda rows, *rest: walked.append(len(rows)) or paths(rows, *rest)
    got = scorer.swapped_sums(own, other)
    assert np.allclose(got, wanted, atol=1e-9) and got[0] == 0
    assert sum(walked) < 0.7 * len(own) * 20 * points.shape[1]
