"""Models over process windows, at the library's own settings.

Another engine cannot grow the same trees, but it can say what must hold of them: which rows a tree draws,
what the scores of the training rows span, how many rows each fold and model has, which features cannot
matter. A query returns those facts as computed from the model; its SQL derives them from the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embertrace.checks.feature_checks import _window_sql
from embertrace.checks.oracle import with_tel
from embertrace.checks.registry import Tables, query
from embertrace.models import rforest
from embertrace.models.flat_forest import FlatForest
from embertrace.models.iforest import SAMPLE, SEED, TREES, IsolationForest, tree_samples
from embertrace.models.scoring import score_events, score_windows
from embertrace.operators.features import FEATURES, FOREST_FEATURES, window_features_live
from embertrace.session import cut_lineage

KEYS = ["image", "pid"]
_kept: dict[tuple, object] = {}


def _keep(t: Tables, name: str, make):
    """Training input and fitted models, made once per session and scale."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir, name)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def windows(t: Tables) -> DataFrame:
    return _keep(t, "windows", lambda: cut_lineage(window_features_live(t.telemetry)))


def forest(t: Tables) -> IsolationForest:
    return _keep(t, "forest", lambda: IsolationForest.fit(windows(t), KEYS))


def labelled_windows(t: Tables) -> DataFrame:
    """Label 1: more hits than the mean window, in whole numbers."""
    n, hits = _keep(t, "mean", lambda: windows(t).agg(F.count("*"), F.sum("rule_hit_count")).first())
    return windows(t).withColumn("label", (F.col("rule_hit_count") * n > (hits or 0)).cast("int"))


def classifier(t: Tables):
    return _keep(t, "classifier", lambda: rforest.train(labelled_windows(t)))


def folds(t: Tables) -> DataFrame:
    return _keep(t, "folds", lambda: rforest.cross_validate(labelled_windows(t), KEYS))


def inside(score: str):
    return F.col(score).between(0.0, 1.0).cast("bigint").alias("in_range")


def with_windows(body: str, columns: list[str] = FEATURES) -> str:
    return f"WITH w AS MATERIALIZED ({_window_sql('true', columns)}), l AS (SELECT *, CAST(rule_hit_count * (SELECT count(*) FROM w) > (SELECT sum(rule_hit_count) FROM w) AS BIGINT) AS label FROM w)\n{body}"


def constant_sql(names: list[str]) -> str:
    return with_windows(" UNION ALL ".join(
        f"SELECT '{f}' AS feature, CAST(count(DISTINCT {f}) = 1 AS BIGINT) AS constant, CAST(0 AS BIGINT) AS moved FROM w" for f in names))


def importance_facts(ranked: DataFrame, t: Tables, names: list[str]) -> DataFrame:
    """Each feature, whether it is constant, and whether a constant one seems to matter."""
    kinds = windows(t).agg(*[(F.min(f) == F.max(f)).cast("bigint").alias(f) for f in names])
    kinds = kinds.unpivot([], names, "feature", "constant")
    return ranked.join(kinds, "feature").select("feature", "constant", ((F.col("constant") == 1) & (F.col("mean_delta") != 0)).alias("moved"))


@query("m_if_train", with_windows(f"""
, pool AS (SELECT image, pid, row_number() OVER (ORDER BY lot, image, pid) - 1 AS place FROM (
  SELECT image, pid, md5('{SEED}:' || coalesce(image, '') || ':' || coalesce(CAST(pid AS VARCHAR), '')) AS lot FROM w) x QUALIFY place < {TREES * SAMPLE}),
size AS (SELECT count(*) AS n FROM pool)
SELECT CAST(i // {SAMPLE} AS BIGINT) AS tree, image, pid FROM range({TREES * SAMPLE}) r(i), size JOIN pool ON place = i % n WHERE i % {SAMPLE} < n"""))
def m_if_train(t: Tables):
    """The rows that each tree of the fitted forest was grown from."""
    grown = forest(t).nodes.filter("node = 0").select("tree")
    return tree_samples(windows(t).select(*KEYS), KEYS).join(grown, "tree").select("tree", *KEYS)


@query("m_if_bounds", with_windows(f"SELECT CAST({TREES} AS BIGINT) AS trees, least(count(*), {SAMPLE}) AS sample, CAST(1 AS BIGINT) AS ordered FROM w"))
def m_if_bounds(t: Tables):
    """Raw scores lie in (-1, 0) and their kept bounds are in order."""
    ordered = (F.col("train_score_min") < F.col("train_score_max")) & (F.col("train_score_min") > -1) & (F.col("train_score_max") < 0)
    trees = forest(t).nodes.agg(F.countDistinct("tree")).first()[0]
    return forest(t).bounds().select(F.lit(trees).alias("trees"), F.lit(forest(t).sample).alias("sample"), ordered.alias("ordered"))


@query("m_if_score", with_windows("SELECT image, pid, CAST(1 AS BIGINT) AS in_range FROM w"))
def m_if_score(t: Tables):
    return forest(t).score(windows(t), KEYS).select(*KEYS, inside("score"))


@query("m_if_report", with_windows("SELECT 0.0::DOUBLE AS score_min, 1.0::DOUBLE AS score_max, count(*) AS n_total, CAST(1 AS BIGINT) AS mean_inside FROM w"))
def m_if_report(t: Tables):
    """The training rows' own scores reach both ends of the scale."""
    return forest(t).report(windows(t)).select("score_min", "score_max", "n_total", F.col("score_mean").between(0.0, 1.0).alias("mean_inside"))


@query("m_if_importance", constant_sql(FEATURES))
def m_if_importance(t: Tables):
    return importance_facts(forest(t).importance(windows(t), KEYS), t, FEATURES)


@query("m_rf_train", with_windows("SELECT label, count(*) AS n, CAST(1 AS BIGINT) AS on_its_side FROM l GROUP BY label"))
def m_rf_train(t: Tables):
    """The training rows of each label are scored on their label's side on average."""
    scored = rforest.score(classifier(t), labelled_windows(t))
    means = scored.groupBy("label").agg(F.count("*").alias("n"), F.avg("rf_score").alias("m"))
    return means.select("label", "n", ((F.col("m") > 0.5) == (F.col("label") == 1)).alias("on_its_side"))


@query("m_rf_score", with_windows("SELECT image, pid, CAST(1 AS BIGINT) AS in_range FROM w"))
def m_rf_score(t: Tables):
    return rforest.score(classifier(t), windows(t)).select(*KEYS, inside("rf_score"))


@query("m_rf_flat", with_windows("SELECT image, pid, CAST(1 AS BIGINT) AS agrees FROM w"))
def m_rf_flat(t: Tables):
    """The node table gives every window the probability that MLlib gives it."""
    both = FlatForest.of(classifier(t)).score(rforest.score(classifier(t), windows(t)), [*KEYS, "rf_score"], "flat")
    return both.select(*KEYS, (F.abs(F.col("flat") - F.col("rf_score")) < 1e-9).alias("agrees"))


@query("m_rf_cv", with_windows(f"""
, c AS (SELECT count(*) FILTER (WHERE label = 0) AS zeros, count(*) AS n FROM l)
SELECT CAST(i % {rforest.FOLDS} AS BIGINT) AS fold, count(*) FILTER (WHERE i < zeros) AS benign, count(*) FILTER (WHERE i >= zeros) AS suspicious,
  CAST(1 AS BIGINT) AS better_than_chance FROM c, range((SELECT n FROM c)) r(i) GROUP BY 1"""))
def m_rf_cv(t: Tables):
    """Sizes of the stratified folds, and that each fold's held-out ranking beats chance."""
    sizes = rforest.with_folds(labelled_windows(t).select(*KEYS, "label"), KEYS).groupBy("fold").agg(
        F.count_if(F.col("label") == 0).alias("benign"), F.count_if(F.col("label") == 1).alias("suspicious"))
    return sizes.join(folds(t), "fold").select("fold", "benign", "suspicious", (F.col("roc_auc") > 0.5).alias("better_than_chance"))


@query("m_rf_importance", constant_sql(FOREST_FEATURES))
def m_rf_importance(t: Tables):
    return importance_facts(rforest.importance(classifier(t), windows(t), KEYS), t, FOREST_FEATURES)


@query("m_rf_metrics", with_windows(f"""
SELECT label, count(*) AS n, CAST({rforest.FOLDS} AS BIGINT) AS folds, CAST(1 AS BIGINT) AS means_inside FROM l GROUP BY label"""))
def m_rf_metrics(t: Tables):
    """Rows per label beside the number of folds; all cross-validated means lie in 0 to 1."""
    means = folds(t).agg(F.count("*").alias("folds"), *[F.avg(m).alias(m) for m in ("precision", "recall", "f1", "roc_auc")]).first()
    good = all(0 <= means[m] <= 1 for m in ("precision", "recall", "f1", "roc_auc"))
    counts = labelled_windows(t).groupBy("label").agg(F.count("*").alias("n"))
    return counts.select("label", "n", F.lit(means["folds"]).alias("folds"), F.lit(good).alias("means_inside"))


MODELS_SQL = "(VALUES ('isolation_forest'), ('random_forest')) m(model_type)"


@query("m_score_events", with_tel(f"SELECT id AS event_fk, model_type, CAST(1 AS BIGINT) AS in_range FROM tel, {MODELS_SQL}"))
def m_score_events(t: Tables):
    return score_events(t.telemetry, forest(t), classifier(t)).select("event_fk", "model_type", inside("score"))


@query("m_score_windows", with_windows(f"SELECT image, pid, model_type, CAST(1 AS BIGINT) AS in_range FROM w, {MODELS_SQL}"))
def m_score_windows(t: Tables):
    return score_windows(windows(t), forest(t), classifier(t)).select(*KEYS, "model_type", inside("score"))
