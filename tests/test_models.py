"""Balancing, leak-free parts, and every classifier family on separable data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tussis.operators import balance, models, prepare


def rows_of(spark, sizes, dims=3, seed=0):
    rng = np.random.default_rng(seed)
    rows, at = [], 0
    for target, n in sizes.items():
        for _ in range(n):
            rows.append((at, target, (rng.normal(0, 1, dims) + 4.0 * target).tolist()))
            at += 1
    return spark.createDataFrame(rows, "id INT, target INT, x ARRAY<DOUBLE>")


def test_synthetic_sizes_and_ranges(spark):
    df = rows_of(spark, {0: 1, 1: 3, 2: 130})
    out = balance.balanced(df, "id", "target", "x")
    assert {r["target"]: r["count"] for r in out.groupBy("target").count().collect()} == {0: 120, 1: 120, 2: 130}
    base = df.where("target = 0").first()["x"]
    near = out.where("target = 0 AND synthetic").select("x").collect()
    assert max(abs(v - b) for r in near for v, b in zip(r["x"], base)) < 0.1


def test_synthetic_rows_are_reproducible(spark):
    df = rows_of(spark, {0: 8, 1: 20})
    one = balance.synthesize(df, "id", "target", "x", per_class=20).orderBy("class", "draw").collect()
    two = balance.synthesize(df.repartition(5), "id", "target", "x", per_class=20).orderBy("class", "draw").collect()
    assert one == two and len(one) == 12
    assert len({(r["base_id"], r["neighbor_id"]) for r in one}) > 3
    assert all(r["neighbor_id"] is not None and r["neighbor_id"] != r["base_id"] for r in one)


def test_jitter_is_standard_normal(spark):
    v = spark.range(20000).select(balance.gaussian(42, F.col("id")).alias("g"), balance.uniform(1, F.col("id")).alias("u"))
    m = v.agg(F.avg("g"), F.stddev("g"), F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(m[0]) < 0.03 and abs(m[1] - 1) < 0.03 and abs(m[2] - 0.5) < 0.01 and 0 <= m[3] and m[4] < 1


def test_folds_are_balanced_and_stable(spark):
    df = rows_of(spark, {0: 33, 1: 12})
    folds = balance.stratified_folds(df, "id", "target")
    sizes = folds.groupBy("target", "fold").count().collect()
    for t in (0, 1):
        n = [r["count"] for r in sizes if r["target"] == t]
        assert len(n) == 5 and max(n) - min(n) <= 1
    again = balance.stratified_folds(df.repartition(7), "id", "target")
    assert sorted(map(tuple, folds.select("id", "fold").collect())) == sorted(map(tuple, again.select("id", "fold").collect()))


def test_scaling_and_balancing_use_training_rows_only(spark):
    df = rows_of(spark, {0: 20, 1: 10})
    poisoned = df.withColumn("x", F.when(F.col("id") % 5 == 0, F.transform("x", lambda v: v + 1e6)).otherwise(F.col("x")))
    part = models.ready_part(poisoned, F.col("id") % 5 == 0, "id", "target", "x", 40, 42)
    values = [max(abs(v) for v in r["features"]) for r in part.train.select("features").collect()]
    assert max(values) < 10 and part.train.count() == 80 and part.test.count() == 6
    assert not {r["row_key"] for r in part.train.collect()} & {r["row_key"] for r in part.test.collect()}


def test_population_scaling_and_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (4.0, 5.0)], "a DOUBLE, b DOUBLE")
    out = prepare.standardize(df, ["a", "b"]).orderBy("a").collect()
    np.testing.assert_allclose([r["a"] for r in out], (np.arange(1, 5) - 2.5) / np.arange(1, 5).std())
    assert [r["b"] for r in out] == [0.0] * 4


def test_one_hot_unknown_is_all_zero(spark):
    df = spark.createDataFrame([("b",), ("a",), ("zz",), (None,)], "g STRING")
    out = prepare.one_hot(df, "g", ["a", "b"]).select("g_a", "g_b").collect()
    assert sorted(map(tuple, out)) == [(0.0, 0.0), (0.0, 0.0), (0.0, 1.0), (1.0, 0.0)]


@pytest.fixture(scope="module")
def part(spark):
    df = rows_of(spark, {0: 60, 1: 30})
    return models.ready_part(df, F.col("id") % 4 == 0, "id", "target", "x", 50, 42)


@pytest.mark.parametrize("family", list(models.model_families(models.QUICK)))
def test_family_separates(spark, part, family):
    model = models.model_families(models.QUICK)[family](part.train)
    scored = model.score(part.test, "p").collect()
    assert all(0.0 <= r["p"] <= 1.0 for r in scored)
    right = sum((r["p"] > 0.5) == (r["target"] == 1.0) for r in scored) / len(scored)
    assert right >= 0.9, family


def test_leaderboard_reports_failures(spark):
    def broken(train):
        raise RuntimeError("does not fit")

    df = rows_of(spark, {0: 30, 1: 30})
    wanted = {"decision_tree": models.decision_tree(models.QUICK), "broken": broken}
    out = {r["model"]: r for r in models.train_and_evaluate(df, wanted, key="id", target="target", vector="x", folds=0, per_class=10).collect()}
    assert out["decision_tree"]["accuracy"] >= 0.9 and out["decision_tree"]["error"] is None
    assert out["broken"]["accuracy"] is None and "does not fit" in out["broken"]["error"]


@pytest.mark.parametrize("family", ["decision_tree", "adaboost", "svc", "knn", "voting_ensemble"])
def test_stored_families_score_the_same(spark, part, family, tmp_path):
    model = models.model_families(models.QUICK)[family](part.train)
    models.save_fitted(model, str(tmp_path / family), part.scaling)
    again, scaling = models.load_fitted(spark, str(tmp_path / family))
    assert scaling == part.scaling and again.name == model.name
    one = model.score(part.test, "p").select("row_key", F.round("p", 9)).collect()
    two = again.score(part.test, "p").select("row_key", F.round("p", 9)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_leaderboard_stores_models_and_summary(spark, tmp_path):
    from tussis.operators import leaderboard
    from tussis.sources import sidecars, sinks

    df = rows_of(spark, {0: 25, 1: 25})
    wanted = {"decision_tree": models.decision_tree(models.QUICK), "logistic": models.logistic(models.QUICK)}
    board = models.train_and_evaluate(df, wanted, key="id", target="target", vector="x", folds=0, per_class=10, model_folder=str(tmp_path))
    sinks.write_model_summary(board, str(tmp_path / "summary"))
    back = sidecars.model_summary_rows(spark.read.text(str(tmp_path / "summary")), "value").withColumn("filename", F.col("model"))
    best = leaderboard.choose_best(back).first()
    model, scaling = models.load_fitted(spark, best["path"])
    assert best["accuracy"] == back.agg(F.max("accuracy")).first()[0] and scaling is not None
    assert model.name == best["model"]


def test_stored_model_of_other_width_is_refused(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    df = spark.createDataFrame([(0.0, 1.0), (1.0, 0.0)], "a DOUBLE, label DOUBLE")
    path = str(tmp_path / "m")
    models.save_model(Pipeline(stages=[VectorAssembler(inputCols=["a"], outputCol="features"), LogisticRegression(maxIter=2)]).fit(df), path)
    assert models.load_compatible(spark, path, 1).transform(df).count() == 2
    with pytest.raises(ValueError):
        models.load_compatible(spark, path, 3)


def test_long_and_wide_votes_agree(spark):
    from tussis.functions import scoring
    from tussis.operators import evaluate

    probabilities = [(i, 0.1 * (i % 11), 0.5, 0.07 * (i % 15), 0.9 if i % 2 else 0.2) for i in range(40)]
    df = spark.createDataFrame(probabilities, "i INT, a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE")
    wide = df.select("i", scoring.consensus([scoring.predicted(F.col(c), True) for c in "abcd"]).alias("v")).select("i", "v.*")
    long = evaluate.consensus(df.select("i", F.inline(scoring.model_rows({c: F.col(c) for c in "abcd"}))), "i")
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, long.collect()))
    assert {r["consensus"] for r in wide.where("disease_votes = 2").collect()} == {"Healthy signal"}


def test_families_side_by_side_are_fitted_once(spark, folder, monkeypatch):
    """The ensemble takes over its members' fits, and all growers share one table of training rows."""
    from tussis.plans import training_plans as P

    calls = []
    monkeypatch.setattr(models.trees, "training", lambda *a, plain=models.trees.training, **b: calls.append(1) or plain(*a, **b))
    monkeypatch.setattr(P, "_FAMILIES", models.model_families(models.QUICK))
    rows = P.compare_fitted(spark, folder)
    assert len(calls) == 1 and {r.model for r in rows.select("model").distinct().collect()} == set(P._FAMILIES)
