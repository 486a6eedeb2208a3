"""Running totals, quantiles, AUC and neighbours: several slices, hot groups, brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tussis.operators import evaluate, neighbors, profile, quantiles, running


@pytest.fixture(scope="module")
def hot_rows():
    rng = random.Random(3)
    return [(i, "hot" if rng.random() < 0.8 else rng.choice("abc"), rng.choice([1.0, 2.0, 2.5, 7.0, rng.random()])) for i in range(3000)]


def test_row_numbers_with_one_hot_group(many_slices, hot_rows):
    spark = many_slices
    df = spark.createDataFrame(hot_rows, "id INT, g STRING, v DOUBLE").repartition(6)
    got = running.with_row_number(df, ["v", "id"], "n", ["g"]).collect()
    expected = {}
    for g in {r[1] for r in hot_rows}:
        for n, r in enumerate(sorted((r for r in hot_rows if r[1] == g), key=lambda r: (r[2], r[0])), 1):
            expected[r[0]] = n
    assert {r["id"]: r["n"] for r in got} == expected


def test_running_total_uses_several_slices(many_slices):
    df = many_slices.range(20000)
    out = running.with_running_totals(df, ["id"], {"s": F.col("id")}, grand_totals={"s": "all"})
    last = out.orderBy(F.desc("id")).first()
    assert last["s"] == last["all"] == sum(range(20000))
    assert out.where(F.col("s") != F.col("id") * (F.col("id") + 1) / 2).count() == 0


def test_null_group(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id INT, g STRING")
    assert {r["id"]: r["n"] for r in running.with_row_number(df, ["id"], "n", ["g"]).collect()} == {1: 1, 2: 2, 3: 1}


def test_quantiles_match_numpy(many_slices, hot_rows):
    df = many_slices.createDataFrame(hot_rows, "id INT, g STRING, v DOUBLE")
    got = {r["g"]: r for r in quantiles.exact_quantiles(df, ["v"], {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}, ["g"]).collect()}
    for g in got:
        values = [r[2] for r in hot_rows if r[1] == g]
        np.testing.assert_allclose([got[g][x] for x in "abcde"], np.quantile(values, [0, 0.25, 0.5, 0.9, 1.0]))


def test_quantiles_inside_sketch_brackets(many_slices):
    """Enough rows that brackets, not whole groups, are counted; one far outlier, ties and a group of its own."""
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=90_000), np.full(40_000, 0.25), [1e12], np.arange(300.0)])
    g = np.array(["big"] * 130_001 + ["small"] * 300)
    order = rng.permutation(len(v))
    df = many_slices.createDataFrame(list(zip(g[order].tolist(), v[order].tolist())), "g STRING, v DOUBLE").repartition(5)
    wanted = {"a": 0.0, "b": 0.0001, "c": 0.25, "d": 0.5, "e": 0.77, "f": 0.9999, "h": 1.0}
    for by, parts in ((["g"], {x: v[g == x] for x in ("big", "small")}), ([], {None: v})):
        for r in quantiles.exact_quantiles(df, ["v"], wanted, by).collect():
            values = parts[r["g"] if by else None]
            np.testing.assert_allclose([r[x] for x in wanted], np.quantile(values, list(wanted.values())))
            np.testing.assert_allclose(r["d"], np.median(values), rtol=1e-12)


def test_quantiles_of_single_and_null(spark):
    df = spark.createDataFrame([(4.0, None), (None, None)], "v DOUBLE, w DOUBLE")
    assert [(r["column_name"], r["m"]) for r in quantiles.exact_quantiles(df, ["v", "w"], {"m": 0.5}).collect()] == [("v", 4.0)]


@pytest.mark.parametrize("values", [
    [1e308, -1e308, 0.0, 5.0], [float("inf"), 1.0, 2.0, 3.0, float("-inf")], [7.0] * 9, [1e-300, 2e-300, 3.0, 3.0000000001, 1e12], [0.1 * i for i in range(257)],
])
def test_quantiles_of_extreme_values(spark, values):
    df = spark.createDataFrame([(v, None) for v in values], "v DOUBLE, g STRING")
    probabilities = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 1.0}
    row = quantiles.exact_quantiles(df, ["v"], probabilities, ["g"]).first()
    for name, p in probabilities.items():
        at = p * (len(values) - 1)
        lo, hi = sorted(values)[int(np.floor(at))], sorted(values)[int(np.ceil(at))]
        assert row[name] == (lo if lo == hi else pytest.approx(lo + (hi - lo) * (at - np.floor(at)))), name
    assert row["g"] is None


def test_describe_of_all_null_column(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None)], "v DOUBLE, w DOUBLE")
    rows = {r["column_name"]: r for r in profile.describe(df, ["v", "w"]).collect()}
    assert (rows["v"]["q50"], rows["w"]["count"], rows["w"]["q50"]) == (2.0, 0, None)


def test_auc_against_pairs(many_slices):
    rng = random.Random(5)
    rows = [(rng.randint(0, 1), rng.randint(0, 20) / 20) for _ in range(400)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    expected = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    got = evaluate.roc_auc(many_slices.createDataFrame(rows, "y INT, s DOUBLE"), "y", "s").first()["auc"]
    assert got == pytest.approx(expected)


def test_auc_of_one_class_is_null(spark):
    assert evaluate.roc_auc(spark.createDataFrame([(1, 0.2), (1, 0.3)], "y INT, s DOUBLE"), "y", "s").first()["auc"] is None


def test_metrics_with_zero_denominators(spark):
    m = evaluate.binary_metrics(spark.createDataFrame([(0, 0), (0, 0)], "y INT, p INT"), "y", "p").first()
    assert (m["accuracy"], m["precision"], m["recall"], m["f1_score"]) == (1.0, 0.0, 0.0, 0.0)


def _points(n, groups, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 5, size=(6, 4))
    return [
        (i, str(rng.integers(groups)), (centres[i % 6] + np.round(rng.normal(0, 1, 4), 1)).tolist())
        for i in range(n)
    ]


def _brute(points, k, by):
    out = {}
    for i, g, x in points:
        d = sorted((round(float(np.linalg.norm(np.subtract(x, y))), 9), j) for j, h, y in points if j != i and (not by or h == g))
        out[i] = [j for _, j in d[:k]]
    return out


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("rows", [neighbors.BLOCK_ROWS, 16])
def test_neighbors_exact_in_one_and_many_blocks(spark, by, rows):
    points = _points(260, 3)
    df = spark.createDataFrame(points, "id INT, g STRING, x ARRAY<DOUBLE>")
    got = neighbors.nearest_neighbors(
        df, df, 4, query_id="id", corpus_id="id", vector="x", by=by, exclude_same=True, block_rows=rows
    ).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["neighbor_id"])
    assert found == _brute(points, 4, by)


def test_neighbors_of_identical_points_fill_several_blocks(spark):
    """One place holds every row; ties go to the smaller id."""
    df = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(100)], "id INT, x ARRAY<DOUBLE>")
    got = neighbors.nearest_neighbors(df, df, 3, query_id="id", corpus_id="id", vector="x", exclude_same=True, block_rows=10)
    rows = {r["query_id"]: r["ids"] for r in got.groupBy("query_id").agg(F.sort_array(F.collect_list("neighbor_id")).alias("ids")).collect()}
    assert rows[50] == [0, 1, 2] and rows[1] == [0, 2, 3] and len(rows) == 100


@pytest.mark.parametrize("by", [[], ["g"]])
def test_neighbors_of_an_empty_corpus(spark, by):
    df = spark.createDataFrame([(1, "a", [0.0])], "id INT, g STRING, x ARRAY<DOUBLE>")
    assert neighbors.nearest_neighbors(df, df.where("false"), 2, query_id="id", corpus_id="id", vector="x", by=by).count() == 0


def test_profiles_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a DOUBLE, g STRING")
    assert [r["missing_count"] for r in profile.missingness(df).collect()] == [0, 0]
    assert profile.completeness(df).first()["complete_pct"] is None
    assert profile.value_counts(df, "g").count() == 0
    assert profile.describe(df, ["a"]).first()["count"] == 0
    assert profile.duplicate_rows(df).first()[0] == 0
    assert profile.histogram(df, "a", 3).agg(F.sum("n")).first()[0] == 0
    assert quantiles.exact_quantiles(df, ["a"], {"m": 0.5}).count() == 0


def test_neighbors_in_groups_smaller_than_k(spark):
    df = spark.createDataFrame([(1, "a", [0.0]), (2, "a", [1.0]), (3, "b", [9.0])], "id INT, g STRING, x ARRAY<DOUBLE>")
    for rows in (100, 1):
        got = neighbors.nearest_neighbors(df, df, 5, query_id="id", corpus_id="id", vector="x", by=["g"], exclude_same=True, block_rows=rows).collect()
        assert sorted((r["query_id"], r["neighbor_id"]) for r in got) == [(1, 2), (2, 1)]


def test_approximate_neighbors_recall(spark):
    """Clustered points: nine in ten of the exact neighbours share a bucket."""
    rng = np.random.default_rng(7)
    centres = rng.normal(scale=20, size=(12, 16))
    points = [(i, (centres[i % 12] + rng.normal(size=16)).tolist()) for i in range(600)]
    df = spark.createDataFrame(points, "id INT, x ARRAY<DOUBLE>")
    names = {"query_id": "id", "corpus_id": "id", "vector": "x"}
    exact = {(r.query_id, r.neighbor_id) for r in neighbors.nearest_neighbors(df, df, 5, **names).collect()}
    found = {(r.query_id, r.neighbor_id) for r in neighbors.approximate_neighbors(df, df, 5, radius=12.0, bucket_length=8.0, **names).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_distance_vote_prefers_exact_matches(spark):
    near = spark.createDataFrame([(1, 10, 0.0), (1, 11, 1.0), (2, 11, 1.0), (2, 12, 3.0)], "query_id INT, neighbor_id INT, distance DOUBLE")
    labels = spark.createDataFrame([(10, 0), (11, 1), (12, 0)], "id INT, y INT")
    got = {r["query_id"]: r["disease_probability"] for r in neighbors.distance_vote(near, labels, "id", "y").collect()}
    assert got[1] == 0.0 and got[2] == pytest.approx(0.75)
