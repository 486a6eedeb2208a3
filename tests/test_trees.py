"""Trees of all parts at once: equal to part by part, to any way of spreading rows, and to plain reference growers."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tussis.operators import boosting, trees


def overlapping(n, dims=5, seed=0, shift=0.8):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.4).astype(int)
    return rng.normal(size=(n, dims)) + shift * y[:, None] * (np.arange(dims) < 2), y


def frame(spark, x, y, first=0):
    rows = [(f"r{first + i}", int(t), [float(v) for v in row]) for i, (row, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "row_key string, target int, x array<double>").withColumn("features", array_to_vector("x"))


@pytest.fixture(scope="module")
def sets(spark):
    made = [overlapping(140, seed=1), overlapping(90, seed=2), overlapping(60, seed=3)]
    return made, [frame(spark, x, y, 1000 * i).persist() for i, (x, y) in enumerate(made)]


SPECS = {
    "forest": trees.TreeSpec(trees=4, depth=5, features=-1, bootstrap=True, min_split=3),
    "tree": trees.TreeSpec(trees=1, depth=6),
    "bagging": trees.TreeSpec(trees=3, depth=30, bootstrap=True, weighted=False),
    "extra": trees.TreeSpec(trees=4, depth=6, features=-1, random_cuts=True, min_split=3),
}


def told(forest):
    return {part: [(t.cuts, t.counts) for t in grown] for part, grown in forest.items()}


@pytest.mark.parametrize("name", list(SPECS))
def test_all_parts_at_once_equal_part_by_part_and_level_by_level(spark, sets, name):
    spec, (_, frames) = SPECS[name], sets
    joint = trees.grow(trees.training(frames), spec)
    assert told(joint) == told(trees.grow(trees.training([f.repartition(5) for f in frames]), spec, small=25))
    for part, one in enumerate(frames):
        assert told(joint)[part] == told(trees.grow(trees.training([one]), spec))[0]


def plain_tree(x, y, weights, depth, min_split):
    """Exact tree by midpoints: {node: (feature, cut)}."""
    cuts, waiting = {}, [(1, np.arange(len(y)))]
    while waiting:
        node, rows = waiting.pop()
        if node.bit_length() > depth or len(rows) < min_split or len(set(y[rows])) < 2:
            continue
        best = (1e-9, None)
        for f in range(x.shape[1]):
            values = np.unique(x[rows, f])
            for cut in (values[:-1] + values[1:]) / 2:
                left = x[rows, f] <= cut
                gain = 0.0
                for side, sign in ((left, 1), (~left, 1), (np.ones(len(rows), bool), -1)):
                    w = np.array([(y[rows][side] == c).sum() for c in (0, 1)]) * weights
                    gain += sign * (w**2).sum() / w.sum()
                if round(gain, 9) > round(best[0], 9):
                    best = (gain, (f, cut))
        if best[1]:
            cuts[node] = best[1]
            left = x[rows, best[1][0]] <= best[1][1]
            waiting += [(2 * node, rows[left]), (2 * node + 1, rows[~left])]
    return cuts


def test_tree_equals_exact_search_on_discrete_columns(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, size=(160, 4)).astype(float)
    y = ((x[:, 0] + x[:, 1] + rng.normal(0, 1.5, 160)) > 5).astype(int)
    data = trees.training([frame(spark, x, y)])
    grown = trees.grow(data, trees.TreeSpec(trees=1, depth=4))[0][0]
    expected = plain_tree(x, y, data.weights(0, True), 4, 2)
    sides = {n: tuple(sorted(x[:, f] <= cut)) for n, (f, cut) in expected.items()}
    assert {n: f for n, (f, _, _) in grown.cuts.items()} == {n: f for n, (f, _) in expected.items()}
    assert {n: tuple(sorted(x[:, f] <= cut)) for n, (f, cut, _) in grown.cuts.items()} == sides
    at = trees.where_now(grown, x)
    for node in set(at):
        assert grown.counts[node] == ((y[at == node] == 0).sum(), (y[at == node] == 1).sum())


def test_extra_trees_equal_brute_force(spark):
    x, y = overlapping(120, seed=9)
    spec = SPECS["extra"]
    data = trees.training([frame(spark, x, y)])
    weights = data.weights(0, True)
    for tree, grown in enumerate(trees.grow(data, spec)[0]):
        waiting, cuts = [(1, np.arange(120))], {}
        while waiting:
            node, rows = waiting.pop()
            if len(bin(node)) - 3 >= spec.depth or len(rows) < 3 or len(set(y[rows])) < 2:
                continue
            order = sorted(range(5), key=lambda f: int(trees.mixed(42, 2, tree, node, np.array([f]))[0]))
            best = (1e-9, None)
            for f in sorted(order[:2]):
                low, high = x[rows, f].min(), x[rows, f].max()
                cut = low + float(trees.uniforms(42, 3, tree, node, np.array([f]))[0]) * (high - low)
                gain = 0.0
                for side, sign in ((x[rows, f] <= cut, 1), (x[rows, f] > cut, 1), (np.ones(len(rows), bool), -1)):
                    w = np.array([(y[rows][side] == c).sum() for c in (0, 1)]) * weights
                    gain += sign * (w**2).sum() / w.sum() if w.sum() else -math.inf
                if round(gain, 9) > round(best[0], 9):
                    best = (gain, (f, cut))
            if best[1]:
                cuts[node] = best[1]
                left = x[rows, best[1][0]] <= best[1][1]
                waiting += [(2 * node, rows[left]), (2 * node + 1, rows[~left])]
        assert {n: c[:2] for n, c in grown.cuts.items()} == cuts


def plain_adaboost(x, y, rounds, rate):
    w, out = np.ones(len(y)), []
    for _ in range(rounds):
        best = (-1.0, None)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[:-1] + values[1:]) / 2:
                low = x[:, f] <= cut
                sides = [np.array([w[s & (y == c)].sum() for c in (0, 1)]) / w.sum() for s in (low, ~low)]
                pure = round(sum((s**2).sum() / s.sum() for s in sides), 9)
                if pure > best[0]:
                    best = (pure, (f, cut, int(sides[0][1] > sides[0][0]), int(sides[1][1] > sides[1][0])))
        f, cut, a, b = best[1]
        wrong = np.where(x[:, f] <= cut, a, b) != y
        error = w[wrong].sum() / w.sum()
        alpha = rate * math.log((1 - error) / error)
        out.append((f, cut, a, b, alpha))
        w = w * np.exp(alpha * wrong)
    return out


@pytest.mark.parametrize("small", [20_000, 0])
def test_stumps_equal_plain_boosting(spark, sets, small):
    made, frames = sets
    found = boosting.adaboost(trees.training([f.repartition(4) for f in frames]), 6, 0.5, small)
    for part, (x, y) in enumerate(made):
        expected = plain_adaboost(x, y, 6, 0.5)
        assert [(s["feature"], s["low"], s["high"]) for s in found[part]] == [(e[0], e[2], e[3]) for e in expected]
        np.testing.assert_allclose([[s["threshold"], s["alpha"]] for s in found[part]], [[e[1], e[4]] for e in expected], rtol=1e-9)


def test_stumps_end_on_separable_rows(spark):
    x = np.arange(20, dtype=float)[:, None]
    for small in (20_000, 0):
        stumps = boosting.adaboost(trees.training([frame(spark, x, (x[:, 0] > 7).astype(int))]), 5, 0.5, small)[0]
        assert len(stumps) == 1 and stumps[0]["alpha"] == 1.0 and stumps[0]["threshold"] == 7.5


def test_gradient_trees_equal_level_by_level_and_lower_the_loss(spark, sets):
    made, frames = sets
    data = trees.training([f.repartition(4) for f in frames])
    near, far = boosting.gradient_trees(data, 5, 3, 0.3), boosting.gradient_trees(data, 5, 3, 0.3, small=0)
    assert near == far
    for part, (x, y) in enumerate(made):
        forest = boosting.as_arrays(near[part]["forest"])
        steps = near[part]["base"] + np.cumsum(np.hstack([np.zeros((len(y), 1)), trees.leaves(forest, x)]), axis=1)
        loss = np.log1p(np.exp(-steps * (2 * y - 1)[:, None])).mean(axis=0)
        assert (np.diff(loss) < 0).all() and len(forest["roots"]) == 5


def test_first_gradient_tree_equals_squared_error_search(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 5, size=(150, 3)).astype(float)
    y = ((x[:, 0] * 2 + x[:, 2] + rng.normal(0, 2, 150)) > 6).astype(int)
    found = boosting.gradient_trees(trees.training([frame(spark, x, y)]), 1, 1, 1.0)[0]["forest"]
    r = y - y.mean()
    best = max(((round(sum(r[s].sum() ** 2 / s.sum() for s in (x[:, f] <= c, x[:, f] > c)), 7), -f, -c) for f in range(3) for c in (0.5, 1.5, 2.5, 3.5)))
    assert (found["f"][0], found["t"][0]) == (-best[1], -best[2])
    p = y.mean()
    left = x[:, found["f"][0]] <= found["t"][0]
    np.testing.assert_allclose([found["v"][i] for i in (1, 2)], [r[s].sum() / (s.sum() * p * (1 - p)) for s in (left, ~left)], rtol=1e-6)


def test_drawn_rows_are_a_poisson_sample():
    spec = trees.TreeSpec(bootstrap=True)
    drawn = trees.multiplicity(spec, 3, np.arange(50_000))
    assert abs(drawn.mean() - 1) < 0.02 and abs((drawn == 0).mean() - math.exp(-1)) < 0.01
    assert (drawn != trees.multiplicity(spec, 4, np.arange(50_000))).any()


def test_constant_columns_single_class_and_empty_parts(spark):
    x, y = np.ones((30, 2)), np.array([0, 1] * 15)
    empty = frame(spark, x, y).filter(F.lit(False))
    data = trees.training([frame(spark, x, y), frame(spark, np.arange(20.0)[:, None].repeat(2, 1), np.ones(20, int), 100), empty])
    grown = trees.grow(data, trees.TreeSpec(trees=2, depth=3, bootstrap=True))
    assert not grown[0][0].cuts and not grown[1][0].cuts and not grown[2][0].counts
    assert boosting.adaboost(data, 3, 0.5)[2] == [] and len(boosting.gradient_trees(data, 2, 2, 0.1)[0]["forest"]["roots"]) == 2


def test_parts_within_the_bytes_of_a_task_are_boosted_by_one_job(spark, monkeypatch):
    """Rounds that need the round before are no jobs of their own where a task holds the part's bins."""
    x, y = overlapping(21_000, dims=2, seed=8)
    data = trees.training([frame(spark, x, y)])
    far = boosting.gradient_trees(data, 2, 2, 0.3, small=0)
    monkeypatch.setattr(boosting, "_distributed_step", None)
    assert boosting.gradient_trees(data, 2, 2, 0.3) == far
