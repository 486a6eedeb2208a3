"""The kernel machine and its calibration against brute force, stochastic descent against the exact solution."""

import math

import numpy as np
import pytest
from test_trees import frame, overlapping

from tussis.operators import descent, kernel, trees


def rings(n, seed):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.5).astype(int)
    angle, radius = rng.uniform(0, 2 * math.pi, n), 1.0 + 1.2 * y + rng.normal(0, 0.35, n)
    return np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=1), y


def plain_dual(z, y, caps, steps=4000):
    """Projected ascent on the dual of a small problem: the value and the weights."""
    q = (z * y[:, None]) @ (z * y[:, None]).T
    alpha, rate = np.zeros(len(y)), 1.0 / np.linalg.eigvalsh(q).max()
    momentum, previous = 1.0, alpha
    point = alpha
    for _ in range(steps):
        alpha = np.clip(point + rate * (1 - q @ point), 0, caps)
        after = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        point, previous, momentum = alpha + (momentum - 1) / after * (alpha - previous), alpha, after
    return alpha.sum() - alpha @ q @ alpha / 2, (alpha * y) @ z


@pytest.mark.parametrize("block", [20_000, 60])
def test_weights_reach_the_optimum(spark, monkeypatch, block):
    monkeypatch.setattr(kernel, "BLOCK_ROWS", block)
    made = [rings(150, 1), rings(110, 2)]
    data = trees.training([frame(spark, x, y, 1000 * i) for i, (x, y) in enumerate(made)])
    spec = kernel.KernelSpec(landmarks=60)
    found = kernel.spans(data, spec)
    _, weights = kernel._solve(data, spec, found)
    for part, (x, y) in enumerate(made):
        z, sign = found[part].lift(x), 2.0 * y - 1
        caps = spec.cost * data.weights(part, True)[y]
        best, _ = plain_dual(z, sign, caps)
        w = weights[part, 0]
        primal = w @ w / 2 + (caps * np.maximum(1 - sign * (z @ w), 0)).sum()
        assert best - 1e-6 <= primal <= best * (1.005 if block == 20_000 else 1.03)


def test_all_rows_as_landmarks_give_the_exact_kernel():
    x, _ = rings(40, 3)
    span = kernel.span_of(x, 0.7)
    z = span.lift(x)[:, :-1]
    np.testing.assert_allclose(z @ z.T, span.kernel(x), atol=1e-6)


def test_probabilities_equal_a_plain_platt_fit(spark):
    x, y = rings(160, 4)
    data = trees.training([frame(spark, x, y)])
    spec = kernel.KernelSpec(landmarks=50)
    found = kernel.spans(data, spec)
    packed, weights = kernel._solve(data, spec, found)
    model = kernel.support_vectors(data, spec)[0]
    (row,) = packed.collect()
    labels, split = np.frombuffer(row.y, np.int32), np.frombuffer(row.split, np.int32)
    z = found[0].lift(np.frombuffer(row.x).reshape(len(labels), -1))
    margin = np.array([z[i] @ weights[0, split[i] + 1] for i in range(len(labels))])
    n1, n0 = labels.sum(), (labels == 0).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 0.0, 0.0
    for _ in range(200_000):
        p = 1 / (1 + np.exp(a * margin + b))
        a, b = a + 0.02 * ((p - target) @ margin) * -1 * -1, b + 0.02 * (p - target).sum()
        if abs((p - target) @ margin) < 1e-9 and abs((p - target).sum()) < 1e-9:
            break
    np.testing.assert_allclose(model["curve"], [a, b], atol=1e-4)
    p = 1 / (1 + np.exp(model["curve"][0] * kernel.margins_of(model, x) + model["curve"][1]))
    assert ((p > 0.5) == (y == 1)).mean() > 0.85 and model["curve"][0] < 0


def objective(x, y, w, alpha):
    s = 2 * y - 1
    return np.logaddexp(0, -s * (x @ w[:-1] + w[-1])).mean() + alpha / 2 * (w[:-1] ** 2).sum()


@pytest.mark.parametrize("small", [20_000, 0])
def test_descent_comes_within_a_hundredth_of_the_optimum(spark, small):
    made = [overlapping(600, seed=7), overlapping(400, seed=8)]
    data = trees.training([frame(spark, x, y, 1000 * i) for i, (x, y) in enumerate(made)])
    steps = 400 if small else 60
    found = descent.sgd(data, alpha=1e-3, steps=steps, batch=256 if small else 600, small=small)
    for part, (x, y) in enumerate(made):
        w = np.zeros(6)
        one = np.hstack([x, np.ones((len(x), 1))])
        for _ in range(50):
            p = 1 / (1 + np.exp(-one @ w))
            ridge = 1e-3 * np.diag([1, 1, 1, 1, 1, 0])
            w -= np.linalg.solve((one * (p * (1 - p))[:, None]).T @ one / len(y) + ridge, one.T @ (p - y) / len(y) + ridge @ w)
        got = np.append(found[part]["weights"], found[part]["intercept"])
        assert objective(x, y, got, 1e-3) <= 1.01 * objective(x, y, w, 1e-3)


def test_steps_are_the_same_in_one_task_and_as_jobs(spark):
    x, y = overlapping(120, seed=5)
    data = trees.training([frame(spark, x, y).repartition(4)])
    near, far = (descent.sgd(data, steps=12, batch=40, small=n)[0] for n in (20_000, 0))
    np.testing.assert_allclose(near["weights"], far["weights"], rtol=1e-9)
