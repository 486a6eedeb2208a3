"""Logistic regression by averaged mini-batch stochastic gradient descent, for many training sets at once.

Step t takes the rows whose hash of (seed, t, key) falls below the batch share, so that a lost task draws the same batch.
Inside a task their gradients are added up, a group-by adds the tasks, and one vector a part moves: a job a step. The
step length follows the largest curvature (from one pass of second moments) and falls with the square root of the step;
the result is the mean of the later half of the path. Parts of at most ``small`` rows (by default what is a bounded number
of bytes) take the same steps in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tussis.operators import trees as T


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def batch_rows(seed: int, step: int, keys: np.ndarray, share: float) -> np.ndarray:
    """The rows of a step; all of them where the share is 1."""
    return np.nonzero(T.uniforms(seed, 11, step, keys) < share)[0]


def gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sum of the log-loss gradients of rows that end in a constant 1."""
    return x.T @ (1 / (1 + np.exp(-(x @ w))) - y)


def stepped(w: np.ndarray, total: np.ndarray, rows: int, step: int, length: float, alpha: float) -> np.ndarray:
    """The next point; the intercept isn't penalised."""
    penalty = alpha * np.append(w[:-1], 0.0)
    return w - length / np.sqrt(1 + step / 20) * (total / max(rows, 1) + penalty)


def _share(n: int, batch: int) -> float:
    return min(1.0, batch / max(n, 1))


def _length(moments: np.ndarray, alpha: float) -> float:
    return 1.0 / (0.25 * float(np.linalg.eigvalsh(moments).max()) + alpha)


MOMENTS = "part int, row int, sums binary"


def curvature(data: T.Training) -> dict[int, np.ndarray]:
    """Second moments of every part, rows of the matrix added up apart."""

    def add_up(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, own in T._by_part(batch):
                x = _with_one(T.unpack(own.column("x"), np.float64))
                totals[part] = totals.get(part, 0.0) + x.T @ x
        for part, sums in totals.items():
            yield T._table([[part] * len(sums), range(len(sums)), [s.tobytes() for s in sums]], MOMENTS)

    sums = data.rows.mapInArrow(add_up, MOMENTS).groupBy("part", "row").applyInArrow(_add_tables(MOMENTS), MOMENTS)
    found: dict[int, dict[int, np.ndarray]] = {}
    for r in sums.collect():  # a row per part and feature
        found.setdefault(r.part, {})[r.row] = np.frombuffer(r.sums)
    return {part: np.stack([rows[i] for i in sorted(rows)]) / sum(data.sizes[part]) for part, rows in found.items()}


def _add_tables(schema: str):
    """Adds the packed sums of a group's partial rows."""

    def add(key, table):
        total = sum(np.frombuffer(s) for s in sorted(table.column("sums").to_pylist()))
        return pa.Table.from_batches([T._table([*([k.as_py()] for k in key), [total.tobytes()]], schema)])

    return add


PATH = "part int, sums binary"


def sgd(data: T.Training, alpha: float = 1e-4, steps: int = 1500, batch: int = 256, seed: int = 42, small: int | None = None) -> dict[int, dict]:
    """{"weights": ..., "intercept": ...} of every part."""
    small = T.small_rows(data, values=True) if small is None else small
    lengths = {part: _length(m, alpha) for part, m in curvature(data).items()}
    mean: dict[int, np.ndarray] = {}
    near = sorted(part for part in lengths if sum(data.sizes[part]) <= small)
    if near:
        for r in _walk(data, near, lengths, alpha, steps, batch, seed).collect():
            mean[r.part] = np.frombuffer(r.sums)
    far = {part: np.zeros(data.width + 1) for part in lengths if part not in near}
    tail = {part: np.zeros(data.width + 1) for part in far}
    for step in range(steps if far else 0):
        moved = set()
        for r in _gradients(data, far, batch, seed, step).collect():  # a row per part
            sums = np.frombuffer(r.sums)
            far[r.part] = stepped(far[r.part], sums[:-1], int(sums[-1]), step, lengths[r.part], alpha)
            moved.add(r.part)
        for part in far:
            if step >= steps // 2:
                tail[part] = tail[part] + far[part]
    mean |= {part: total / (steps - steps // 2) for part, total in tail.items()}
    return {part: {"weights": w[:-1].tolist(), "intercept": float(w[-1])} for part, w in mean.items()}


def _gradients(data: T.Training, points: dict[int, np.ndarray], batch: int, seed: int, step: int) -> DataFrame:
    shares = {part: _share(sum(data.sizes[part]), batch) for part in points}
    sent = data.rows.sparkSession.sparkContext.broadcast(points)

    def add_up(batches):
        totals: dict[int, np.ndarray] = {}
        for rows in batches:
            for part, own in T._by_part(rows):
                if part not in shares:
                    continue
                chosen = batch_rows(seed, step, np.asarray(own.column("key")), shares[part])
                if len(chosen):
                    x = _with_one(T.unpack(own.column("x").take(pa.array(chosen)), np.float64))
                    totals[part] = totals.get(part, 0.0) + np.append(gradient(x, np.asarray(own.column("y"))[chosen], sent.value[part]), len(chosen))
        for part, sums in totals.items():
            yield T._table([[part], [sums.tobytes()]], PATH)

    return data.rows.mapInArrow(add_up, PATH).groupBy("part").applyInArrow(_add_tables(PATH), PATH)


def _walk(data: T.Training, parts: list[int], lengths: dict[int, float], alpha: float, steps: int, batch: int, seed: int) -> DataFrame:
    sizes = data.sizes

    def build(key, table):
        part = key[0].as_py()
        table = table.sort_by([("key", "ascending"), ("x", "ascending")])
        keys, y = table.column("key").to_numpy(), table.column("y").to_numpy()
        x = _with_one(T.unpack(table.column("x"), np.float64))
        w, tail, share = np.zeros(x.shape[1]), np.zeros(x.shape[1]), _share(sum(sizes[part]), batch)
        for step in range(steps):
            rows = batch_rows(seed, step, keys, share)
            if len(rows):
                w = stepped(w, gradient(x[rows], y[rows], w), len(rows), step, lengths[part], alpha)
            if step >= steps // 2:
                tail += w
        return pa.Table.from_batches([T._table([[part], [(tail / (steps - steps // 2)).tobytes()]], PATH)])

    return data.rows.filter(F.col("part").isin(parts)).groupBy("part").applyInArrow(build, PATH)
