"""A support-vector machine with the RBF kernel and calibrated probabilities, for many training sets at once.

* **Landmarks.** A bounded sample of a part's rows (least hash of the key, ``landmarks`` of them) spans the kernel's space
  (Nystroem): row x becomes ``k(x, landmarks) @ inverse square root of k(landmarks, landmarks)``, and inner products of such
  rows are the kernel's, projected on that span.
* **Blocks.** The rows of a part are dealt into blocks. A round is one job: every block improves its own dual variables
  by coordinate ascent against the shared weights, and the sum of what the blocks found moves the weights (with the
  safe step of adding, each block counts all others as moving likewise). A part of one block makes more passes a round. Dual variables stay in a written table between
  rounds; the weights are one small vector a problem. Rounds end when the gap between primal and dual value is
  within ``tolerance`` of the primal; the primal value is that of the weights stretched by a thousandth at most, whichever
  is least, and so stretched they are kept. A pass visits the rows that one product says would move.
* **Calibration.** The same solver runs for ``inner`` splits of every part at once; each row gets its margin from the
  run that hasn't seen it. Platt's curve, with his smoothed targets, is fitted to these margins by Newton steps, each
  an aggregate of a few sums.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tussis.operators import trees as T
from tussis.session import durable

BLOCK_ROWS = 20_000


@dataclass(frozen=True)
class KernelSpec:
    cost: float = 2.0
    landmarks: int = 256
    inner: int = 3
    rounds: int = 60
    passes: int = 30
    alone: int = 300
    tolerance: float = 1e-3
    seed: int = 42


@dataclass(frozen=True)
class Span:
    """Landmarks of a part, what maps kernel values to coordinates, and the kernel's width."""

    points: np.ndarray
    whitening: np.ndarray
    gamma: float

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Coordinates of rows, with a constant 1 for the intercept."""
        return np.hstack([self.kernel(x) @ self.whitening, np.ones((len(x), 1))])

    def kernel(self, x: np.ndarray) -> np.ndarray:
        apart = (x * x).sum(axis=1)[:, None] + (self.points * self.points).sum(axis=1)[None, :] - 2.0 * (x @ self.points.T)
        return np.exp(-self.gamma * np.maximum(apart, 0.0))


def span_of(points: np.ndarray, gamma: float) -> Span:
    plain = Span(points, np.eye(len(points)), gamma)
    values, vectors = np.linalg.eigh(plain.kernel(points))
    keep = values > 1e-10 * values.max(initial=0.0)
    return Span(points, vectors[:, keep] / np.sqrt(values[keep]), gamma)


def gammas(data: T.Training) -> dict[int, float]:
    """1 / (features * variance of all cells) of each part, from sums of cells and squares."""

    def add_up(batches):
        for batch in batches:
            for part, own in T._by_part(batch):
                x = T.unpack(own.column("x"), np.float64)
                yield T._table([[part], [float(x.size)], [x.sum()], [(x * x).sum()]], "part int, n double, s double, q double")

    sums = data.rows.mapInArrow(add_up, "part int, n double, s double, q double").groupBy("part").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
    return {r.part: 1.0 / (data.width * (max(r.q / r.n - (r.s / r.n) ** 2, 0.0) or 1.0)) for r in sums.collect()}


def spans(data: T.Training, spec: KernelSpec) -> dict[int, Span]:
    """The landmarks of every part: distinct rows of least hash; at most ``landmarks`` rows a part come to the driver."""
    width = gammas(data)
    out = {}
    for part in sorted(width):
        order = F.xxhash64(F.lit(spec.seed), "key")
        rows = data.rows.filter(F.col("part") == part).orderBy(order, "x").select("x").limit(spec.landmarks).collect()
        out[part] = span_of(np.unique(np.stack([np.frombuffer(r.x) for r in rows]), axis=0), width[part])
    return out


# -- the solver --------------------------------------------------------------------


def ascend(z: np.ndarray, y: np.ndarray, caps: np.ndarray, alpha: np.ndarray, weights: np.ndarray, blocks: int, passes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """New dual variables of a block and its move of the weights. ``y`` is -1 or 1; rows with a cap of 0 take no part."""
    alpha, ahead = alpha.copy(), weights.copy()  # ``ahead``: the weights if all blocks moved like this one
    norms = (z * z).sum(axis=1) * blocks
    active = np.nonzero((caps > 0) & (norms > 0))[0]
    signed, lengths = y[active], np.sqrt(norms[active])
    own, least = z if len(active) == len(z) else z[active], 1e-3 if blocks == 1 else 1e-5
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        # One product tells which rows would move; most stay at a bound, and only the others are visited.
        wanted = np.clip(alpha[active] + (1.0 - signed * (own @ ahead)) / norms[active], 0.0, caps[active])
        moving = active[np.abs(wanted - alpha[active]) * lengths >= least]
        if not len(moving):
            break
        for i in rng.permutation(moving):
            step = min(max(alpha[i] + (1.0 - y[i] * (z[i] @ ahead)) / norms[i], 0.0), caps[i]) - alpha[i]
            if step:
                alpha[i] += step
                ahead += (blocks * step * y[i]) * z[i]
    return alpha, (ahead - weights) / blocks


STATE = "part int, block int, problem int, alpha binary, moved binary, hinge binary, dual double"
#: Stretched a little, the weights miss a row that lies on the margin by less: the primal value is that of the best of these.
STRETCHES = np.array([1.0, 1.00002, 1.00005, 1.0001, 1.0002, 1.0003, 1.0005, 1.001])


def _solve(data: T.Training, spec: KernelSpec, found: Mapping[int, Span]) -> tuple[DataFrame, dict[tuple[int, int], np.ndarray]]:
    """Rows in blocks, and the weights of each (part, problem): problem 0 has all rows, the others leave a split out."""
    context = data.rows.sparkSession.sparkContext
    sent = context.broadcast(dict(found))
    blocks = {part: max(1, -(-sum(n) // BLOCK_ROWS)) for part, n in data.sizes.items()}
    costs = {part: spec.cost * data.weights(part, True) for part in data.sizes}
    many = F.coalesce(*[F.when(F.col("part") == part, F.lit(n)) for part, n in blocks.items()])
    dealt = data.rows.withColumn("block", F.pmod(F.xxhash64(F.lit(spec.seed + 1), "key"), many).cast("int"))

    def pack(key, table):
        table = table.sort_by([("key", "ascending"), ("x", "ascending")])
        keys = table.column("key").to_numpy()
        split = (T.mixed(spec.seed, 7, keys) % np.uint64(spec.inner)).astype(np.int32)
        row = [key[0].as_py(), key[1].as_py(), b"".join(table.column("x").to_pylist()), table.column("y").to_numpy().astype(np.int32).tobytes(), split.tobytes()]
        return pa.Table.from_batches([T._table([[v] for v in row], "part int, block int, x binary, y binary, split binary")])

    packed = durable(dealt.select("part", "block", "key", "x", "y").groupBy("part", "block").applyInArrow(pack, "part int, block int, x binary, y binary, split binary"))
    weights = {(part, problem): np.zeros(found[part].whitening.shape[1] + 1) for part in found for problem in range(spec.inner + 1)}
    state, open_problems = None, set(weights)
    for turn in range(spec.rounds):
        shared = context.broadcast((weights, open_problems))
        rows = packed if state is None else packed.join(state.groupBy("part", "block").agg(F.map_from_entries(F.collect_list(F.struct("problem", "alpha"))).alias("alphas")), ["part", "block"])

        def improve(batches, turn=turn, shared=shared):
            weights, todo = shared.value
            for batch in batches:
                for row in batch.to_pylist():
                    part, block = row["part"], row["block"]
                    kept = dict(row.get("alphas") or [])
                    y01, split = np.frombuffer(row["y"], np.int32), np.frombuffer(row["split"], np.int32)
                    z = sent.value[part].lift(np.frombuffer(row["x"]).reshape(len(y01), -1))
                    for problem in range(spec.inner + 1):
                        alpha = np.frombuffer(kept[problem]) if kept else np.zeros(len(y01))
                        if (part, problem) not in todo:
                            yield T._table([[v] for v in (part, block, problem, alpha.tobytes(), b"", b"", 0.0)], STATE)
                            continue
                        caps = np.where(split + 1 == problem, 0.0, costs[part][y01])
                        y, w = 2.0 * y01 - 1.0, weights[part, problem]
                        margin = y * (z @ w)
                        hinge = np.array([(caps * np.maximum(1.0 - stretch * margin, 0.0)).sum() for stretch in STRETCHES])
                        new, moved = ascend(z, y, caps, alpha, w, blocks[part], spec.passes if blocks[part] > 1 else spec.alone, spec.seed + turn)
                        yield T._table([[v] for v in (part, block, problem, new.tobytes(), moved.tobytes(), hinge.tobytes(), float(alpha.sum()))], STATE)

        state = durable(rows.mapInArrow(improve, STATE))
        primal: dict[tuple[int, int], list] = {}
        moves: dict[tuple[int, int], np.ndarray] = {}
        sums = state.filter(F.length("moved") > 0).select("part", "problem", "moved", "hinge", "dual").mapInArrow(_added, SUMS)
        for r in sums.collect():  # a row per task and problem
            at = (r.part, r.problem)
            moves[at] = moves.get(at, 0.0) + np.frombuffer(r.moved)
            total = primal.setdefault(at, [0.0, 0.0])
            total[0], total[1] = total[0] + np.frombuffer(r.hinge), total[1] + r.dual
        for at, (hinge, dual) in primal.items():
            w = weights[at]
            values = hinge + float(w @ w) / 2 * STRETCHES**2
            best = int(values.argmin())
            gap, value = float(values[best]) + float(w @ w) / 2 - dual, float(values[best])
            if turn and gap <= spec.tolerance * max(value, 1e-12):
                open_problems = open_problems - {at}
                weights[at] = STRETCHES[best] * w
            else:
                weights[at] = w + moves[at]
        if not open_problems:
            break
    return packed, weights


SUMS = "part int, problem int, moved binary, hinge binary, dual double"


def _added(batches):
    """Sums per problem inside a task."""
    totals: dict[tuple[int, int], list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            total = totals.setdefault((row["part"], row["problem"]), [0.0, 0.0, 0.0])
            for i, value in enumerate((np.frombuffer(row["moved"]), np.frombuffer(row["hinge"]), row["dual"])):
                total[i] = total[i] + value
    for (part, problem), (moved, hinge, dual) in totals.items():
        yield T._table([[part], [problem], [moved.tobytes()], [hinge.tobytes()], [dual]], SUMS)


# -- calibration ---------------------------------------------------------------------


def platt(margins: DataFrame, steps: int = 30) -> dict[int, tuple[float, float]]:
    """(slope, offset) per part of 1 / (1 + exp(slope * margin + offset)), by Newton steps over ``part, y, margin``."""
    sizes = {r.part: (r.n0, r.n1) for r in margins.groupBy("part").agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1")).collect()}
    curve = {part: (0.0, math.log((n0 + 1) / (n1 + 1))) for part, (n0, n1) in sizes.items()}
    open_parts = set(curve)
    for _ in range(steps):
        if not open_parts:
            break

        def of(values, parts=frozenset(open_parts)):
            return F.coalesce(*[F.when(F.col("part") == part, F.lit(float(values(part)))) for part in sorted(parts)])

        rows = margins.filter(F.col("part").isin(sorted(open_parts)))
        target = F.when(F.col("y") == 1, of(lambda p: (sizes[p][1] + 1) / (sizes[p][1] + 2))).otherwise(of(lambda p: 1 / (sizes[p][0] + 2)))
        p = 1 / (1 + F.exp(of(lambda k: curve[k][0]) * F.col("margin") + of(lambda k: curve[k][1])))
        rows = rows.select("part", F.col("margin").alias("m"), (target - p).alias("d"), (p * (1 - p)).alias("h"))
        sums = rows.groupBy("part").agg(
            F.sum(F.col("m") * F.col("d")).alias("ga"), F.sum("d").alias("gb"), F.sum(F.col("m") * F.col("m") * F.col("h")).alias("aa"),
            F.sum(F.col("m") * F.col("h")).alias("ab"), F.sum("h").alias("bb")).collect()
        for r in sums:
            hessian = np.array([[r.aa + 1e-9, r.ab], [r.ab, r.bb + 1e-9]])
            step = np.linalg.solve(hessian, [r.ga, r.gb])
            step *= min(1.0, 10.0 / max(1e-12, float(np.abs(step).max())))
            curve[r.part] = (curve[r.part][0] - float(step[0]), curve[r.part][1] - float(step[1]))
            if np.abs(step).max() < 1e-7:
                open_parts = open_parts - {r.part}
    return curve


def support_vectors(data: T.Training, spec: KernelSpec = KernelSpec()) -> dict[int, dict]:
    """Per part: landmarks, weights on them, intercept, gamma and the calibrated curve."""
    found = spans(data, spec)
    packed, weights = _solve(data, spec, found)
    sent = data.rows.sparkSession.sparkContext.broadcast((found, weights))

    def unseen(batches):
        spans_, w = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                y, split = np.frombuffer(row["y"], np.int32), np.frombuffer(row["split"], np.int32)
                z = spans_[row["part"]].lift(np.frombuffer(row["x"]).reshape(len(y), -1))
                margin = np.zeros(len(y))
                for problem in range(1, spec.inner + 1):
                    mine = split + 1 == problem
                    margin[mine] = z[mine] @ w[row["part"], problem]
                yield T._table([[row["part"]] * len(y), y, margin], "part int, y int, margin double")

    curve = platt(durable(packed.mapInArrow(unseen, "part int, y int, margin double")))
    out = {}
    for part, span in found.items():
        w = weights[part, 0]
        out[part] = {"landmarks": span.points.tolist(), "weights": (span.whitening @ w[:-1]).tolist(), "intercept": float(w[-1]), "gamma": span.gamma, "curve": list(curve[part])}
    return out


def margins_of(model: Mapping, x: np.ndarray) -> np.ndarray:
    """Decision values of rows."""
    span = Span(np.array(model["landmarks"]), np.eye(len(model["landmarks"])), model["gamma"])
    return span.kernel(x) @ np.array(model["weights"]) + model["intercept"]
