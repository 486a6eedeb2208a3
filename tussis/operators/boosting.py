"""Boosting for many training sets at once: weighted stumps (AdaBoost) and gradient trees.

A round of stumps is one job: a scan works out every row's weight from the stumps so far, adds the weights up by
(part, feature, bin, class), and prefix sums give the best stump of each feature; one row per part and feature comes
back. A gradient tree takes one such job a level. No table of weights is ever written: the model says what they are.
Parts of at most ``small`` rows (by default what is a bounded number of bytes) are boosted to the end by one task each, with
the same functions. Gradients are summed as whole multiples of 2^-30, so that sums don't depend on how rows are spread.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tussis.operators import trees as T

UNIT = 2.0**30
BINS = T.BINS + 1
#: Fewer gradients than this (each within a unit) add up as floats without rounding.
EXACT_ROWS = 1 << 22


# -- stumps -----------------------------------------------------------------------


def stump_of(sums: np.ndarray, edges: Sequence[np.ndarray], features: Sequence[int]) -> dict | None:
    """Best stump of weight sums (features, bins, 2): lowest Gini impurity, then first feature and bin; None without weight."""
    whole = sums[0].sum()
    if whole <= 0:
        return None
    left = sums.cumsum(axis=1) / whole
    total = left[:, -1:, :]
    right = total - left
    wl, wr = left.sum(axis=2), right.sum(axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        pure = (left**2).sum(axis=2) / wl + (right**2).sum(axis=2) / wr
    fits = (wl > 1e-15) & (wr > 1e-15) & (np.arange(BINS) < np.array([len(edges[f]) for f in features])[:, None])
    pure = np.where(fits, np.round(pure, 9), -np.inf)
    f, b = divmod(int(np.argmax(pure)), BINS)
    if not np.isfinite(pure[f, b]):
        side = int(total[0, 0, 1] > total[0, 0, 0])
        return {"pure": -1.0, "feature": int(features[0]), "threshold": 0.0, "low": side, "high": side, "error": float(total[0, 0, 1 - side])}
    low, high = int(left[f, b, 1] > left[f, b, 0]), int(right[f, b, 1] > right[f, b, 0])
    error = left[f, b, 1 - low] + right[f, b, 1 - high]
    return {"pure": float(pure[f, b]), "feature": int(features[f]), "threshold": float(edges[features[f]][b]), "low": low, "high": high, "error": float(error)}


def _weights(stumps: Sequence[dict], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row weights after the stumps: every miss multiplies by exp(alpha). The largest exponent is taken off."""
    exponent = np.zeros(len(y))
    for s in stumps:
        says = np.where(x[:, s["feature"]] <= s["threshold"], s["low"], s["high"])
        exponent += s["alpha"] * (says != y)
    return np.exp(exponent - sum(s["alpha"] for s in stumps) / 2)


def _sums(b: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums of weights (features, bins, 2), feature by feature: a feature's cells stay in the processor's cache."""
    out = np.empty((b.shape[1], BINS, 2))
    for f in range(b.shape[1]):
        out[f] = np.bincount(b[:, f].astype(np.int64) * 2 + y, w, BINS * 2).reshape(BINS, 2)
    return out


def _judged(stump: dict, stumps: list[dict], rate: float) -> bool:
    """Add the stump with its weight; False when boosting ends."""
    error = stump["error"]
    if error <= 1e-12 or error >= 0.5:
        if error <= 1e-12 or not stumps:
            stumps.append(stump | {"alpha": 1.0})
        return False
    stumps.append(stump | {"alpha": rate * math.log((1 - error) / error)})
    return True


STUMPS = "part int, feature int, threshold double, low int, high int, error double, alpha double"


def adaboost(data: T.Training, rounds: int, rate: float, small: int | None = None) -> dict[int, list[dict]]:
    """Stumps (feature, threshold, low, high, error, alpha) of every part."""
    small = T.small_rows(data, values=True) if small is None else small
    out: dict[int, list[dict]] = {part: [] for part in data.sizes}
    near = {part for part, n in data.sizes.items() if sum(n) <= small}
    if near:
        for r in _boost_stumps(data, near, rounds, rate).collect():
            out[r.part].append(r.asDict())
    open_parts = {part for part, n in data.sizes.items() if part not in near and sum(n)}
    for _ in range(rounds):
        if not open_parts:
            break
        best: dict[int, dict] = {}
        for r in _stump_round(data, {part: out[part] for part in open_parts}).collect():  # a row per part and feature
            found = r.asDict()
            if r.part not in best or (-found["pure"], found["feature"]) < (-best[r.part]["pure"], best[r.part]["feature"]):
                best[r.part] = found
        open_parts = {part for part in open_parts if part in best and _judged(best[part], out[part], rate)}
    return out


def _stump_round(data: T.Training, so_far: dict[int, list[dict]]) -> DataFrame:
    """The best stump of each part and feature."""
    sent = data.rows.sparkSession.sparkContext.broadcast(so_far)
    edges, packed = data.edges, "part int, feature int, sums binary"

    def add_up(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, own in T._by_part(batch):
                if part in sent.value:
                    y = np.asarray(own.column("y")).astype(np.int64)
                    w = _weights(sent.value[part], T.unpack(own.column("x"), np.float64), y)
                    totals[part] = totals.get(part, 0.0) + _sums(T.unpack(own.column("b"), np.uint8).astype(np.int64), y, w)
        for part, sums in totals.items():
            yield T._table([[part] * len(sums), range(len(sums)), [s.tobytes() for s in sums]], packed)

    def choose(key, table):
        part, feature = (k.as_py() for k in key)
        sums = sum(np.frombuffer(s, dtype=np.float64) for s in sorted(table.column("sums").to_pylist())).reshape(1, BINS, 2)
        s = stump_of(sums, edges[part], [feature])
        cells = [[part], [feature], [s["threshold"]], [s["low"]], [s["high"]], [s["error"]], [s["pure"]]] if s else [[]] * 7
        return pa.Table.from_batches([T._table(cells, STUMPS.replace("alpha", "pure"))])

    return data.rows.mapInArrow(add_up, packed).groupBy("part", "feature").applyInArrow(choose, STUMPS.replace("alpha", "pure"))


def _boost_stumps(data: T.Training, parts: set[int], rounds: int, rate: float) -> DataFrame:
    edges = data.edges

    def build(key, table):
        part, stumps = key[0].as_py(), []
        x, b, y = _whole(table)
        for _ in range(rounds):
            s = stump_of(_sums(b, y, _weights(stumps, x, y)), edges[part], range(x.shape[1]))
            if s is None or not _judged(s, stumps, rate):
                break
        return pa.Table.from_batches([T._table([[part] * len(stumps), *([s[n] for s in stumps] for n in ("feature", "threshold", "low", "high", "error", "alpha"))], STUMPS)])

    return data.rows.filter(F.col("part").isin(sorted(parts))).groupBy("part").applyInArrow(build, STUMPS)


def _whole(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, bins and labels of a small part, in the order of the row keys; features lie one after the other."""
    table = table.sort_by([("key", "ascending"), ("x", "ascending")])
    x, b = T.unpack(table.column("x"), np.float64), T.unpack(table.column("b"), np.uint8)
    return np.asfortranarray(x), np.asfortranarray(b), table.column("y").to_numpy().astype(np.int64)


# -- gradient trees ----------------------------------------------------------------


def best_step(g: np.ndarray, n: np.ndarray) -> tuple[int, int, float] | None:
    """(feature position, bin, gain) of the largest decrease of squared error for gradient sums and counts (features, bins)."""
    gl, nl = g.cumsum(axis=1).astype(np.float64), n.cumsum(axis=1).astype(np.float64)
    gt, nt = gl[:, -1:], nl[:, -1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (gl**2 / nl + (gt - gl) ** 2 / (nt - nl) - gt**2 / nt) / UNIT**2
    gain = np.where((nl > 0) & (nl < nt), np.round(gain, 9), -np.inf)
    f, b = divmod(int(np.argmax(gain)), gain.shape[1])
    return (f, b, float(gain[f, b])) if gain[f, b] > 1e-9 else None


def _gradients(y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-margin))
    return np.rint((y - p) * UNIT).astype(np.int64), np.rint(p * (1 - p) * UNIT).astype(np.int64)


def _start(sizes: tuple[int, int]) -> float:
    return math.log(max(sizes[1], 1e-9) / max(sizes[0], 1e-9)) if sum(sizes) else 0.0


def _added(cells: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Exact sums of whole numbers: halves of 32 bits add up without rounding."""
    high, low = values >> 16, values & 0xFFFF
    return (np.bincount(cells, high, size).astype(np.int64) << 16) + np.bincount(cells, low, size).astype(np.int64)


def _level_sums(node: np.ndarray, b: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, gradient sums, counts) with sums as (nodes, features, bins)."""
    names, place = np.unique(node, return_inverse=True)
    width, size = b.shape[1], len(names) * BINS
    sums, counts = (np.empty((len(names), width, BINS), dtype=np.int64) for _ in range(2))
    first, exact = place * BINS, g.astype(np.float64) if len(g) < EXACT_ROWS else None
    for f in range(width):  # a feature's cells stay in the processor's cache
        cells = first + b[:, f]
        added = _added(cells, g, size) if exact is None else np.bincount(cells, exact, size).astype(np.int64)
        sums[:, f], counts[:, f] = added.reshape(-1, BINS), np.bincount(cells, minlength=size).reshape(-1, BINS)
    return names, sums, counts


def _leaf(g: int, h: int, rate: float) -> float:
    return rate * g / h if h else 0.0


def _flat_step(cuts: dict[int, tuple[int, float, float]], values: dict[int, float]) -> dict[str, list]:
    order = sorted({*cuts, *values})
    at = {node: i for i, node in enumerate(order)}
    return {
        "f": [cuts[n][0] if n in cuts else -1 for n in order], "t": [cuts[n][1] if n in cuts else 0.0 for n in order],
        "l": [at[2 * n] if n in cuts else at[n] for n in order], "r": [at[2 * n + 1] if n in cuts else at[n] for n in order],
        "v": [0.0 if n in cuts else values[n] for n in order],
    }


def _joined(steps: Sequence[dict[str, list]]) -> dict[str, list]:
    out: dict[str, list] = {"f": [], "t": [], "l": [], "r": [], "v": [], "roots": []}
    for step in steps:
        base = len(out["f"])
        out["roots"].append(base)
        for name in ("f", "t", "v"):
            out[name] += step[name]
        for name in ("l", "r"):
            out[name] += [base + i for i in step[name]]
    return out


def as_arrays(forest: dict[str, list]) -> dict[str, np.ndarray]:
    kinds = {"f": np.int64, "t": np.float64, "l": np.int64, "r": np.int64, "v": np.float64, "roots": np.int64}
    return {name: np.array(forest[name], dtype=kind) for name, kind in kinds.items()}


def _fit_step(b: np.ndarray, g: np.ndarray, h: np.ndarray, edges: Sequence[np.ndarray], depth: int, rate: float) -> tuple[dict, np.ndarray]:
    """One gradient tree in memory and what it adds to each row."""
    node = np.ones(len(g), dtype=np.int64)
    cuts: dict[int, tuple[int, float, float]] = {}
    open_rows = np.arange(len(g))
    for _ in range(depth):
        whole = len(open_rows) == len(g)
        names, gs, ns = _level_sums(*((node, b, g) if whole else (node[open_rows], b[open_rows], g[open_rows])))
        grown = np.zeros(len(g), dtype=bool)
        for name, g1, n1 in zip(names, gs, ns):
            found = best_step(g1, n1)
            if found:
                f, at, gain = found
                cuts[int(name)] = (f, float(edges[f][at]), gain)
                mine = open_rows[node[open_rows] == name]
                node[mine] = 2 * name + (b[mine, f] > at)
                grown[mine] = True
        open_rows = np.nonzero(grown)[0]
        if not len(open_rows):
            break
    names, place = np.unique(node, return_inverse=True)
    values = {int(n): _leaf(int(g[place == i].sum()), int(h[place == i].sum()), rate) for i, n in enumerate(names)}
    return _flat_step(cuts, values), np.array([values[int(n)] for n in names])[place]


STEPS = "part int, step int, f array<int>, t array<double>, l array<int>, r array<int>, v array<double>"


def gradient_trees(data: T.Training, rounds: int, depth: int, rate: float, small: int | None = None) -> dict[int, dict]:
    """{"base": log odds, "forest": arrays of all trees} of every part."""
    small = T.small_rows(data) if small is None else small
    out: dict[int, list[dict]] = {part: [] for part in data.sizes}
    near = {part for part, n in data.sizes.items() if 0 < sum(n) <= small}
    if near:
        for r in sorted(_boost_trees(data, near, rounds, depth, rate).collect(), key=lambda r: (r.part, r.step)):
            out[r.part].append({name: list(r[name]) for name in "ftlrv"})
    far = [part for part, n in data.sizes.items() if sum(n) > small]
    for _ in range(rounds if far else 0):
        for part, step in _distributed_step(data, {part: _joined(out[part]) for part in far}, depth, rate).items():
            out[part].append(step)
    return {part: {"base": _start(data.sizes[part]), "forest": _joined(steps)} for part, steps in out.items()}


def _boost_trees(data: T.Training, parts: set[int], rounds: int, depth: int, rate: float) -> DataFrame:
    edges, sizes = data.edges, data.sizes
    schema = pa.schema([("part", pa.int32()), ("step", pa.int32()), *((n, pa.list_(pa.float64() if n in "tv" else pa.int32())) for n in "ftlrv")])

    def build(key, table):
        part = key[0].as_py()
        b, y = np.asfortranarray(T.unpack(table.column("b"), np.uint8)), table.column("y").to_numpy().astype(np.int64)
        margin, steps = np.full(len(y), _start(sizes[part])), []
        for step in range(rounds):
            tree, gain = _fit_step(b, *_gradients(y, margin), edges[part], depth, rate)
            margin = margin + gain
            steps.append({"part": part, "step": step, **tree})
        return pa.Table.from_pylist(steps, schema=schema)

    return data.rows.filter(F.col("part").isin(sorted(parts))).select("part", "y", "b").groupBy("part").applyInArrow(build, STEPS)


SUMS = "part int, node long, feature int, bin int, g long, h long, n long"
STEP_CUTS = "part int, node long, feature int, cut double, gain double, g long, h long, gl long, hl long"


def _distributed_step(data: T.Training, forests: dict[int, dict], depth: int, rate: float) -> dict[int, dict]:
    """The next tree of each part, a job a level."""
    context = data.rows.sparkSession.sparkContext
    grown = {part: T.Grown() for part in forests}
    sums: dict[int, dict[int, tuple[int, int]]] = {part: {} for part in forests}
    open_nodes = {part: {1} for part in forests}
    for level in range(depth):
        state = context.broadcast(({p: as_arrays(f) for p, f in forests.items()}, grown, open_nodes))
        found = _gradient_level(data, state).collect()
        open_nodes = {part: set() for part in forests}
        for r in found:
            sums[r.part][r.node] = (r.g, r.h)
            if r.feature >= 0:
                grown[r.part].cuts[r.node] = (r.feature, r.cut, r.gain)
                sums[r.part] |= {2 * r.node: (r.gl, r.hl), 2 * r.node + 1: (r.g - r.gl, r.h - r.hl)}
                open_nodes[r.part] |= {2 * r.node, 2 * r.node + 1}
        open_nodes = {p: n for p, n in open_nodes.items() if n}
        if not open_nodes:
            break
    return {part: _flat_step(tree.cuts, {n: _leaf(*gh, rate) for n, gh in sums[part].items() if n not in tree.cuts}) for part, tree in grown.items()}


def _gradient_level(data: T.Training, state) -> DataFrame:
    edges, sizes = data.edges, data.sizes

    def add_up(batches):
        forests, grown, open_nodes = state.value
        for batch in batches:
            for part, own in T._by_part(batch):
                if part not in open_nodes:
                    continue
                x, y = T.unpack(own.column("x"), np.float64), np.asarray(own.column("y")).astype(np.int64)
                margin = np.full(len(y), _start(sizes[part]))
                if len(forests[part]["roots"]):
                    for column in T.leaves(forests[part], x).T:  # in the order of the trees, as in memory
                        margin = margin + column
                g, h = _gradients(y, margin)
                node = T.where_now(grown[part], x)
                rows = np.nonzero(np.isin(node, list(open_nodes[part])))[0]
                if not len(rows):
                    continue
                b = T.unpack(own.column("b").take(pa.array(rows)), np.uint8).astype(np.int64)
                names, gs, ns = _level_sums(node[rows], b, g[rows])
                hs = _level_sums(node[rows], b, h[rows])[1]
                i, f, at = np.nonzero(ns)
                yield T._table([[part] * len(i), names[i], f, at, gs[i, f, at], hs[i, f, at], ns[i, f, at]], SUMS)

    added = data.rows.mapInArrow(add_up, SUMS).groupBy("part", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])

    def choose(key, table):
        part, node = (k.as_py() for k in key)
        f, at = table.column("feature").to_numpy(), table.column("bin").to_numpy()
        width = len(edges[part])
        g, h, n = (np.zeros((width, BINS), dtype=np.int64) for _ in range(3))
        for array, name in ((g, "g"), (h, "h"), (n, "n")):
            array[f, at] = table.column(name).to_numpy()
        found = best_step(g, n)
        gt, ht = int(g[0].sum()), int(h[0].sum())
        if not found:
            return pa.Table.from_batches([T._table([[part], [node], [-1], [0.0], [0.0], [gt], [ht], [0], [0]], STEP_CUTS)])
        j, b, gain = found
        left = [int(g[j, : b + 1].sum()), int(h[j, : b + 1].sum())]
        return pa.Table.from_batches([T._table([[part], [node], [j], [float(edges[part][j][b])], [gain], [gt], [ht], [left[0]], [left[1]]], STEP_CUTS)])

    return added.groupBy("part", "node").applyInArrow(choose, STEP_CUTS)
