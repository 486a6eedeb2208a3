"""Trees grown level by level for many training sets at once.

A **part** is one training set (the hold-out's, one per fold). All trees of all parts grow together: one scan a level
counts labels by (part, tree, node, feature, bin) for every node that is still large, partial counts are summed by a
group-by, and the best cut of each node comes from prefix sums over its bins. A node of at most ``small`` rows is
finished by one task, which gets that node's rows and grows everything below it. Both ways use the same functions on
the same whole numbers, so the result doesn't depend on where a node is finished or how rows are spread.

Two kinds of cuts:

* **bins**: up to 255 quantile bins a part and feature, with midpoints between neighbouring quantiles as cut points;
* **random** (extremely randomised trees): one uniform cut point per (tree, node, feature) between the node's smallest
  and largest value, no bins; a level takes two scans, extremes and then counts.

Chance (drawn rows, drawn features, cut points) comes from hashes of the seed, the tree, the node and the row's key:
a part has the same trees whether it is fitted alone or with others. What goes to the driver and back is the model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tussis.session import durable

BINS = 255
SMALL_ROWS = 20_000
#: Bytes of bins, and of values, with which one task takes all rounds of a method that can't do without the round before.
SMALL_BYTES, SMALL_VALUES = 32 << 20, 64 << 20
#: Cells of partial counts that a task gathers before it hands them on.
CELLS = 1 << 20


@dataclass(frozen=True)
class TreeSpec:
    """How a group of trees is grown; ``features`` is the number drawn per node, 0 for all, -1 for the square root."""

    trees: int = 1
    depth: int = 8
    features: int = 0
    bootstrap: bool = False
    weighted: bool = True
    random_cuts: bool = False
    min_split: int = 2
    seed: int = 42

    def drawn(self, width: int) -> int:
        return width if self.features == 0 else max(1, int(math.sqrt(width))) if self.features < 0 else min(width, self.features)


# -- chance -------------------------------------------------------------------

_STEP, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(*parts) -> np.ndarray:
    """64 mixed bits of whole numbers (the finaliser of SplitMix64, once per part)."""
    with np.errstate(over="ignore"):
        state = np.uint64(0)
        for part in parts:
            state = (state ^ np.asarray(part).astype(np.int64).view(np.uint64)) + _STEP
            state = (state ^ (state >> np.uint64(30))) * _MIX1
            state = (state ^ (state >> np.uint64(27))) * _MIX2
            state = state ^ (state >> np.uint64(31))
    return state


def uniforms(*parts) -> np.ndarray:
    """[0, 1) by hash."""
    return (mixed(*parts) >> np.uint64(11)).astype(np.float64) / 2.0**53


_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])


def multiplicity(spec: TreeSpec, tree: int, keys: np.ndarray) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson with mean 1, or once."""
    if not spec.bootstrap:
        return np.ones(len(keys), dtype=np.int64)
    return np.searchsorted(_POISSON, uniforms(spec.seed, 1, tree, keys), side="right").astype(np.int64)


def drawn_features(spec: TreeSpec, tree: int, node: int, width: int) -> np.ndarray:
    """The features a node may cut, ascending."""
    k = spec.drawn(width)
    if k == width:
        return np.arange(width)
    return np.sort(np.argsort(mixed(spec.seed, 2, tree, node, np.arange(width)), kind="stable")[:k])


def cut_points(spec: TreeSpec, tree: int, node: int, features: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A uniform point between the extremes of each feature; rows up to it go left."""
    return low + uniforms(spec.seed, 3, tree, node, features) * (high - low)


# -- the best cut of a node ----------------------------------------------------


def gini_gain(left: np.ndarray, total: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted decrease of the Gini impurity for class counts left of a cut (..., 2); -inf where a side is empty."""
    a, t = left * weights, total * weights
    b = t - a
    wa, wb, wt = a.sum(axis=-1), b.sum(axis=-1), t.sum(axis=-1)
    fits = (left.sum(axis=-1) > 0) & (left.sum(axis=-1) < total.sum(axis=-1))
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (a * a).sum(axis=-1) / wa + (b * b).sum(axis=-1) / wb - (t * t).sum(axis=-1) / wt
    return np.where(fits, gain, -np.inf)


def best_bin(counts: np.ndarray, weights: np.ndarray) -> tuple[int, int, float] | None:
    """(feature position, bin, gain) of class counts (features, bins, 2); the first of equal gains."""
    left = counts.cumsum(axis=1)
    gain = gini_gain(left, left[:, -1:, :], weights)
    at = int(np.argmax(np.round(gain, 9)))
    f, b = divmod(at, gain.shape[1])
    return (f, b, float(gain[f, b])) if gain[f, b] > 1e-9 else None


def middle(edges: np.ndarray, counts: np.ndarray, at: int) -> float:
    """The cut point behind bin ``at``: in the middle of the empty bins that follow it in the node (counts of bins and classes)."""
    later = np.nonzero(counts[at + 1 :].any(axis=1))[0]
    last = at + (int(later[0]) if len(later) else 0)
    return float((edges[at] + edges[min(last, len(edges) - 1)]) / 2)


def best_cut(left: np.ndarray, total: np.ndarray, weights: np.ndarray) -> tuple[int, float] | None:
    """(feature position, gain) of one cut per feature; the first of equal gains."""
    gain = gini_gain(left, total, weights)
    at = int(np.argmax(np.round(gain, 9)))
    return (at, float(gain[at])) if gain[at] > 1e-9 else None


# -- a grown tree ----------------------------------------------------------------


@dataclass
class Grown:
    """Nodes of one tree by their number (root 1, children 2i and 2i + 1): (feature, cut, gain) or a leaf, and class counts."""

    cuts: dict[int, tuple[int, float, float]] = field(default_factory=dict)
    counts: dict[int, tuple[int, int]] = field(default_factory=dict)

    def flat(self, weights: np.ndarray) -> dict[str, list]:
        """Arrays for scoring: feature (-1 for a leaf), cut, left, right, share of class 1."""
        order = sorted(self.counts)
        at = {node: i for i, node in enumerate(order)}
        out: dict[str, list] = {"f": [], "t": [], "l": [], "r": [], "v": []}
        for node in order:
            feature, cut, _ = self.cuts.get(node, (-1, 0.0, 0.0))
            w0, w1 = np.asarray(self.counts[node]) * weights
            out["f"].append(int(feature))
            out["t"].append(float(cut))
            out["l"].append(at.get(2 * node, at[node]) if feature >= 0 else at[node])
            out["r"].append(at.get(2 * node + 1, at[node]) if feature >= 0 else at[node])
            out["v"].append(float(w1 / (w0 + w1)) if w0 + w1 else 0.5)
        return out


def grow_below(spec: TreeSpec, tree: int, node: int, x: np.ndarray, y: np.ndarray, times: np.ndarray, weights: np.ndarray, edges=None) -> list[tuple]:
    """Everything from ``node`` down, in memory: (node, feature or -1, cut, gain, n0, n1). ``x`` holds bins, or values for random cuts."""
    out, waiting, width = [], [(node, np.arange(len(y)))], x.shape[1]
    while waiting:
        at, rows = waiting.pop()
        n1 = int(times[rows] @ y[rows])
        n0 = int(times[rows].sum()) - n1
        split = None
        if at.bit_length() <= spec.depth and len(rows) >= spec.min_split and n0 and n1:
            features = drawn_features(spec, tree, at, width)
            own = x[np.ix_(rows, features)]
            if spec.random_cuts:
                points = cut_points(spec, tree, at, features, own.min(axis=0), own.max(axis=0))
                goes = own <= points
                ones = (times[rows] * y[rows]) @ goes
                left = np.stack([times[rows] @ goes - ones, ones], axis=1)
                found = best_cut(left, np.array([n0, n1]), weights)
                split = found and (int(features[found[0]]), float(points[found[0]]), found[1], goes[:, found[0]])
            else:
                cells = (np.arange(len(features)) * (BINS + 1) + own) * 2 + y[rows][:, None]
                counts = np.bincount(cells.ravel(), np.repeat(times[rows], len(features)), len(features) * (BINS + 1) * 2)
                counts = counts.reshape(len(features), BINS + 1, 2)
                found = best_bin(counts, weights)
                if found:
                    feature = int(features[found[0]])
                    split = (feature, middle(edges[feature], counts[found[0]], found[1]), found[2], own[:, found[0]] <= found[1])
        if split:
            feature, cut, gain, goes = split
            out.append((at, feature, float(cut), gain, n0, n1))
            waiting += [(2 * at, rows[goes]), (2 * at + 1, rows[~goes])]
        else:
            out.append((at, -1, 0.0, 0.0, n0, n1))
    return out


# -- training tables -------------------------------------------------------------


@dataclass(frozen=True)
class Training:
    """Rows of all parts (part, key, y, x: packed values, b: packed bins), class counts and cut points of each part."""

    rows: DataFrame
    width: int
    sizes: dict[int, tuple[int, int]]
    edges: dict[int, list[np.ndarray]]

    def weights(self, part: int, weighted: bool) -> np.ndarray:
        """n / (classes * class size), or ones."""
        n = np.array(self.sizes[part], dtype=np.float64)
        return n.sum() / (2 * np.maximum(n, 1)) if weighted else np.ones(2)


def training(parts: Sequence[DataFrame], features: str = "features", target: str = "target", key: str = "row_key") -> Training:
    """The training rows of all parts in one written table, with the bins of every part."""
    rows = None
    for at, part in enumerate(parts):
        one = part.select(F.lit(at).alias("part"), F.xxhash64(F.col(key)).alias("key"), F.col(target).cast("int").alias("y"), vector_to_array(features).alias("v"))
        rows = one if rows is None else rows.unionAll(one)
    rows = durable(rows)
    sizes = {at: [0, 0] for at in range(len(parts))}
    for r in rows.groupBy("part", "y").count().collect():
        sizes[r.part][r.y] = r["count"]
    points = F.array(*[F.lit(i / BINS) for i in range(BINS + 1)])
    cells = rows.select("part", F.posexplode("v").alias("feature", "value"))
    found = cells.groupBy("part", "feature").agg(F.percentile_approx("value", points, F.lit(10_000)).alias("q")).collect()
    width = max((r.feature for r in found), default=-1) + 1
    edges = {at: [np.zeros(0)] * width for at in range(len(parts))}
    for r in found:
        q = np.unique(np.array(r.q))
        edges[r.part][r.feature] = (q[:-1] + q[1:]) / 2
    sent = rows.sparkSession.sparkContext.broadcast(edges)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.asarray(batch.column("part"))
            v = np.asarray(batch.column("v").flatten()).reshape(len(part), -1)
            b = np.zeros(v.shape, dtype=np.uint8)
            for at in np.unique(part):
                mine = part == at
                for j in range(v.shape[1]):
                    b[mine, j] = np.searchsorted(sent.value[at][j], v[mine, j], side="left")
            packed = [pa.array([row.tobytes() for row in m], pa.binary()) for m in (v, b)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "key", "y")), *packed], names=["part", "key", "y", "x", "b"])

    packed = durable(rows.mapInArrow(pack, "part int, key long, y int, x binary, b binary"))
    return Training(packed, width, {k: tuple(v) for k, v in sizes.items()}, edges)


def small_rows(data: Training, values: bool = False) -> int:
    """Rows of a part that one task holds through many rounds: as bins, or as values too."""
    return max(SMALL_ROWS, SMALL_VALUES // (8 * max(1, data.width)) if values else SMALL_BYTES // max(1, data.width))


def unpack(column, dtype) -> np.ndarray:
    data = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(data.to_pylist()), dtype=dtype).reshape(len(data), -1)


def where_now(grown: Grown, x: np.ndarray) -> np.ndarray:
    """The node each row has reached in a tree that is still growing (cuts on values)."""
    node = np.ones(len(x), dtype=np.int64)
    waiting = [(1, np.arange(len(x)))] if 1 in grown.cuts else []
    while waiting:
        at, rows = waiting.pop()
        feature, cut, _ = grown.cuts[at]
        goes = x[rows, feature] <= cut
        for child, mine in ((2 * at, rows[goes]), (2 * at + 1, rows[~goes])):
            node[mine] = child
            if child in grown.cuts and len(mine):
                waiting.append((child, mine))
    return node


# -- growing -----------------------------------------------------------------------

NODES = "part int, tree int, node long, feature int, cut double, gain double, n0 long, n1 long"
COUNTS = "part int, tree int, node long, feature int, bin int, n0 long, n1 long, rows long"


def _table(columns: Sequence, schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _by_part(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    parts = np.asarray(batch.column("part"))
    for at in np.unique(parts):
        yield int(at), batch.filter(pa.array(parts == at))


def grow(data: Training, spec: TreeSpec, small: int = SMALL_ROWS) -> dict[int, list[Grown]]:
    """All trees of all parts."""
    context = data.rows.sparkSession.sparkContext
    forest = {part: [Grown() for _ in range(spec.trees)] for part, n in data.sizes.items()}
    large = {(part, tree): {1: sum(n)} for part, n in data.sizes.items() for tree in range(spec.trees) if sum(n) > small}
    finish = {(part, tree): {1} for part, n in data.sizes.items() for tree in range(spec.trees) if 0 < sum(n) <= small}
    for _ in range(spec.depth + 1):
        if not large:
            break
        state = context.broadcast((forest, large))
        found = _level(data, spec, state).collect()
        large = {}
        for r in found:
            tree = forest[r.part][r.tree]
            tree.counts[r.node] = (r.n0, r.n1)
            if r.feature < 0:
                continue
            tree.cuts[r.node] = (r.feature, r.cut, r.gain)
            for child, rows in ((2 * r.node, r.left_rows), (2 * r.node + 1, r.rows - r.left_rows)):
                if rows > small:
                    large.setdefault((r.part, r.tree), {})[child] = rows
                else:
                    finish.setdefault((r.part, r.tree), set()).add(child)
    if finish:
        state = context.broadcast((forest, finish))
        for r in _finish(data, spec, state).collect():
            tree = forest[r.part][r.tree]
            tree.counts[r.node] = (r.n0, r.n1)
            if r.feature >= 0:
                tree.cuts[r.node] = (r.feature, r.cut, r.gain)
    return forest


def _finish(data: Training, spec: TreeSpec, state) -> DataFrame:
    """The subtrees of all small nodes: their rows meet in one group a node."""
    column, edges = ("x" if spec.random_cuts else "b"), data.edges
    weights = {part: data.weights(part, spec.weighted) for part in data.sizes}
    values = np.float64 if spec.random_cuts else np.uint8

    def send(batches):
        forest, finish = state.value
        for batch in batches:
            for part, own in _by_part(batch):
                keys, y, packed = np.asarray(own.column("key")), np.asarray(own.column("y")), own.column(column)
                x = unpack(own.column("x"), np.float64) if any(forest[part][t].cuts for t in range(spec.trees)) else None
                for tree in range(spec.trees):
                    nodes = finish.get((part, tree))
                    if not nodes:
                        continue
                    times = multiplicity(spec, tree, keys)
                    at = where_now(forest[part][tree], x) if x is not None else np.ones(len(keys), dtype=np.int64)
                    mine = np.nonzero((times > 0) & np.isin(at, list(nodes)))[0]
                    yield _table([[part] * len(mine), [tree] * len(mine), at[mine], y[mine], times[mine], packed.take(pa.array(mine)).to_pylist()],
                                 "part int, tree int, node long, y int, times long, x binary")

    sent = data.rows.mapInArrow(send, "part int, tree int, node long, y int, times long, x binary")

    def build(key, table):
        part, tree, node = (k.as_py() for k in key)
        x = unpack(table.column("x"), values)
        y, times = table.column("y").to_numpy().astype(np.int64), table.column("times").to_numpy()
        found = grow_below(spec, tree, node, x.astype(np.int64) if values is np.uint8 else x, y, times, weights[part], None if spec.random_cuts else edges[part])
        columns = list(zip(*found))
        return pa.Table.from_batches([_table([[part] * len(found), [tree] * len(found), *columns], NODES)])

    return sent.groupBy("part", "tree", "node").applyInArrow(build, NODES)


SPLITS = NODES + ", rows long, left_rows long"


def _level(data: Training, spec: TreeSpec, state) -> DataFrame:
    """The best cut of every large node, and the class counts of those that aren't cut."""
    weights = {part: data.weights(part, spec.weighted) for part in data.sizes}
    if spec.random_cuts:
        return _random_level(data, spec, state, weights)
    edges, width = data.edges, data.width

    def count(batches):
        forest, large = state.value
        for part, tree, node, rows, times, y, cells in _placed(batches, spec, forest, large, "b"):
            features = drawn_features(spec, tree, node, width)
            sub = cells[np.ix_(rows, features)].astype(np.int64)
            cells = (np.arange(len(features)) * (BINS + 1) + sub) * 2 + y[rows][:, None]
            counts = np.bincount(cells.ravel(), np.repeat(times[rows], len(features)), len(features) * (BINS + 1) * 2).reshape(-1, 2).astype(np.int64)
            seen = np.bincount((cells // 2).ravel(), minlength=len(counts))
            hit = np.nonzero(counts.any(axis=1))[0]
            yield _table([[part] * len(hit), [tree] * len(hit), [node] * len(hit), features[hit // (BINS + 1)], hit % (BINS + 1), counts[hit, 0], counts[hit, 1], seen[hit]], COUNTS)

    sums = data.rows.mapInArrow(count, COUNTS).groupBy("part", "tree", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "rows")])

    def choose(key, table):
        part, tree, node = (k.as_py() for k in key)
        feature, at = table.column("feature").to_numpy(), table.column("bin").to_numpy()
        n = np.stack([table.column("n0").to_numpy(), table.column("n1").to_numpy()], axis=1)
        names, place = np.unique(feature, return_inverse=True)
        counts, seen = np.zeros((len(names), BINS + 1, 2)), np.zeros((len(names), BINS + 1), dtype=np.int64)
        counts[place, at], seen[place, at] = n, table.column("rows").to_numpy()
        total, rows = counts[0].sum(axis=0), int(seen[0].sum())
        found = best_bin(counts, weights[part]) if total.all() and rows >= spec.min_split and node.bit_length() <= spec.depth else None
        f, b, gain = found or (0, 0, 0.0)
        row = [part, tree, node, int(names[f]) if found else -1, middle(edges[part][names[f]], counts[f], b) if found else 0.0, gain, int(total[0]), int(total[1]), rows, int(seen[f, : b + 1].sum())]
        return pa.Table.from_batches([_table([[v] for v in row], SPLITS)])

    return sums.groupBy("part", "tree", "node").applyInArrow(choose, SPLITS)


def _placed(batches, spec: TreeSpec, forest, large, column: str):
    """For each large node the rows of a batch that have reached it, and the batch's bins or values."""
    for batch in batches:
        for part, own in _by_part(batch):
            keys, y, x = np.asarray(own.column("key")), np.asarray(own.column("y")).astype(np.int64), None
            for tree in range(spec.trees):
                nodes = large.get((part, tree))
                if not nodes:
                    continue
                if x is None:  # once for all trees
                    x = unpack(own.column("x"), np.float64)
                    cells = x if column == "x" else unpack(own.column(column), np.uint8)
                times = multiplicity(spec, tree, keys)
                at = where_now(forest[part][tree], x)
                for node in nodes:
                    rows = np.nonzero((at == node) & (times > 0))[0]
                    if len(rows):
                        yield part, tree, node, rows, times, y, cells


EXTREMES = "part int, tree int, node long, feature int, low double, high double"
SIDES = "part int, tree int, node long, feature int, cut double, l0 long, l1 long, n0 long, n1 long, rows long, left_rows long"


def _random_level(data: Training, spec: TreeSpec, state, weights) -> DataFrame:
    """Extremes of the drawn features of each large node, then the counts left of their random points."""
    width = data.width

    def extremes(batches):
        forest, large = state.value
        for part, tree, node, rows, _, _, x in _placed(batches, spec, forest, large, "x"):
            features = drawn_features(spec, tree, node, width)
            sub = x[np.ix_(rows, features)]
            n = len(features)
            yield _table([[part] * n, [tree] * n, [node] * n, features, sub.min(axis=0), sub.max(axis=0)], EXTREMES)

    spans: dict = {}
    found = data.rows.mapInArrow(extremes, EXTREMES).groupBy("part", "tree", "node", "feature").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    for r in found.orderBy("part", "tree", "node", "feature").collect():  # a row per node and drawn feature
        spans.setdefault((r.part, r.tree, r.node), []).append((r.feature, r.low, r.high))
    points = {}
    for (part, tree, node), rows in spans.items():
        features, low, high = (np.array(c) for c in zip(*rows))
        points[part, tree, node] = (features.astype(np.int64), cut_points(spec, tree, node, features, low, high))
    sent = data.rows.sparkSession.sparkContext.broadcast(points)

    def sides(batches):
        forest, large = state.value
        for part, tree, node, rows, times, y, x in _placed(batches, spec, forest, large, "x"):
            features, cuts = sent.value[part, tree, node]
            goes = x[np.ix_(rows, features)] <= cuts
            t, ones, n = times[rows], times[rows] * y[rows], len(features)
            l1, n1 = ones @ goes, int(ones.sum())
            yield _table([[part] * n, [tree] * n, [node] * n, features, cuts, t @ goes - l1, l1, [int(t.sum()) - n1] * n, [n1] * n, [len(rows)] * n, goes.sum(axis=0)], SIDES)

    sums = data.rows.mapInArrow(sides, SIDES).groupBy("part", "tree", "node", "feature", "cut").agg(*[F.sum(c).alias(c) for c in ("l0", "l1", "n0", "n1", "rows", "left_rows")])

    def choose(key, table):
        part, tree, node = (k.as_py() for k in key)
        rows = sorted(table.to_pylist(), key=lambda r: r["feature"])
        total, seen = np.array([rows[0]["n0"], rows[0]["n1"]]), rows[0]["rows"]
        found = None
        if total.all() and seen >= spec.min_split and node.bit_length() <= spec.depth:
            found = best_cut(np.array([[r["l0"], r["l1"]] for r in rows]), total, weights[part])
        best = rows[found[0]] if found else None
        row = [part, tree, node, best["feature"] if best else -1, best["cut"] if best else 0.0, found[1] if found else 0.0, int(total[0]), int(total[1]), seen, best["left_rows"] if best else 0]
        return pa.Table.from_batches([_table([[v] for v in row], SPLITS)])

    return sums.groupBy("part", "tree", "node").applyInArrow(choose, SPLITS)


# -- what is made of grown trees ----------------------------------------------------


def flat_forest(trees: Sequence[Grown], weights: np.ndarray) -> dict[str, list]:
    """One set of arrays for all trees, with the roots."""
    out: dict[str, list] = {"f": [], "t": [], "l": [], "r": [], "v": [], "roots": []}
    for tree in trees:
        base, flat = len(out["f"]), tree.flat(weights)
        out["roots"].append(base)
        for name in ("f", "t", "v"):
            out[name] += flat[name]
        for name in ("l", "r"):
            out[name] += [base + i for i in flat[name]]
    return out


def leaves(forest: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Value of the leaf that each row reaches in each tree (rows, trees)."""
    at = np.repeat(forest["roots"][None, :], len(x), axis=0)
    rows = np.arange(len(x))[:, None]
    while True:
        feature = forest["f"][at]
        inner = feature >= 0
        if not inner.any():
            return forest["v"][at]
        goes = x[rows, np.maximum(feature, 0)] <= forest["t"][at]
        at = np.where(inner, np.where(goes, forest["l"][at], forest["r"][at]), at)


def importance(trees: Sequence[Grown], width: int) -> np.ndarray:
    """Mean over trees of each feature's share in the decrease of impurity."""
    shares = np.zeros((len(trees), width))
    for i, tree in enumerate(trees):
        for feature, _, gain in tree.cuts.values():
            shares[i, feature] += gain
    sums = shares.sum(axis=1, keepdims=True)
    mean = np.divide(shares, sums, out=np.zeros_like(shares), where=sums > 0).mean(axis=0)
    return mean / mean.sum() if mean.sum() else mean
