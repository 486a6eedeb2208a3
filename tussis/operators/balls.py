"""Exact nearest neighbours where most block pairs are ruled out before they are joined.

Pivots are rows far apart (farthest-point traversal over a bounded sample). Every row belongs to its nearest pivot's ball;
a ball keeps the interval of its members' distances to the pivot. From pivot distances and intervals follow a least and
a largest distance between any two members of two balls. For a ball of queries, the largest distances of its nearest
corpus balls bound the k-th neighbour, and every corpus ball whose least distance lies beyond that bound is left out.
Only pairs of balls that remain are compared, as in ``neighbors``. Blocks of balls travel in bundles as large as the blocks
there: a bundle of queries meets a bundle of corpus rows once, with the list of their pairs of balls that remain, so that
copies of the queries don't grow with the number of balls. The answer is the same as without pruning; how much is left of the work depends on how clustered the rows are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tussis.operators import neighbors as N
from tussis.session import durable

#: Most pivots, and the rows they are chosen from. Pairs of pivots, not of rows, are what one task decides on.
PIVOTS = 512
SAMPLE_ROWS = 8192
#: Rounding of distances, as a share of the largest norm.
SLACK = 1e-6


def farthest_points(rows: np.ndarray, most: int) -> np.ndarray:
    """Rows far apart: each next one is the farthest from all before."""
    if not len(rows):
        return rows
    chosen, apart = [0], ((rows - rows[0]) ** 2).sum(axis=1)
    while len(chosen) < min(most, len(rows)):
        at = int(apart.argmax())
        if apart[at] <= 0:
            break
        chosen.append(at)
        apart = np.minimum(apart, ((rows - rows[at]) ** 2).sum(axis=1))
    return rows[chosen]


def pivots_of(rows: DataFrame, sample_rows: int, most: int, seed: int = 42) -> np.ndarray:
    """Pivots from the rows (``id, vec``) of least hash; at most ``sample_rows`` rows come to the driver."""
    sample = rows.orderBy(F.xxhash64(F.lit(seed), F.col("id").cast("string")), "id").select("vec").limit(sample_rows).collect()
    return farthest_points(np.array([r.vec for r in sample], dtype=np.float64), most)


def _placed(rows: DataFrame, pivots: np.ndarray, block_rows: int, by: list[str]) -> DataFrame:
    """Rows with their ball, their distance to its pivot, and the ball's block they belong to."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)
    squares = (pivots * pivots).sum(axis=1)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack([np.asarray(v, dtype=np.float64) for v in batch["vec"]])
                apart = (x * x).sum(axis=1)[:, None] + squares[None, :] - 2.0 * (x @ sent.value.T)
                ball = apart.argmin(axis=1)
                yield batch.assign(ball=ball.astype(np.int32), reach=np.sqrt(((x - sent.value[ball]) ** 2).sum(axis=1)))

    schema = T.StructType([*rows.schema.fields, T.StructField("ball", T.IntegerType()), T.StructField("reach", T.DoubleType())])
    placed = durable(rows.mapInPandas(nearest, schema))
    sizes = placed.groupBy(*by, "ball").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    return placed.join(sizes, [*by, "ball"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))


def _bundled(placed: DataFrame, by: list[str], counts: DataFrame) -> DataFrame:
    """Blocks of balls dealt into bundles; a ball of many blocks is in many bundles."""
    return N._with_blocks(placed, by, counts).withColumn("bundle", F.pmod(F.xxhash64("ball", "block"), F.greatest("n_blocks", F.lit(1))).cast("int"))


def _bundle_match(schema: T.StructType, by: list[str], k: int, exclude_same: bool):
    """Compares the balls of two bundles that may hold neighbours of each other."""

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for *group, ids, matrix, own, c_ids, c_matrix, theirs, q_kept, c_kept in zip(*(batch[c] for c in batch.columns)):
                qid, cid, own, theirs, q_kept, c_kept = (np.asarray(v) for v in (ids, c_ids, own, theirs, q_kept, c_kept))
                qv, cv = (np.frombuffer(m, np.float64).reshape(len(i), -1) for m, i in ((matrix, qid), (c_matrix, cid)))
                for ball in np.unique(q_kept):
                    mine, near_by = own == ball, np.isin(theirs, c_kept[q_kept == ball])
                    if not mine.any() or not near_by.any():
                        continue
                    near = N.closest_in_pieces(qv[mine], qid[mine], cv[near_by], cid[near_by], k, exclude_same)
                    for name, value in zip(by, group):
                        near[name] = value
                    yield near[schema.names]

    return match


def _summary(placed: DataFrame, by: list[str], side: str) -> DataFrame:
    return placed.groupBy(*by, "ball").agg(F.lit(side).alias("side"), F.count("*").alias("n"), F.min("reach").alias("low"), F.max("reach").alias("high"))


def ball_pairs(queries: DataFrame, corpus: DataFrame, pivots: np.ndarray, k: int, by: list[str]) -> DataFrame:
    """(by..., q_ball, c_ball, n_q, n_c, kept) of all pairs of balls of a group."""
    apart = np.sqrt(np.maximum(((pivots[:, None] - pivots[None]) ** 2).sum(axis=2), 0.0)) if len(pivots) <= 64 else _distances(pivots)
    slack = SLACK * (1.0 + np.sqrt((pivots * pivots).sum(axis=1).max(initial=0.0)))
    both = _summary(queries, by, "q").unionByName(_summary(corpus, by, "c"))
    types = [f"{b} {dict(queries.dtypes)[b]}" for b in by]

    def decide(part: pd.DataFrame) -> pd.DataFrame:
        q, c = (part[part["side"] == s].sort_values("ball") for s in "qc")
        out = []
        d = apart[np.ix_(q["ball"], c["ball"])] if len(q) and len(c) else np.zeros((len(q), len(c)))
        for i, (ball, n, high_q) in enumerate(zip(q["ball"], q["n"], q["high"])):
            most = d[i] + high_q + c["high"].to_numpy() + slack
            least = np.maximum(np.maximum(d[i] - high_q - c["high"].to_numpy(), c["low"].to_numpy() - d[i] - high_q), 0.0) - slack
            order = np.argsort(most, kind="stable")
            enough = np.searchsorted(np.cumsum(c["n"].to_numpy()[order]), k, side="left")
            bound = most[order[enough]] if enough < len(order) else np.inf
            group = {b: part[b].iloc[0] for b in by}
            out.append(pd.DataFrame({**group, "q_ball": ball, "c_ball": c["ball"].to_numpy(), "n_q": n, "n_c": c["n"].to_numpy(), "kept": least <= bound}))
        columns = [*by, "q_ball", "c_ball", "n_q", "n_c", "kept"]
        return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)

    return both.groupBy(*by).applyInPandas(decide, ", ".join([*types, "q_ball int, c_ball int, n_q long, n_c long, kept boolean"]))


def _distances(points: np.ndarray) -> np.ndarray:
    squares = (points * points).sum(axis=1)
    return np.sqrt(np.maximum(squares[:, None] + squares[None, :] - 2.0 * (points @ points.T), 0.0))


def nearest_in_balls(
    queries: DataFrame, corpus: DataFrame, k: int, *, query_id: str, corpus_id: str, vector: str, by: Sequence[str] = (),
    exclude_same: bool = False, block_rows: int = N.BLOCK_ROWS, pivots: int | None = None, sample_rows: int = SAMPLE_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """The rows of ``neighbors.nearest_neighbors``, and one row ``visited``: the share of row pairs that were compared.

    Without ``pivots`` there is one for a quarter of a block's rows, up to ``PIVOTS``. Ids are taken as distinct; with ``exclude_same`` one more neighbour is allowed for in the bound.
    """
    by = list(by)
    vec = F.col(vector).cast("array<double>").alias("vec")
    asked = queries.select(*by, F.col(query_id).alias("id"), vec)
    rows = corpus.select(*by, F.col(corpus_id).alias("id"), vec)
    chosen = pivots_of(rows, sample_rows, pivots or min(PIVOTS, 1 + 4 * rows.count() // block_rows))
    schema = N._schema(by, queries, query_id, corpus, corpus_id)
    if not len(chosen):
        spark = queries.sparkSession
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())])), spark.createDataFrame([(0.0,)], "visited double")
    q, c = (_placed(side, chosen, block_rows, by) for side in (asked, rows))
    pairs = durable(ball_pairs(q, c, chosen, k + int(exclude_same), by))
    visited = pairs.agg((F.sum(F.when(F.col("kept"), F.col("n_q") * F.col("n_c")).otherwise(0)) / F.sum(F.col("n_q") * F.col("n_c"))).alias("visited"))

    q = _bundled(q, by, N._block_counts(asked, by, block_rows))
    c = _bundled(c, by, N._tile_counts(rows, by, block_rows))
    left = pairs.filter("kept").select(*by, "q_ball", "c_ball")
    for side, rows_of in (("q", q), ("c", c)):
        left = left.join(rows_of.select(*by, F.col("ball").alias(f"{side}_ball"), F.col("bundle").alias(f"{side}_bundle")).distinct(), [*by, f"{side}_ball"])
    left = left.groupBy(*by, "q_bundle", "c_bundle").agg(F.collect_list("q_ball").alias("q_kept"), F.collect_list("c_ball").alias("c_kept"))
    places = [*by, "bundle"]
    ours = N.packed_blocks(q, places, "ball").withColumnsRenamed({"bundle": "q_bundle", "ball": "balls"})
    theirs = N.packed_blocks(c, places, "ball").withColumnsRenamed({"bundle": "c_bundle", "ids": "c_ids", "matrix": "c_matrix", "ball": "c_balls"})
    met = ours.join(left, [*by, "q_bundle"]).join(theirs, [*by, "c_bundle"])
    found = met.select(*by, "ids", "matrix", "balls", "c_ids", "c_matrix", "c_balls", "q_kept", "c_kept").mapInPandas(_bundle_match(schema, by, k, exclude_same), schema)
    return N._top(found, k, by), visited
