"""Exact k nearest neighbours, block against block.

Rows are packed into blocks of bounded size, one row with the ids and one matrix each, on both sides. Every query block
meets every corpus block of its group once, so what moves is a copy of the queries for each corpus block, as
packed matrices. Corpus blocks grow with the group up to ``TILE_BYTES``, so that copies are few; a task compares a query block
with one piece of a corpus block after the other, by a matrix product each, works out the exact distance only of what can
be among the nearest, and hands on k candidates per query. One way for all sizes.

An exact search has to look at every pair unless the data are clustered. Where a share of the neighbours is enough,
``approximate_neighbors`` hashes by random projections and looks at one bucket only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tussis.operators.sizing import join_measured

DIGITS = 9
BLOCK_ROWS = 2048
#: A group's corpus is cut into ``TILES`` blocks (fewer where rows are few), and into more where they would exceed ``TILE_BYTES``.
TILES, TILE_BYTES = 12, 8 << 20
#: Distances of a matrix product are off by rounding; what lies this much beyond the k-th (of the vectors' size) is looked at again.
SLACK = 1e-6


def closest(qv: np.ndarray, qid: np.ndarray, cv: np.ndarray, cid: np.ndarray, k: int, exclude_same: bool) -> pd.DataFrame:
    """Top ``k`` corpus rows per query by (rounded distance, id)."""
    order = np.argsort(cid, kind="stable")
    cv, cid = cv[order], cid[order]
    q2, c2 = (qv * qv).sum(axis=1), (cv * cv).sum(axis=1)
    rough = q2[:, None] + c2[None, :] - 2.0 * (qv @ cv.T)
    if exclude_same:
        rough[qid[:, None] == cid[None, :]] = np.inf
    wanted = min(k, len(cid)) - 1
    limit = np.partition(rough, wanted, axis=1)[:, wanted] + SLACK * (1.0 + q2 + c2.max(initial=0.0))
    rows, at = np.nonzero((rough <= limit[:, None]) & np.isfinite(rough))
    exact = np.round(np.sqrt(((qv[rows] - cv[at]) ** 2).sum(axis=1)), DIGITS)
    first = np.lexsort((at, exact, rows))
    rows, at, exact = rows[first], at[first], exact[first]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    keep = place < k
    return pd.DataFrame({"query_id": qid[rows[keep]], "neighbor_id": cid[at[keep]], "distance": exact[keep]})


def _schema(by: Sequence[str], queries: DataFrame, query_id: str, corpus: DataFrame, corpus_id: str) -> T.StructType:
    fields = [T.StructField(b, queries.schema[b].dataType) for b in by]
    fields += [
        T.StructField("query_id", queries.schema[query_id].dataType),
        T.StructField("neighbor_id", corpus.schema[corpus_id].dataType),
        T.StructField("distance", T.DoubleType()),
    ]
    return T.StructType(fields)


def _block_counts(df: DataFrame, by: list[str], rows: int) -> DataFrame:
    return df.groupBy(*by).agg(F.ceil(F.count("*") / rows).cast("int").alias("n_blocks"))


def _tile_counts(df: DataFrame, by: list[str], rows: int) -> DataFrame:
    """Corpus blocks of a group: no smaller than ``rows`` rows, and then as few and large as tiles may be."""
    tiles = F.greatest(F.least(F.ceil(F.count("*") / rows), F.lit(TILES)), F.ceil(F.sum(F.size("vec")) * 8 / TILE_BYTES))
    return df.groupBy(*by).agg(tiles.cast("int").alias("n_blocks"))


def _with_blocks(df: DataFrame, by: list[str], counts: DataFrame) -> DataFrame:
    if by:
        return join_measured(df, counts, by)
    return df.withColumn("n_blocks", counts.select("n_blocks").scalar())


def _packed(df: DataFrame, by: list[str], counts: DataFrame) -> DataFrame:
    """One row (by..., block, ids, matrix) per block of rows (``id``, ``vec``)."""
    placed = _with_blocks(df, by, counts).withColumn("block", F.pmod(F.xxhash64("id"), F.greatest("n_blocks", F.lit(1))))
    return packed_blocks(placed, [*by, "block"])


def packed_blocks(placed: DataFrame, places: list[str], tags: str | None = None) -> DataFrame:
    """One row (places..., ids, matrix) for all rows (``id``, ``vec``) of the same places; with the rows' whole numbers ``tags``, if named."""
    fields = [T.StructField(p, placed.schema[p].dataType) for p in places]
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(placed.schema["id"].dataType)), T.StructField("matrix", T.BinaryType())])
    if tags:
        schema = schema.add(tags, T.ArrayType(T.IntegerType()))

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        matrix = np.stack([np.asarray(v, dtype=np.float64) for v in part["vec"]])
        extra = [part[tags].tolist()] if tags else []
        return pd.DataFrame([[*key, part["id"].tolist(), matrix.tobytes(), *extra]], columns=schema.names)

    return placed.select(*places, "id", "vec", *([tags] if tags else [])).groupBy(*places).applyInPandas(pack, schema)


def _top(found: DataFrame, k: int, by: list[str]) -> DataFrame:
    order = Window.partitionBy(*by, "query_id").orderBy("distance", "neighbor_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_neighbors(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    *,
    query_id: str,
    corpus_id: str,
    vector: str,
    by: Sequence[str] = (),
    exclude_same: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(by..., query_id, neighbor_id, distance, rank), exact, ranks from 1.

    ``by`` restricts neighbours to the same group. ``exclude_same`` leaves out
    the corpus row with the query's own id. Fewer than ``k`` rows come back
    only where the group has fewer.
    """
    by = list(by)
    schema = _schema(by, queries, query_id, corpus, corpus_id)
    vec = F.col(vector).cast("array<double>").alias("vec")
    wanted = queries.select(*by, F.col(query_id).alias("id"), vec)
    asked = _packed(wanted, by, _block_counts(wanted, by, block_rows))
    rows = corpus.select(*by, F.col(corpus_id).alias("id"), vec)
    blocks = _packed(rows, by, _tile_counts(rows, by, block_rows)).withColumnsRenamed({"ids": "c_ids", "matrix": "c_matrix"})
    sent = _with_blocks(asked.withColumnRenamed("block", "q_block"), by, _tile_counts(rows, by, block_rows)).where("n_blocks > 0")
    sent = sent.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_blocks") - 1)))
    pairs = sent.join(blocks, [*by, "block"]).select(*by, "ids", "matrix", "c_ids", "c_matrix")
    return _top(pairs.mapInPandas(block_match(schema, by, k, exclude_same), schema), k, by)


def closest_in_pieces(qv: np.ndarray, qid: np.ndarray, cv: np.ndarray, cid: np.ndarray, k: int, exclude_same: bool) -> pd.DataFrame:
    """``closest``, with the corpus cut into pieces of ``BLOCK_ROWS`` rows: a product is never larger than a block of each."""
    if len(cid) <= BLOCK_ROWS:
        return closest(qv, qid, cv, cid, k, exclude_same)
    pieces = (slice(at, at + BLOCK_ROWS) for at in range(0, len(cid), BLOCK_ROWS))
    return best_of([closest(qv, qid, cv[p], cid[p], k, exclude_same) for p in pieces], k)


def best_of(found: list[pd.DataFrame], k: int) -> pd.DataFrame:
    """The first ``k`` rows of each query by (distance, id)."""
    near = pd.concat(found, ignore_index=True).sort_values(["query_id", "distance", "neighbor_id"], kind="stable")
    return near[near.groupby("query_id", sort=False, dropna=False).cumcount() < k]


def block_match(schema: T.StructType, by: list[str], k: int, exclude_same: bool):
    """Compares the two blocks of each row (by..., ids, matrix, c_ids, c_matrix)."""
    names = schema.names

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for *group, ids, matrix, c_ids, c_matrix in zip(*(batch[c] for c in batch.columns)):
                qid, cid = np.asarray(ids), np.asarray(c_ids)
                qv, cv = (np.frombuffer(m, np.float64).reshape(len(i), -1) for m, i in ((matrix, qid), (c_matrix, cid)))
                near = closest_in_pieces(qv, qid, cv, cid, k, exclude_same)
                for name, value in zip(by, group):
                    near[name] = value
                yield near[names]

    return match


def approximate_neighbors(
    queries: DataFrame, corpus: DataFrame, k: int, *, query_id: str, corpus_id: str, vector: str, radius: float,
    bucket_length: float, tables: int = 8, seed: int = 42,
) -> DataFrame:
    """(query_id, neighbor_id, distance, rank) among rows within ``radius`` that share a bucket of a random projection.

    More ``tables`` find more and cost more; the recall on one's own data has to be measured against the exact search.
    """
    def ready(df: DataFrame, key: str) -> DataFrame:
        return df.select(F.col(key).alias("id"), array_to_vector(F.col(vector).cast("array<double>")).alias("v"))

    hashing = BucketedRandomProjectionLSH(inputCol="v", outputCol="hashes", bucketLength=bucket_length, numHashTables=tables, seed=seed)
    model = hashing.fit(ready(corpus, corpus_id))
    met = model.approxSimilarityJoin(ready(queries, query_id), ready(corpus, corpus_id), radius, "distance")
    return _top(met.select(F.col("datasetA.id").alias("query_id"), F.col("datasetB.id").alias("neighbor_id"), "distance"), k, [])


def distance_vote(neighbors: DataFrame, labels: DataFrame, label_id: str, label: str, weighted: bool = True) -> DataFrame:
    """Class-1 share of the neighbours' votes, 1/d or uniform.

    With a neighbour at distance 0 only such neighbours vote.
    """
    named = neighbors.join(labels.select(F.col(label_id).alias("neighbor_id"), F.col(label).cast("double").alias("y")), "neighbor_id")
    exact = F.col("distance") == 0
    d = F.nullif("distance", F.lit(0.0))
    sums = named.groupBy("query_id").agg(
        F.count_if(exact).alias("n_exact"),
        F.sum(F.when(exact, F.col("y"))).alias("exact_y"),
        F.sum(F.col("y") / d if weighted else F.col("y")).alias("vote"),
        F.sum(1 / d if weighted else F.lit(1.0)).alias("weight"),
    )
    share = F.when((F.col("n_exact") > 0) & F.lit(weighted), F.col("exact_y") / F.col("n_exact")).otherwise(F.col("vote") / F.col("weight"))
    return sums.select("query_id", share.alias("disease_probability"))
