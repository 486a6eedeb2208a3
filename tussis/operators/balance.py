"""Folds, splits, class weights and synthetic minority rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tussis.operators.neighbors import nearest_neighbors
from tussis.operators.running import with_row_number, with_running_totals
from tussis.operators.sizing import join_measured
from tussis.session import durable

# Sizes and ranges of the synthetic rows, share of the test part.
ROWS_PER_CLASS = 120
NEIGHBORS = 5
BLEND_LOW, BLEND_HIGH = 0.15, 0.85
JITTER = 0.015
TEST_SHARE = 0.20
FOLDS = 5
SEED = 42
DRAWS_PER_TASK = 10_000


def _shuffled(key: str, seed: int, order_by: list[str] | None) -> list:
    return list(order_by) if order_by else [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)]


def _back(df: DataFrame, numbered: DataFrame, key: str, target: str) -> DataFrame:
    """``numbered`` joined to the columns of ``df`` it does not carry."""
    if set(df.columns) == {key, target}:
        return numbered
    return df.join(numbered.drop(target), key)


def stratified_folds(df: DataFrame, key: str, target: str, k: int = FOLDS, seed: int = SEED, order_by: list[str] | None = None) -> DataFrame:
    """Add ``fold`` 0..k-1, balanced to one row per class; the same for every run.

    Only key and target are put in order; the rest of a wide row is joined back once.
    """
    narrow = df.select(key, target)
    numbered = with_row_number(narrow, _shuffled(key, seed, order_by), "__n", [target])
    folds = numbered.withColumn("fold", F.pmod(F.col("__n") - 1, F.lit(k)).cast("int")).drop("__n")
    return _back(df, folds, key, target)


def stratified_split(df: DataFrame, key: str, target: str, test_share: float = TEST_SHARE, seed: int = SEED, order_by: list[str] | None = None) -> DataFrame:
    """Add ``is_test``: the first share of each class in a seeded order."""
    narrow = df.select(key, target)
    numbered = with_running_totals(narrow, _shuffled(key, seed, order_by), {"__n": F.lit(1).cast("bigint")}, [target], {"__n": "__of"})
    marked = numbered.withColumn("is_test", F.col("__n") <= F.round(F.col("__of") * test_share)).drop("__n", "__of")
    return _back(df, marked, key, target)


def class_weights(df: DataFrame, target: str, weight: str = "weight") -> DataFrame:
    """Add n / (classes * class size)."""
    counts = durable(df.groupBy(target).agg(F.count("*").alias("__n")))
    totals = counts.agg(F.struct(F.sum("__n").alias("n"), F.count("*").alias("k")).alias("s")).scalar()
    weights = counts.withColumn("__t", totals).select(target, (F.col("__t.n") / (F.col("__t.k") * F.col("__n"))).alias(weight))
    return join_measured(df, weights, target)


def uniform(seed: int, *parts: Column) -> Column:
    """[0, 1) from a hash, so that a rerun of a lost task draws the same number."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11) / float(2**53)


def digest_uniform(seed: int, *parts: Column) -> Column:
    """[0, 1) from SHA-256: slower, but the same number in any engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("bigint") / float(2**52)


Draw = Callable[..., Column]


def gaussian(seed: int, *parts: Column, draw: Draw = uniform) -> Column:
    radius = F.sqrt(-2 * F.log(1 - draw(seed, *parts, F.lit("radius"))))
    return radius * F.cos(2 * math.pi * draw(seed, *parts, F.lit("angle")))


def _draws(needs: DataFrame) -> DataFrame:
    """One row per missing sample, generated in bounded slices."""
    slices = F.sequence(F.lit(0), F.floor((F.col("deficit") - 1) / DRAWS_PER_TASK))
    cut = needs.withColumn("slice", F.explode(slices)).repartition("class", "slice")
    first = F.col("slice") * DRAWS_PER_TASK + 1
    last = F.least((F.col("slice") + 1) * DRAWS_PER_TASK, F.col("deficit"))
    return cut.select("class", "n", F.explode(F.sequence(first, last)).alias("draw"))


def _deficits(df: DataFrame, target: str, per_class: int) -> DataFrame:
    """(class, n, deficit) of the classes with fewer than ``per_class`` rows."""
    counts = df.groupBy(F.col(target).alias("class")).agg(F.count("*").alias("n"))
    return durable(counts.where(F.col("n") < per_class).withColumn("deficit", F.lit(per_class) - F.col("n")))


def synthesize(df: DataFrame, key: str, target: str, vector: str, per_class: int = ROWS_PER_CLASS, k: int = NEIGHBORS, seed: int = SEED,
               jitter: float = JITTER, draw: Draw = uniform, needs: DataFrame | None = None) -> DataFrame:
    """Synthetic (class, draw, base_id, neighbor_id, vector) rows for short classes.

    Each is a blend of a drawn row with one of its nearest neighbours of the
    class plus a small jitter; a class of one row is copied. Only rows that were
    drawn look for neighbours. All chance comes from ``draw``.
    """
    needs = _deficits(df, target, per_class) if needs is None else needs
    rows = df.select(F.col(target).alias("class"), F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("x"))
    short = durable(join_measured(rows, needs.select("class"), "class", "left_semi"))  # less than per_class rows per class
    numbered = with_row_number(short, ["id"], "at", ["class"])

    c, i = F.col("class"), F.col("draw")
    drawn = _draws(needs).withColumn("at", F.floor(draw(seed, c, i, F.lit("base")) * F.col("n")) + 1)
    based = drawn.join(numbered.withColumnRenamed("id", "base_id").withColumnRenamed("x", "base"), ["class", "at"])

    asked = based.select("class", F.col("base_id").alias("id"), F.col("base").alias("x")).dropDuplicates(["class", "id"])
    near = nearest_neighbors(asked, short, k, query_id="id", corpus_id="id", vector="x", by=["class"], exclude_same=True)
    choice = F.floor(draw(seed, c, i, F.lit("neighbor")) * F.least(F.lit(k), F.col("n") - 1)) + 1
    chosen = based.withColumn("rank", F.when(F.col("n") > 1, choice).cast("int"))
    linked = chosen.join(near.select("class", F.col("query_id").alias("base_id"), "rank", "neighbor_id"), ["class", "base_id", "rank"], "left")
    other = short.select("class", F.col("id").alias("neighbor_id"), F.col("x").alias("neighbor"))
    both = linked.join(other, ["class", "neighbor_id"], "left")

    blend = BLEND_LOW + (BLEND_HIGH - BLEND_LOW) * draw(seed, c, i, F.lit("blend"))
    mixed = F.when(F.col("neighbor").isNull(), F.col("base")).otherwise(
        F.zip_with("base", "neighbor", lambda a, b: a + F.col("blend") * (b - a))
    )
    both = both.withColumn("blend", blend).withColumn("mixed", mixed)
    shaken = F.transform("mixed", lambda x, j: x + jitter * gaussian(seed, c, i, j, draw=draw))
    return both.select("class", "draw", "base_id", "neighbor_id", shaken.alias("vector"))


def balanced(df: DataFrame, key: str, target: str, vector: str, per_class: int = ROWS_PER_CLASS, **options) -> DataFrame:
    """Original rows and the synthetic ones (``key`` null) as (key, target, vector, synthetic)."""
    original = df.select(key, target, F.col(vector).cast("array<double>").alias(vector), F.lit(False).alias("synthetic"))
    needs = _deficits(df, target, per_class)
    if needs.isEmpty():
        return original
    extra = synthesize(df, key, target, vector, per_class=per_class, needs=needs, **options)
    made = extra.select(
        F.lit(None).cast(df.schema[key].dataType).alias(key), F.col("class").alias(target), F.col("vector").alias(vector), F.lit(True).alias("synthetic")
    )
    return original.unionByName(made)
