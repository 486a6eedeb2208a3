"""Profiling of a table: missingness, counts, moments, quantiles, correlation, duplicates."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tussis.operators.quantiles import exact_quantiles

QUARTILES = {"q25": 0.25, "q50": 0.50, "q75": 0.75}


def nan_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NaN is a missing value: null from here on, in floating-point columns."""
    kinds = (T.DoubleType, T.FloatType)
    floating = [f.name for f in df.schema if isinstance(f.dataType, kinds) and (columns is None or f.name in columns)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floating})


def _rows(totals: DataFrame, columns: Sequence[str], fields: Mapping[str, str], key: str = "column_name") -> DataFrame:
    """Turn wide aggregates ``{prefix}{column}`` into one row per column."""
    structs = [
        F.struct(F.lit(c).alias(key), *[F.col(prefix + c).alias(name) for name, prefix in fields.items()])
        for c in columns
    ]
    keep = [c for c in totals.columns if not any(c == p + x for p in fields.values() for x in columns)]
    return totals.select(*keep, F.inline(F.array(*structs)))


def missingness(df: DataFrame) -> DataFrame:
    """(column_name, missing_count, missing_pct), most missing first; one pass. NaN is missing."""
    df = nan_to_null(df)
    totals = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(c).isNull()).alias(f"m_{c}") for c in df.columns])
    rows = _rows(totals, df.columns, {"missing_count": "m_"})
    pct = F.when(F.col("__n") > 0, F.col("missing_count") / F.col("__n") * 100).otherwise(0.0)
    return rows.withColumn("missing_pct", pct).drop("__n").orderBy(F.desc("missing_count"), "column_name")


def completeness(df: DataFrame) -> DataFrame:
    """Share of cells that are neither null nor NaN, and the missing share rounded to 2 places."""
    df = nan_to_null(df)
    nulls = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in df.columns), F.lit(0))
    totals = df.agg(F.sum(nulls.cast("bigint")).alias("missing"), (F.count("*") * len(df.columns)).alias("cells"))
    return totals.select(
        (F.try_divide(F.col("cells") - F.col("missing"), F.col("cells")) * 100).alias("complete_pct"),
        F.round(F.try_divide(F.col("missing"), F.col("cells")) * 100, 2).alias("missing_pct"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n, proportion of non-null rows), most frequent first.

    The total is a scalar subquery over the same counts, not a window.
    """
    present = df.where(F.col(column).isNotNull())
    counts = present.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("proportion", F.col("n") / total).orderBy(F.desc("n"), "value")


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of ``row`` x ``values``, zero where absent; the value list is given, so one pass."""
    cells = df.where(F.col(row).isNotNull() & F.col(column).isin(list(values)))
    return cells.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def describe(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """count, mean, sample std, min, quartiles, max per column (and group), without nulls and NaN."""
    df = nan_to_null(df, columns)
    measures = {
        "count": lambda c: F.count(c), "mean": lambda c: F.avg(c), "std": lambda c: F.stddev_samp(c),
        "min": lambda c: F.min(c.cast("double")), "max": lambda c: F.max(c.cast("double")),
    }
    aggregates = [fn(F.col(c)).alias(f"__{m}_{c}") for m, fn in measures.items() for c in columns]
    totals = df.groupBy(*by).agg(*aggregates) if by else df.agg(*aggregates)
    rows = _rows(totals, columns, {m: f"__{m}_" for m in measures})
    quantiles = exact_quantiles(df, columns, QUARTILES, by)
    joined = rows.join(quantiles, [*by, "column_name"], "left")
    return joined.select(*by, "column_name", "count", "mean", "std", "min", *QUARTILES, "max")


_PARTIAL = "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"


def correlations(df: DataFrame, columns: Sequence[str], diagonal: bool = False) -> DataFrame:
    """(x, y, r) for every pair, over the rows where both are present (neither null nor NaN).

    Every task adds up its matrix products under the masks of missing cells, one Arrow batch at a time, and hands on
    one row of sums per pair, whatever its number of rows. The columns are centred first (one cheap scan), so that
    the sums don't cancel.
    """
    names = list(columns)
    numbers = nan_to_null(df.select(*[F.col(c).cast("double").alias(c) for c in names]))
    # Integer means are as good a centre, and the same however the rows are split.
    centre = np.array([0.0 if m is None else m for m in numbers.agg(*[F.round(F.avg(c)).alias(c) for c in names]).first()])
    first, second = np.triu_indices(len(names), 0 if diagonal else 1)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((6, len(names), len(names)))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1) - centre
            there = ~np.isnan(x)
            x = np.where(there, x, 0.0)
            mask, square = there.astype(float), x * x
            sums += np.stack([mask.T @ mask, x.T @ mask, mask.T @ x, square.T @ mask, mask.T @ square, x.T @ x])
        yield pa.RecordBatch.from_arrays(
            [pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32)), *[pa.array(s[first, second]) for s in sums]],
            [c.split()[0] for c in _PARTIAL.split(", ")])

    totals = numbers.mapInArrow(partial, _PARTIAL).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    named = F.array(*[F.lit(c) for c in names])
    spread = F.sqrt(F.expr("n * sxx - sx * sx")) * F.sqrt(F.expr("n * syy - sy * sy"))
    r = F.when(spread > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.expr("n * sxy - sx * sy") / spread)))
    return totals.select(F.get(named, F.col("i")).alias("x"), F.get(named, F.col("j")).alias("y"), r.alias("r"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The full matrix in long form, diagonal included."""
    mirrored = F.array_distinct(F.array(F.struct("x", "y", "r"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"), "r")))
    return correlations(df, columns, diagonal=True).select(F.inline(mirrored))


def redundant_pairs(df: DataFrame, columns: Sequence[str], threshold: float = 0.9) -> DataFrame:
    """Upper-triangle pairs whose correlation exceeds ``threshold`` in size."""
    return correlations(df, columns).where(F.abs("r") > threshold)


def correlation_with_target(df: DataFrame, vector: Column, target: Column) -> DataFrame:
    """(feature, r) for every position of an array column."""
    cells = df.select(target.cast("double").alias("t"), F.posexplode(vector).alias("feature", "v")).where(~F.isnan("v"))
    return cells.groupBy("feature").agg(F.corr(F.col("v").cast("double"), "t").alias("r"))


def top_features(importances: DataFrame, n: int = 15) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(n)


def _comparable(field: T.StructField) -> Column:
    """Nested cells as JSON with sorted map keys, so that equal content compares equal."""
    c = F.col(field.name)
    if isinstance(field.dataType, T.MapType):
        return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))
    if isinstance(field.dataType, (T.StructType, T.ArrayType)):
        return F.to_json(c)
    return c


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: rows beyond the first of each distinct row.

    Text and nested cells are reduced to a SHA-256 digest of the row before the
    shuffle, which then carries 64 bytes per row however long the texts are.
    """
    df = nan_to_null(df, columns)
    fields = [f for f in df.schema if columns is None or f.name in columns]
    cells = [_comparable(f).alias(f.name) for f in fields]
    fixed_width = all(isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DatetimeType)) for f in fields)
    keys = cells if fixed_width else [F.sha2(F.to_json(F.struct(*cells)), 256).alias("digest")]
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def quality_report(df: DataFrame, duplicate_on: Sequence[str]) -> DataFrame:
    """Rows, columns, column kinds, complete and incomplete rows, duplicates. NaN is missing."""
    df = nan_to_null(df)
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    any_null = F.lit(False)
    for c in df.columns:
        any_null = any_null | F.col(c).isNull()
    duplicates = duplicate_rows(df, duplicate_on).scalar()
    return df.agg(
        F.count("*").alias("total_records"),
        F.count_if(~any_null).alias("complete_cases"),
        F.count_if(any_null).alias("records_with_missing"),
    ).select(
        "*",
        F.lit(len(df.columns)).alias("total_features"),
        F.lit(len(numeric)).alias("numeric_features"),
        F.lit(len(df.columns) - len(numeric)).alias("categorical_features"),
        duplicates.alias("duplicate_rows"),
    )


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column; exact unless ``approximate``."""
    if approximate:
        totals = df.agg(*[F.approx_count_distinct(c).alias(f"d_{c}") for c in columns])
        return _rows(totals, columns, {"n_distinct": "d_"})
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns])
    values = df.select(F.inline(cells)).where("v IS NOT NULL").distinct()
    return values.groupBy("column_name").agg(F.count("*").alias("n_distinct"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins over [min, max], the last bin closed; every bin is listed."""
    df = nan_to_null(df, [column])
    value = F.col(column).cast("double")
    present = df.where(value.isNotNull())
    ends = present.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("s")).scalar()
    # numpy widens a zero-width range by half on both sides
    lo = F.when(F.col("e.lo") == F.col("e.hi"), F.col("e.lo") - 0.5).otherwise(F.col("e.lo"))
    hi = F.when(F.col("e.lo") == F.col("e.hi"), F.col("e.hi") + 0.5).otherwise(F.col("e.hi"))
    placed = present.select(value.alias("v"), ends.alias("e")).select(
        F.least(F.floor((F.col("v") - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    )
    counted = placed.groupBy("bin").agg(F.count("*").alias("n"))
    spark = df.sparkSession
    return (
        spark.range(bins).select(F.col("id").cast("int").alias("bin"))
        .join(counted, "bin", "left")
        .select("bin", F.coalesce("n", F.lit(0)).alias("n"), ends.alias("e"))
        .select("bin", (lo + (hi - lo) * F.col("bin") / bins).alias("lower"), (lo + (hi - lo) * (F.col("bin") + 1) / bins).alias("upper"), "n")
    )


def class_counts(df: DataFrame, target: str = "target") -> DataFrame:
    return df.agg(
        F.count("*").alias("n"),
        F.count_if(F.col(target) == 0).alias("n_healthy"),
        F.count_if(F.col(target) == 1).alias("n_disease"),
    )
