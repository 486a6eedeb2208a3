"""Cleaning, imputation, encoding and column selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tussis.functions import clean as C
from tussis.operators.profile import nan_to_null
from tussis.operators.quantiles import exact_quantiles
from tussis.operators.running import with_row_number
from tussis.operators.sizing import join_measured
from tussis.session import durable


def ensure_columns(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """Add absent columns as typed nulls."""
    absent = {name: F.lit(None).cast(kind) for name, kind in schema.items() if name not in df.columns}
    return df.withColumns(absent) if absent else df


def clean_metadata(df: DataFrame) -> DataFrame:
    """Metadata sidecars to typed columns, missing columns added.

    Median imputation is a separate step (``impute_median``) because it needs
    a second pass.
    """
    kinds = {c: "string" for c in ["gender", "status", "cough_detected", "latitude", "longitude", "age", "respiratory_condition", "fever_muscle_pain"]}
    df = ensure_columns(df, kinds)
    numbers = ["cough_detected", "latitude", "longitude", "age"]
    flags = ["respiratory_condition", "fever_muscle_pain"]
    return df.withColumns(
        {c: C.clean_category(F.col(c)) for c in ["gender", "status"]}
        | {c: C.to_number(F.col(c)) for c in numbers}
        | {c: C.parse_bool(F.col(c)) for c in flags}
    )


def label_metadata(df: DataFrame) -> DataFrame:
    """Target, subtype and imputed clinical fields; undecided rows are dropped."""
    experts = ["expert_labels_1", "expert_labels_2", "expert_labels_3"]
    df = ensure_columns(df, {e: "struct<diagnosis:string>" for e in experts})
    df = ensure_columns(df, {c: "string" for c in ["status", "gender", "age", "cough_detected", "respiratory_condition", "fever_muscle_pain"]})
    df = df.withColumn("__status", C.normalised(F.col("status")))
    df = df.withColumn("__diagnosis", C.first_label([F.col(f"{e}.diagnosis") for e in experts]))
    status, diagnosis = F.col("__status"), F.col("__diagnosis")
    return df.where(C.is_decided(status, diagnosis)).select(
        "file_id",
        *[c for c in ["audio_path"] if c in df.columns],
        C.target_of(status, diagnosis).alias("target"),
        C.subtype_of(status, diagnosis).alias("disease_subtype"),
        C.clamp_domain(F.col("gender")).alias("gender"),
        C.number_or(F.col("age"), C.DEFAULT_AGE).alias("age"),
        C.number_or(F.col("cough_detected"), C.DEFAULT_COUGH).alias("cough_detected"),
        F.coalesce(F.lower(F.col("respiratory_condition").cast("string")) == "true", F.lit(False)).alias("respiratory_condition"),
        F.coalesce(F.lower(F.col("fever_muscle_pain").cast("string")) == "true", F.lit(False)).alias("fever_muscle_pain"),
    )


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill nulls and NaN with the exact median, computed as a one-row subquery."""
    df = nan_to_null(df, columns)
    medians = exact_quantiles(df, columns, {"median": 0.5})
    wide = medians.agg(*[F.max(F.when(F.col("column_name") == c, F.col("median"))).alias(c) for c in columns])
    one = wide.select(F.struct(*columns).alias("m")).scalar()
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col(f"__m.{c}")) for c in columns}
    return df.withColumn("__m", one).withColumns(filled).drop("__m")


def binary_rows(df: DataFrame, status: str = "status", target: str = "target") -> DataFrame:
    """Rows of the two modelled classes with an integer target."""
    return df.where(F.col(status).isin(list(C.BINARY_TARGET))).withColumn(target, C.binary_target(F.col(status)))


def numeric_projection(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Numeric and boolean columns that are not excluded, in schema order."""
    kinds = (T.NumericType, T.BooleanType)
    return df.select(*[f.name for f in df.schema if isinstance(f.dataType, kinds) and f.name not in exclude])


def conform_columns(df: DataFrame, expected: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """Exactly ``expected`` in order; absent ones become 0.0 or "unknown"."""
    text = set(categorical)

    def default(name: str) -> Column:
        return F.lit("unknown") if name in text else F.lit(0.0)

    return df.select(*[F.col(c) if c in df.columns else default(c).alias(c) for c in expected])


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """(column_name, n_numeric) for columns where at least one value is a number."""
    names = [c for c in df.columns if c not in exclude]
    counts = df.agg(*[F.count(C.to_number(F.col(c))).alias(c) for c in names])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_numeric")) for c in names])
    return counts.select(F.inline(rows)).where("n_numeric > 0")


def factorize(df: DataFrame, column: str, order_by: str, code: str = "code") -> DataFrame:
    """Integer code by first appearance of each value, null as -1.

    Only the distinct values are numbered; the code table is broadcast when small.
    """
    firsts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(order_by).alias("__first"))
    codes = durable(with_row_number(firsts, ["__first", column], "__n").select(column, (F.col("__n") - 1).alias(code)))
    return join_measured(df, codes, column, "left").withColumn(code, F.coalesce(F.col(code), F.lit(-1)))
