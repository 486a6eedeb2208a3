"""Scaling and encoding, as plain columns and as a Spark ML pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import ElementwiseProduct, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, functions as F

MAX_CATEGORIES = 1000


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population std, a constant column divided by 1; one extra pass."""
    moments = df.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in columns],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
        ).alias("m")
    ).scalar()

    def scaled(c: str):
        spread = F.col(f"__m.s_{c}")
        return (F.col(c) - F.col(f"__m.m_{c}")) / F.when(spread == 0, 1.0).otherwise(spread)

    # The subquery is attached once; its fields are then plain references.
    return df.withColumn("__m", moments).withColumns({c: scaled(c) for c in columns}).drop("__m")


def categories_of(df: DataFrame, column: str, limit: int = MAX_CATEGORIES) -> list[str]:
    """Distinct values in alphabetical order; refuses a column with too many."""
    values = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()]
    if len(values) > limit:
        raise ValueError(f"{column} has more than {limit} categories")
    return sorted(values)


def one_hot(df: DataFrame, column: str, categories: Sequence[str] | None = None) -> DataFrame:
    """One 0/1 column per category; an unknown value gives all zeros."""
    names = categories_of(df, column) if categories is None else list(categories)
    return df.withColumns({f"{column}_{v}": F.when(F.col(column) == v, 1.0).otherwise(0.0) for v in names})


def scaler_stages(n_rows: int, width: int, source: str = "numbers", out: str = "scaled") -> list:
    """Population-std scaling: the built-in scaler uses the sample std, so a factor follows."""
    factor = (n_rows / (n_rows - 1)) ** 0.5 if n_rows > 1 else 1.0
    return [
        StandardScaler(inputCol=source, outputCol=f"{out}_sample", withMean=True, withStd=True),
        ElementwiseProduct(inputCol=f"{out}_sample", outputCol=out, scalingVec=Vectors.dense([factor] * width)),
    ]


def preprocessor(numeric: Sequence[str], categorical: Sequence[str], n_rows: int, out: str = "features") -> Pipeline:
    """Scaled numbers followed by one-hot categories; other columns are left out of the vector."""
    stages = [VectorAssembler(inputCols=list(numeric), outputCol="numbers"), *scaler_stages(n_rows, len(numeric))]
    if categorical:
        codes, flags = [f"{c}_code" for c in categorical], [f"{c}_flags" for c in categorical]
        stages += [
            StringIndexer(inputCols=list(categorical), outputCols=codes, stringOrderType="alphabetAsc", handleInvalid="keep"),
            OneHotEncoder(inputCols=codes, outputCols=flags, dropLast=True),
        ]
    else:
        flags = []
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=["scaled", *flags], outputCol=out)])
