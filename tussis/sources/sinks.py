"""Writers, the content-addressed cache and the assessment history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Fixed value: how many assessments the history keeps.
HISTORY_KEEP = 200

HISTORY_SCHEMA = "patient_id STRING, ts TIMESTAMP_NTZ, id BIGINT, label STRING, risk STRING, confidence DOUBLE, age DOUBLE, gender STRING, model STRING"


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(df: DataFrame, path: str, column: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_model_summary(models: DataFrame, path: str) -> None:
    """One JSON object per line, model name to its numbers; nulls are left out."""
    fields = [c for c in models.columns if c != "model"]
    entry = F.to_json(F.create_map(F.col("model"), F.struct(*fields)))
    write_text(models.select(entry.alias("entry")), path, "entry")


def fingerprint(df: DataFrame) -> str:
    """Order-independent content hash, one aggregate pass."""
    h = F.xxhash64(*df.columns)
    n, mixed, total = df.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first()
    return f"{n}-{(mixed or 0) & (2**64 - 1):016x}-{abs(int(total or 0)):x}"


def cached(inputs: DataFrame, folder: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``compute(inputs)`` read back from Parquet, computed only for new inputs."""
    path = f"{folder.rstrip('/')}/{fingerprint(inputs)}"
    spark = inputs.sparkSession
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        compute(inputs).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


def append_history(df: DataFrame, path: str) -> None:
    """Append assessments in the history schema; files are laid out by day."""
    typed = df.to(T.StructType.fromDDL(HISTORY_SCHEMA))
    # Rebalancing by day avoids a file per task and day, and splits a crowded day.
    typed.withColumn("day", F.to_date("ts")).hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)


def read_history(spark: SparkSession, *paths: str) -> DataFrame:
    """The history at the first path that has one, else an empty frame with its schema."""
    for path in paths:
        try:
            return spark.read.schema(HISTORY_SCHEMA + ", day DATE").parquet(path).drop("day")
        except AnalysisException:
            continue
    return spark.createDataFrame([], HISTORY_SCHEMA)


def retained(history: DataFrame, keep: int = HISTORY_KEEP) -> DataFrame:
    """The newest ``keep`` assessments; each task keeps only its own newest."""
    return history.orderBy(F.desc("ts"), F.desc("id")).limit(keep)


def purge_history(spark: SparkSession, path: str) -> None:
    """Remove every stored assessment."""
    spark.createDataFrame([], HISTORY_SCHEMA + ", day DATE").write.mode("overwrite").parquet(path)
