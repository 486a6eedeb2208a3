"""Shared pieces of the streaming jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType

from tussis.session import scratch_path


def read_files(spark: SparkSession, folder: str, pattern: str | None, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as they arrive. ``files_per_trigger`` bounds what a micro-batch takes; without it a backlog is one batch."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def read_table(spark: SparkSession, folder: str, name: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """The table ``name`` of ``folder`` as its files arrive, whether it is one file or a folder of them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return read_files(spark, f"{folder}/{name}", None, schema, files_per_trigger)
    return read_files(spark, folder, name, schema, files_per_trigger)


def epoch_micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since the epoch; a zone-less timestamp is read as UTC whatever the session zone is."""
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts))
    return F.unix_micros(F.col(ts))


def instant(df: DataFrame, ts: str) -> Column:
    """A timestamp that a watermark accepts."""
    return F.timestamp_micros(epoch_micros(df, ts))


def finish(query: StreamingQuery, seconds: int = 600) -> None:
    """Wait for an ``availableNow`` query and raise when it does not end."""
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"streaming query still running after {seconds} s")


def available_now(writer: DataStreamWriter, spark: SparkSession, seconds: int = 600) -> None:
    checkpoint = scratch_path(spark, "stream-checkpoint")
    finish(writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(), seconds)


def write_batches(stream: DataFrame, path: str, mode: str) -> DataStreamWriter:
    """One folder per micro-batch; a repeated batch overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return stream.writeStream.outputMode(mode).foreachBatch(write)


def newest_state(batches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last emitted version of every key of an update-mode output."""
    values = [c for c in batches.columns if c not in (*keys, "batch_id")]
    last = F.max_by(F.struct(*values), "batch_id").alias("v")
    return batches.groupBy(*keys).agg(last).select(*keys, "v.*")
