"""Joins between metadata, recordings and lookup tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tussis.functions.clean import extension, stem
from tussis.operators.sizing import join_measured

# Extension priority of the two ingest paths, and rejected file types.
AUDIO_PRIORITY = [".webm", ".wav", ".ogg", ".mp3", ".m4a"]
AUDIO_PRIORITY_TRAINING = [".webm", ".ogg", ".wav", ".mp3"]
NON_AUDIO_EXTENSIONS = [
    ".pdf", ".doc", ".docx", ".txt", ".json", ".zip", ".tar", ".gz",
    ".csv", ".xlsx", ".png", ".jpg", ".jpeg", ".exe", ".bin", ".py",
]


def priority_rank(value: Column, priority: Sequence[str]) -> Column:
    """1-based position of ``value`` in ``priority``; null when it is not listed."""
    return F.nullif(F.array_position(F.array(*[F.lit(p) for p in priority]), value), F.lit(0))


def pick_first(df: DataFrame, key: str, order: Sequence[Column], values: Sequence[str]) -> DataFrame:
    """One row per key, the least by ``order``.

    An aggregate, so each task keeps one candidate per key before the shuffle.
    """
    best = F.min(F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(order)], *values)).alias("__best")
    return df.groupBy(key).agg(best).select(key, *[F.col(f"__best.{v}").alias(v) for v in values])


def audio_lookup(files: DataFrame, priority: Sequence[str] = tuple(AUDIO_PRIORITY)) -> DataFrame:
    """(file_id, audio_path) from a listing with a ``path`` column."""
    listed = files.select(
        stem(F.col("path")).alias("file_id"),
        F.col("path").alias("audio_path"),
        priority_rank(extension(F.col("path")), priority).alias("__rank"),
    ).where("__rank IS NOT NULL")
    return pick_first(listed, "file_id", [F.col("__rank")], ["audio_path"])


def reject_non_audio(df: DataFrame, path: str = "path") -> DataFrame:
    return df.where(~extension(F.col(path)).isin(NON_AUDIO_EXTENSIONS))


def with_features(metadata: DataFrame, features: DataFrame, key: str = "file_id") -> DataFrame:
    """Metadata rows that have features."""
    return metadata.join(features, key, "inner")


def having(metadata: DataFrame, recordings: DataFrame, key: str = "file_id") -> DataFrame:
    return metadata.join(recordings.select(key), key, "left_semi")


def lacking(metadata: DataFrame, recordings: DataFrame, key: str = "file_id") -> DataFrame:
    return metadata.join(recordings.select(key), key, "left_anti")


def lookup_or(df: DataFrame, lookup: DataFrame, key: str, value: str, default: float) -> DataFrame:
    """Left lookup with a default for absent keys; broadcast only when small."""
    found = join_measured(df, lookup.select(key, value), key, "left")
    return found.withColumn(value, F.coalesce(F.col(value), F.lit(default)))
