"""Summaries and choices over model scores (model, path, accuracy, status)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tussis.operators.quantiles import exact_quantiles
from tussis.operators.running import with_row_number

# Accuracy tiers and the serving order of model names.
TOP_TIER = 0.85
MID_TIER = 0.75
SERVING_ORDER = ["model", "random_forest", "extra_trees", "gradient_boosting"]


def statistics(models: DataFrame, accuracy: str = "accuracy") -> DataFrame:
    """Trained and failed counts and the spread of accuracies, one row."""
    a = F.col(accuracy)
    median = exact_quantiles(models, [accuracy], {"median": 0.5}).select("median").scalar()
    return models.agg(
        F.count(a).alias("trained"),
        F.count_if(a.isNull()).alias("failed"),
        F.avg(a).alias("mean_accuracy"),
        F.max(a).alias("best_accuracy"),
        F.min(a).alias("worst_accuracy"),
        F.stddev_samp(a).alias("std_accuracy"),
        (F.max(a) - F.min(a)).alias("accuracy_range"),
        (F.try_divide(F.count(a), F.count("*")) * 100).alias("success_rate"),
    ).withColumn("median_accuracy", median)


def tiers(models: DataFrame, accuracy: str = "accuracy") -> DataFrame:
    a = F.col(accuracy)
    return models.agg(
        F.count_if(a > TOP_TIER).alias("top_tier"),
        F.count_if((a >= MID_TIER) & (a <= TOP_TIER)).alias("mid_tier"),
        F.count_if(a < MID_TIER).alias("low_tier"),
    )


def blended_accuracy(test: Column, cross_validated: Column) -> Column:
    return F.round(test * 0.5 + cross_validated * 0.5, 4)


def ranked(models: DataFrame) -> DataFrame:
    """Position by accuracy, failed models last, ties by name."""
    keyed = models.withColumn("__down", -F.coalesce(F.col("accuracy"), F.lit(float("-inf"))))
    return with_row_number(keyed, ["__down", "model"], "position").drop("__down")


def best_and_worst(models: DataFrame) -> DataFrame:
    """First and last of the leaderboard among trained models, two candidates per task."""
    trained = models.where("accuracy IS NOT NULL").select(F.struct((-F.col("accuracy")).alias("down"), "model", "accuracy").alias("m"))
    ends = trained.agg(F.min("m").alias("best"), F.max("m").alias("worst"))
    return ends.select(
        F.col("best.model").alias("best_model"), F.col("best.accuracy").alias("best_accuracy"),
        F.col("worst.model").alias("worst_model"), F.col("worst.accuracy").alias("worst_accuracy"),
    )


def top_models(models: DataFrame, n: int = 10) -> DataFrame:
    return models.where("accuracy IS NOT NULL").orderBy(F.desc("accuracy"), "model").limit(n)


def choose_best(models: DataFrame) -> DataFrame:
    """Highest accuracy among models with a stored file; ties go to the first file name.

    Files without a usable score rank below every scored file.
    """
    stored = models.where("path IS NOT NULL")
    return stored.orderBy(F.coalesce(F.col("accuracy"), F.lit(-1.0)).desc(), "filename").limit(1)


def compatible(models: DataFrame, width: int, n_features: str = "n_features") -> DataFrame:
    """Models that take ``width`` inputs; one that does not say is kept."""
    return models.where(F.coalesce(F.col(n_features), F.lit(width)) == width)


def choose_by_priority(models: DataFrame, order=tuple(SERVING_ORDER)) -> DataFrame:
    """First stored model in a fixed order of names."""
    position = F.array_position(F.array(*[F.lit(n) for n in order]), F.col("model"))
    return models.where(F.col("path").isNotNull() & (position > 0)).orderBy(position, "filename").limit(1)
