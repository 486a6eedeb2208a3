"""Votes, binary metrics and ROC-AUC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tussis.operators.running import with_running_totals


def consensus(comparison: DataFrame, key: str) -> DataFrame:
    """Disease only with more than half of the votes, for a stored long comparison."""
    votes = comparison.groupBy(key).agg(F.sum("prediction").alias("disease_votes"), F.count("*").alias("n_models"))
    return votes.select(
        key,
        (F.col("n_models") - F.col("disease_votes")).alias("healthy_votes"),
        "disease_votes",
        F.when(F.col("disease_votes") > F.col("n_models") / 2, "Disease signal").otherwise("Healthy signal").alias("consensus"),
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def binary_metrics(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall and F1; a zero denominator gives 0."""
    y, p = F.col(label), F.col(prediction)
    counts = df.groupBy(*by).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        *by, "tp", "fp", "fn", "tn",
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
    )


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve, ties counted half; null without both classes.

    Rows are first reduced to one per distinct score, and the cumulative count
    of negatives is taken in bounded slices.
    """
    y = F.col(label)
    scores = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    ranked = with_running_totals(scores, [score], {"neg_upto": F.col("neg")}, by)
    won = F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2)
    totals = ranked.groupBy(*by).agg(F.sum(won).alias("won"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    pairs = F.col("n_pos") * F.col("n_neg")
    return totals.select(*by, "n_pos", "n_neg", F.when(pairs > 0, F.col("won") / pairs).alias("auc"))
