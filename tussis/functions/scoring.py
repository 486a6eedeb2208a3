"""Scores and probabilities of fitted or given models as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from tussis.functions.signal import total

DECISION = 0.5


@dataclass(frozen=True)
class LinearScorer:
    """A linear decision function over a feature vector."""

    name: str
    weights: Sequence[float]
    bias: float = 0.0

    def score(self, vector: Column) -> Column:
        weights = F.array(*[F.lit(float(w)) for w in self.weights])
        return total(F.zip_with(vector, weights, lambda x, w: x * w)) + self.bias


def sigmoid(score: Column) -> Column:
    return 1 / (1 + F.exp(-score))


def predicted(disease_probability: Column, tie_is_disease: bool = False) -> Column:
    """Class with the larger probability; a tie is class 0 (arg max) unless it came from a decision score."""
    p = disease_probability
    return ((p >= DECISION) if tie_is_disease else (p > DECISION)).cast("int")


def confidence(disease_probability: Column) -> Column:
    return F.greatest(disease_probability, 1 - disease_probability)


def soft_vote(probabilities: Sequence[Column]) -> Column:
    return sum(probabilities[1:], probabilities[0]) / len(probabilities)


def consensus(predictions: Sequence[Column]) -> Column:
    """Vote of models that are columns of one row; disease needs more than half."""
    disease = sum(predictions[1:], predictions[0]).cast("bigint")
    return F.struct(
        (F.lit(len(predictions)) - disease).alias("healthy_votes"),
        disease.alias("disease_votes"),
        F.when(disease > len(predictions) / 2, "Disease signal").otherwise("Healthy signal").alias("consensus"),
    )


def model_rows(probabilities: Mapping[str, Column], accuracies: Mapping[str, float] | None = None, tie_is_disease: bool = True) -> Column:
    """Array of one struct per model: what each model says about the row.

    Exploding it gives the long model comparison without a join: the models
    are columns of the row already.
    """
    known = accuracies or {}
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("model"),
                F.when(predicted(p, tie_is_disease) == 1, "Disease").otherwise("Healthy").alias("label"),
                predicted(p, tie_is_disease).alias("prediction"),
                confidence(p).alias("confidence"),
                p.alias("disease_probability"),
                F.lit(float(known.get(name) or 0.0)).alias("accuracy"),
            )
            for name, p in probabilities.items()
        ]
    )
