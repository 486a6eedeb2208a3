"""Five fixed linear scorers over ``embeddings``, and their SQL."""

from __future__ import annotations

import math

from tussis.functions.scoring import LinearScorer

DIMENSIONS = 64
GAIN = 3.0
NAMES = ["extra_trees", "random_forest", "gradient_boosting", "svc", "logistic"]


def _bias(m: int) -> float:
    return (m - 2) * 0.25


SCORERS = [
    LinearScorer(name, [GAIN * math.cos((m + 1) * (j + 1)) for j in range(DIMENSIONS)], _bias(m))
    for m, name in enumerate(NAMES)
]


def sql_score(m: int) -> str:
    return (
        f"(list_sum(list_transform(range(1, {DIMENSIONS + 1}), lambda j: {GAIN}::DOUBLE * cos({m + 1} * j) * embedding[j]::DOUBLE))"
        f" + {_bias(m)}::DOUBLE)"
    )


def sql_probability(m: int) -> str:
    return f"(1 / (1 + exp(-{sql_score(m)})))"
