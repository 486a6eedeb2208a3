"""The classifier families on Spark ML, their evaluation and persistence.

A fitted model is data (stages, numbers, rows), scored through ``Fitted.score``,
which adds one column with the probability of class 1, and can be stored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tussis.functions.scoring import model_rows, predicted, sigmoid, soft_vote
from tussis.operators import boosting, descent, kernel, trees
from tussis.operators.balance import balanced, stratified_folds, stratified_split
from tussis.operators.evaluate import binary_metrics, roc_auc
from tussis.operators.neighbors import distance_vote, nearest_neighbors
from tussis.session import durable

FEATURES, TARGET, WEIGHT = "features", "target", "weight"


@dataclass(frozen=True)
class ModelSizes:
    """Ensemble sizes and iteration limits; smaller values make a quick run.

    The published run has no depth limit for bagging and an exact kernel for the support vectors: a depth that small
    nodes rarely reach, and the kernel on the span of a number of landmarks, stand in for them.
    """

    # Sizes, depths, rates and penalties of the published training run.
    forest_trees: int = 150
    forest_depth: int = 10
    extra_depth: int = 12
    boosting_rounds: int = 120
    boosting_depth: int = 4
    boosting_rate: float = 0.08
    adaboost_rounds: int = 100
    adaboost_rate: float = 0.15
    bagging_trees: int = 60
    tree_depth: int = 8
    min_split: int = 3
    logistic_iterations: int = 1500
    logistic_c: float = 1.5
    sgd_alpha: float = 1e-4
    svc_c: float = 2.0
    neighbors: int = 5
    seed: int = 42
    # Parameters of the approximations.
    bagging_depth: int = 30
    svc_landmarks: int = 256
    svc_rounds: int = 60
    sgd_steps: int = 1500
    sgd_batch: int = 256


QUICK = ModelSizes(
    forest_trees=10, forest_depth=4, extra_depth=4, boosting_rounds=4, boosting_depth=3, adaboost_rounds=4, adaboost_rate=0.5,
    bagging_trees=8, bagging_depth=5, tree_depth=5, logistic_iterations=20, svc_landmarks=40, svc_rounds=5, sgd_steps=200,
)


@dataclass
class Fitted:
    """A trained model as data: Spark ML stages, numbers, kept rows or members."""

    name: str
    family: str
    stages: list = field(default_factory=list)
    numbers: dict = field(default_factory=dict)
    rows: DataFrame | None = None
    members: list[Fitted] = field(default_factory=list)

    def score(self, df: DataFrame, out: str) -> DataFrame:
        """``df`` with the class-1 probability in column ``out``."""
        return SCORE_BY_FAMILY[self.family](self, df, out)


def _score_stage(model: Fitted, df: DataFrame, out: str) -> DataFrame:
    value = F.get(vector_to_array("probability"), F.lit(1))
    return model.stages[0].transform(df).select(*df.columns, value.alias(out))


def _fit_stage(name: str, estimator: type, **settings) -> Callable[[DataFrame], Fitted]:
    """Fit ``estimator(**settings)``; it is built at fit time, when a session exists."""

    def fit(train: DataFrame) -> Fitted:
        return Fitted(name, "stage", [estimator(**settings).fit(train)])

    return fit


def _columns(weighted: bool) -> dict:
    base = {"featuresCol": FEATURES, "labelCol": TARGET}
    return base | ({"weightCol": WEIGHT} if weighted else {})


class Joint:
    """A family that is fitted for many training sets at once; called with one set, it fits that one."""

    def __init__(self, fit: Callable[[trees.Training], Mapping[int, Fitted]]):
        self.fit = fit

    def __call__(self, train: DataFrame) -> Fitted:
        return self.fit(trees.training([train], FEATURES, TARGET))[0]


def _forest(name: str, spec: trees.TreeSpec) -> Joint:
    """Grown trees as arrays; the probability is the mean of the leaves' shares."""

    def fit(data: trees.Training) -> dict[int, Fitted]:
        grown = trees.grow(data, spec)
        return {
            part: Fitted(name, "trees", numbers={
                "forest": trees.flat_forest(own, data.weights(part, spec.weighted)), "importance": trees.importance(own, data.width).tolist(), "base": None})
            for part, own in grown.items()}

    return Joint(fit)


def random_forest(s: ModelSizes) -> Joint:
    return _forest("random_forest", trees.TreeSpec(s.forest_trees, s.forest_depth, -1, bootstrap=True, min_split=s.min_split, seed=s.seed))


def extra_trees(s: ModelSizes) -> Joint:
    """Extremely randomised trees: all rows, one random cut point per drawn feature."""
    return _forest("extra_trees", trees.TreeSpec(s.forest_trees, s.extra_depth, -1, random_cuts=True, min_split=s.min_split, seed=s.seed))


def bagging(s: ModelSizes) -> Joint:
    return _forest("bagging", trees.TreeSpec(s.bagging_trees, s.bagging_depth, bootstrap=True, weighted=False, seed=s.seed))


def decision_tree(s: ModelSizes) -> Joint:
    return _forest("decision_tree", trees.TreeSpec(1, s.tree_depth, seed=s.seed))


def gradient_boosting(s: ModelSizes) -> Joint:
    def fit(data: trees.Training) -> dict[int, Fitted]:
        found = boosting.gradient_trees(data, s.boosting_rounds, s.boosting_depth, s.boosting_rate)
        return {part: Fitted("gradient_boosting", "trees", numbers=numbers) for part, numbers in found.items()}

    return Joint(fit)


def _score_trees(model: Fitted, df: DataFrame, out: str) -> DataFrame:
    forest, base = boosting.as_arrays(model.numbers["forest"]), model.numbers["base"]

    @F.pandas_udf(T.DoubleType())
    def told(v: pd.Series) -> pd.Series:
        out = np.zeros(len(v))
        for at in range(0, len(v), 2048):
            x = np.stack([np.asarray(row, dtype=np.float64) for row in v[at : at + 2048]])
            values = trees.leaves(forest, x)
            out[at : at + 2048] = values.mean(axis=1) if base is None else 1 / (1 + np.exp(-(base + values.sum(axis=1))))
        return pd.Series(out)

    return df.withColumn(out, told(vector_to_array(FEATURES)))


def logistic(s: ModelSizes) -> Callable[[DataFrame], Fitted]:
    def fit(train: DataFrame) -> Fitted:
        penalty = 1.0 / (s.logistic_c * max(1, train.count()))
        settings = {"maxIter": s.logistic_iterations, "regParam": penalty, "standardization": False}
        return _fit_stage("logistic", LogisticRegression, **settings, **_columns(True))(train)

    return fit


def sgd(s: ModelSizes) -> Joint:
    """Log-loss by averaged stochastic gradient steps."""

    def fit(data: trees.Training) -> dict[int, Fitted]:
        found = descent.sgd(data, s.sgd_alpha, s.sgd_steps, s.sgd_batch, s.seed)
        return {part: Fitted("sgd", "linear", numbers=numbers) for part, numbers in found.items()}

    return Joint(fit)


def _score_linear(model: Fitted, df: DataFrame, out: str) -> DataFrame:
    weights = F.array(*[F.lit(w) for w in model.numbers["weights"]])
    products = F.zip_with(vector_to_array(FEATURES), weights, lambda x, w: x * w)
    return df.withColumn(out, sigmoid(F.aggregate(products, F.lit(model.numbers["intercept"]), lambda a, b: a + b)))


def adaboost(s: ModelSizes) -> Joint:
    """Boosted stumps with discrete weights (SAMME).

    A fitted stump is kept as numbers, so scoring is one expression over the vector, whatever the rounds.
    """

    def fit(data: trees.Training) -> dict[int, Fitted]:
        found = boosting.adaboost(data, s.adaboost_rounds, s.adaboost_rate)
        return {part: Fitted("adaboost", "adaboost", numbers={"stumps": stumps}) for part, stumps in found.items()}

    return Joint(fit)


def _score_adaboost(model: Fitted, df: DataFrame, out: str) -> DataFrame:
    stumps = model.numbers["stumps"]

    @F.pandas_udf(T.DoubleType())
    def told(v: pd.Series) -> pd.Series:
        x, margin = np.stack([np.asarray(row, dtype=np.float64) for row in v]), np.zeros(len(v))
        for t in stumps:
            says = np.where(x[:, t["feature"]] <= t["threshold"], t["low"], t["high"])
            margin += np.where(says == 1, t["alpha"], -t["alpha"])
        return pd.Series(1 / (1 + np.exp(-margin / sum(t["alpha"] for t in stumps))))

    return df.withColumn(out, told(vector_to_array(FEATURES)))


def svc(s: ModelSizes) -> Joint:
    """RBF support vectors on the span of landmarks, with a calibrated probability."""

    def fit(data: trees.Training) -> dict[int, Fitted]:
        spec = kernel.KernelSpec(cost=s.svc_c, landmarks=s.svc_landmarks, rounds=s.svc_rounds, seed=s.seed)
        return {part: Fitted("svc", "svc", numbers=numbers) for part, numbers in kernel.support_vectors(data, spec).items()}

    return Joint(fit)


def _score_svc(model: Fitted, df: DataFrame, out: str) -> DataFrame:
    numbers, (slope, offset) = model.numbers, model.numbers["curve"]

    @F.pandas_udf(T.DoubleType())
    def told(v: pd.Series) -> pd.Series:
        margin = kernel.margins_of(numbers, np.stack([np.asarray(row, dtype=np.float64) for row in v]))
        return pd.Series(1 / (1 + np.exp(slope * margin + offset)))

    return df.withColumn(out, told(vector_to_array(FEATURES)))


def knn(s: ModelSizes, key: str = "row_key") -> Callable[[DataFrame], Fitted]:
    """Distance-weighted nearest neighbours; "fitting" keeps the training rows."""

    def fit(train: DataFrame) -> Fitted:
        corpus = train.select(F.col(key).alias("t_key"), vector_to_array(FEATURES).alias("x"), TARGET)

        return Fitted("knn", "knn", numbers={"k": s.neighbors, "key": key}, rows=corpus)

    return fit


def _score_knn(model: Fitted, df: DataFrame, out: str) -> DataFrame:
    key = model.numbers["key"]
    asked = df.select(F.col(key).alias("q_key"), vector_to_array(FEATURES).alias("x"))
    near = nearest_neighbors(asked, model.rows, model.numbers["k"], query_id="q_key", corpus_id="t_key", vector="x")
    votes = distance_vote(near, model.rows, "t_key", TARGET).select(F.col("query_id").alias(key), F.col("disease_probability").alias(out))
    return df.join(votes, key, "left")


class Voting:
    """Mean of the members' probabilities, computed in one pass over the rows."""

    def __init__(self, members: Sequence[Callable[[DataFrame], Fitted]]):
        self.members = list(members)

    def __call__(self, train: DataFrame) -> Fitted:
        return self.of([member(train) for member in self.members])

    @staticmethod
    def of(fitted: Sequence[Fitted]) -> Fitted:
        return Fitted("voting_ensemble", "voting", members=list(fitted))


def _score_voting(model: Fitted, df: DataFrame, out: str) -> DataFrame:
    scored, names = df, []
    for n, member in enumerate(model.members):
        names.append(f"__p{n}")
        scored = member.score(scored, names[-1])
    return scored.select(*df.columns, soft_vote([F.col(n) for n in names]).alias(out))


SCORE_BY_FAMILY = {"stage": _score_stage, "trees": _score_trees, "adaboost": _score_adaboost, "svc": _score_svc, "linear": _score_linear, "knn": _score_knn, "voting": _score_voting}


def model_families(s: ModelSizes = ModelSizes()) -> dict[str, Callable[[DataFrame], Fitted]]:
    """Name to fitting function, in training order."""
    members = [extra_trees(s), random_forest(s), gradient_boosting(s), svc(s), logistic(s)]
    return {
        "extra_trees": members[0],
        "random_forest": members[1],
        "gradient_boosting": members[2],
        "adaboost": adaboost(s),
        "bagging": bagging(s),
        "svc": members[3],
        "logistic": members[4],
        "knn": knn(s),
        "decision_tree": decision_tree(s),
        "sgd": sgd(s),
        "voting_ensemble": Voting(members),
    }


# -- preparation, evaluation --------------------------------------------------


@dataclass(frozen=True)
class Scaling:
    """Population mean and spread per position, learnt from training rows only."""

    mean: list[float]
    spread: list[float]

    def apply(self, df: DataFrame, vector: str) -> DataFrame:
        mean = F.array(*[F.lit(m) for m in self.mean])
        spread = F.array(*[F.lit(s) for s in self.spread])
        centred = F.zip_with(vector, mean, lambda x, m: x - m)
        return df.withColumn(vector, F.zip_with(centred, spread, lambda x, s: x / s))


def learn_scaling(df: DataFrame, vector: str, unscaled: int = 0) -> Scaling:
    """One aggregate row per vector position comes back, never the rows.

    The last ``unscaled`` positions (category flags) keep their values.
    """
    _, mean, variance = _moments(df, array_to_vector(vector))
    scaled = len(mean) - unscaled
    return Scaling(
        [float(m) if at < scaled else 0.0 for at, m in enumerate(mean)],
        [(math.sqrt(v) or 1.0) if at < scaled else 1.0 for at, v in enumerate(variance)],
    )


def _moments(df: DataFrame, vector: Column) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, and mean and population variance of every position, in one pass over whole vectors."""
    row = df.select(Summarizer.metrics("count", "mean", "variance").summary(vector).alias("s")).first()["s"]
    n = row["count"]
    variance = np.maximum(row["variance"].toArray(), 0.0) * (n - 1) / n
    # A constant position: the sum of squares leaves rounding noise, not spread.
    return n, row["mean"].toArray(), np.where(variance < 1e-24, 0.0, variance)


#: Training rows a task is worth; solvers that read the rows many times are slow on many small tasks.
ROWS_PER_TASK = 20_000
#: Parts that are prepared, fitted or scored at the same time.
THREADS = 6


@dataclass(frozen=True)
class Part:
    """Training rows ready to fit, held-out rows on the same scale, and that scale."""

    train: DataFrame
    test: DataFrame
    scaling: Scaling


def as_features(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Add the row key and the ML vector the families read."""
    return df.withColumns({"row_key": F.col(key).cast("string"), FEATURES: array_to_vector(vector)})


def ready_part(rows: DataFrame, held_out: Column, key: str, target: str, vector: str, per_class: int, seed: int, unscaled: int = 0) -> Part:
    """Scale and balance with the training rows alone, then weight them.

    Held-out rows never reach the scaler or the balancer.
    """
    train, test = rows.where(~held_out), rows.where(held_out)
    scaling = learn_scaling(train, vector, unscaled)
    scaled = scaling.apply(train.select(key, target, vector), vector)
    full = balanced(scaled, key, target, vector, per_class=per_class, seed=seed)
    row_key = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("s"), F.xxhash64(vector).cast("string")))
    full = durable(full.select(row_key.alias("row_key"), F.col(target).cast("double").alias(TARGET), array_to_vector(vector).alias(FEATURES)))
    sizes = {r[TARGET]: r["count"] for r in full.groupBy(TARGET).count().collect()}  # a row per class
    weight = reduce(lambda w, c: w.when(F.col(TARGET) == c, sum(sizes.values()) / (len(sizes) * sizes[c])), sizes, F.when(F.lit(False), 0.0))
    weighted = full.withColumn(WEIGHT, weight).coalesce(max(1, sum(sizes.values()) // ROWS_PER_TASK))
    ready = as_features(scaling.apply(test, vector), key, vector).select("row_key", F.col(target).cast("double").alias(TARGET), FEATURES)
    return Part(weighted, ready, scaling)


def told_by(model: Fitted, rows: DataFrame) -> DataFrame:
    """(target, probability, verdict) of held-out rows."""
    return model.score(rows, "p").select(TARGET, "p", predicted(F.col("p")).alias("prediction"))


def metrics_of(scored: DataFrame, by: Sequence[str]) -> list[dict]:
    """Accuracy, precision, recall, F1 and AUC of each group of scored rows, all groups at once."""
    found = binary_metrics(scored, TARGET, "prediction", by).join(roc_auc(scored, TARGET, "p", by).select(*by, "auc"), list(by), "left")
    return [r.asDict() | {"roc_auc": r["auc"]} for r in found.collect()]


def _each(work: Callable, items: Sequence) -> list:
    """``work`` of every item, a few at a time; Spark runs their jobs side by side."""
    with ThreadPool(THREADS) as pool:
        return pool.map(work, items, chunksize=1)


def fit_parts(families: Mapping[str, Callable[[DataFrame], Fitted]], parts: Sequence[Part], errors: dict[str, str]) -> dict[str, list[Fitted]]:
    """Every family fitted on every part: tree families for all parts at once, others part by part side by side.

    An ensemble takes over its members' fits. A family that fails is named in ``errors`` and has no fits.
    """
    data = trees.training([p.train for p in parts], FEATURES, TARGET) if any(isinstance(f, Joint) for f in families.values()) else None
    names = {id(f): name for name, f in families.items()}
    fitted: dict[str, list[Fitted]] = {}

    def fit(name):
        family = families[name]
        try:
            members = [names.get(id(m)) for m in family.members] if isinstance(family, Voting) else [None]
            if all(m in fitted for m in members):
                fitted[name] = [Voting.of([fitted[m][at] for m in members]) for at in range(len(parts))]
            elif isinstance(family, Joint):
                found = family.fit(data)
                fitted[name] = [found[at] for at in range(len(parts))]
            else:
                fitted[name] = _each(lambda part: family(part.train), parts)
        except Exception as exc:  # one failing family must not lose the others
            errors[name] = str(exc)

    ensembles = [name for name, f in families.items() if isinstance(f, Voting)]
    _each(fit, [name for name in families if name not in ensembles])
    _each(fit, ensembles)
    return fitted


REPORT_SCHEMA = """model STRING, path STRING, accuracy DOUBLE, test_accuracy DOUBLE, cv_accuracy DOUBLE, f1_score DOUBLE,
    sensitivity_recall DOUBLE, precision DOUBLE, roc_auc DOUBLE, error STRING"""


def cross_validate(
    rows: DataFrame, fit: Callable[[DataFrame], Fitted], key: str, target: str, vector: str, folds: int, per_class: int,
    seed: int, unscaled: int = 0, order_by: list[str] | None = None,
) -> list[float]:
    """Held-out accuracy per fold; scaling and balancing are redone inside each."""
    parts = fold_parts(rows, key, target, vector, folds, per_class, seed, unscaled, order_by)
    errors: dict[str, str] = {}
    fitted = fit_parts({"model": fit}, parts, errors)
    if errors:
        raise ValueError(errors["model"])
    scored = _scored(fitted["model"], parts, "model")
    found = {m["part"]: m["accuracy"] for m in metrics_of(scored, ["part"])}
    return [found[at] for at in range(folds)]


def _scored(fitted: Sequence[Fitted], parts: Sequence[Part], name: str) -> DataFrame:
    """Held-out rows of all parts as one model family sees them, written once."""
    told = [told_by(model, part.test).select(F.lit(name).alias("model"), F.lit(at).alias("part"), "*") for at, (model, part) in enumerate(zip(fitted, parts))]
    return durable(reduce(DataFrame.unionAll, told))


def fold_parts(
    rows: DataFrame, key: str, target: str, vector: str, folds: int, per_class: int, seed: int, unscaled: int = 0,
    order_by: list[str] | None = None,
) -> list[Part]:
    numbered = durable(stratified_folds(rows.select(key, target, vector), key, target, folds, seed, order_by))
    return _each(lambda f: ready_part(numbered, F.col("fold") == f, key, target, vector, per_class, seed, unscaled), range(folds))


def train_and_evaluate(
    rows: DataFrame,
    families: Mapping[str, Callable[[DataFrame], Fitted]],
    *,
    key: str,
    target: str,
    vector: str,
    folds: int = 5,
    per_class: int = 120,
    seed: int = 42,
    unscaled: int = 0,
    model_folder: str | None = None,
) -> DataFrame:
    """Leaderboard of all families; a family that fails has no accuracy and an error text.

    Split and folds come first and are prepared once. Tree families grow on all of them at once, the others side by
    side. All scored rows meet in one table, from which all metrics come. With a ``model_folder`` the models of the
    hold-out's training rows are stored there.
    """
    rows = durable(rows.select(key, target, vector))

    def hold_out():
        return [ready_part(durable(stratified_split(rows, key, target, seed=seed)), F.col("is_test"), key, target, vector, per_class, seed, unscaled)]

    def folded():
        return fold_parts(rows, key, target, vector, folds, per_class, seed, unscaled) if folds else []

    (hold,), others = _each(lambda prepare: prepare(), [hold_out, folded])
    parts = [hold, *others]
    errors: dict[str, str] = {}
    fitted = fit_parts(families, parts, errors)
    paths: dict[str, str | None] = dict.fromkeys(families)

    def score(name):
        try:
            scored = _scored(fitted[name], parts, name)
            if model_folder:
                paths[name] = f"{model_folder.rstrip('/')}/{name}"
                save_fitted(fitted[name][0], paths[name], hold.scaling)
            return scored
        except Exception as exc:  # as above
            errors[name] = str(exc)
            return None

    scored = [table for table in _each(score, list(fitted)) if table is not None]
    found: dict[tuple[str, int], dict] = {}
    if scored:
        found = {(m["model"], m["part"]): m for m in metrics_of(reduce(DataFrame.unionAll, scored), ["model", "part"])}
    report = []
    for name in families:
        if name in errors or (name, 0) not in found:
            report.append((name, None, *[None] * 7, errors.get(name, "no held-out rows")))
            continue
        test, checks = found[name, 0], [found[name, at] for at in range(1, len(parts)) if (name, at) in found]
        cv = float(np.mean([m["accuracy"] for m in checks])) if checks else None
        blended = round(test["accuracy"] * 0.5 + cv * 0.5, 4) if cv is not None else round(test["accuracy"], 4)
        numbers = [blended, test["accuracy"], cv, test["f1_score"], test["recall"], test["precision"], test["roc_auc"]]
        report.append((name, paths[name], *[None if v is None else round(float(v), 4) for v in numbers], None))
    return rows.sparkSession.createDataFrame(report, REPORT_SCHEMA)


# -- persistence, importance --------------------------------------------------


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_compatible(spark: SparkSession, path: str, width: int) -> PipelineModel:
    """A stored pipeline, refused when its classifier expects another width."""
    model = PipelineModel.load(path)
    expected = model.stages[-1].numFeatures
    if expected != width:
        raise ValueError(f"model at {path} expects {expected} features, not {width}")
    return model


def save_fitted(model: Fitted, path: str, scaling: Scaling | None = None) -> None:
    """Store a model of any family, with the scaling it was trained under."""
    about = {
        "name": model.name, "family": model.family, "numbers": model.numbers, "n_members": len(model.members),
        "has_stages": bool(model.stages), "has_rows": model.rows is not None,
        "scaling": {"mean": scaling.mean, "spread": scaling.spread} if scaling else None,
    }
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(about),)], "value STRING").coalesce(1).write.mode("overwrite").text(f"{path}/about")
    if model.stages:
        save_model(PipelineModel(model.stages), f"{path}/stages")
    if model.rows is not None:
        model.rows.write.mode("overwrite").parquet(f"{path}/rows")
    for n, member in enumerate(model.members):
        save_fitted(member, f"{path}/member_{n}")


def load_fitted(spark: SparkSession, path: str) -> tuple[Fitted, Scaling | None]:
    """The stored model and its scaling."""
    about = json.loads(spark.read.text(f"{path}/about").first()["value"])
    model = Fitted(
        about["name"], about["family"],
        PipelineModel.load(f"{path}/stages").stages if about["has_stages"] else [],
        about["numbers"],
        spark.read.parquet(f"{path}/rows") if about["has_rows"] else None,
        [load_fitted(spark, f"{path}/member_{n}")[0] for n in range(about["n_members"])],
    )
    return model, Scaling(**about["scaling"]) if about["scaling"] else None


def compare_fitted(fitted: Sequence[Fitted], df: DataFrame, keep: Sequence[str], accuracies: Mapping[str, float] | None = None) -> DataFrame:
    """What every fitted model says about every row, in long form; no join over models."""
    scored = df
    for model in fitted:
        scored = model.score(scored, f"__p_{model.name}")
    probabilities = {m.name: F.col(f"__p_{m.name}") for m in fitted}
    return scored.select(*keep, F.inline(model_rows(probabilities, accuracies)))


def feature_importance(spark: SparkSession, model: Fitted, names: Sequence[str]) -> DataFrame:
    """(feature, importance) of a forest or tree, one row per feature."""
    values = list(zip(names, model.numbers["importance"]))
    return spark.createDataFrame(values, "feature STRING, importance DOUBLE")
