"""Fitted models at their published sizes, on data whose verdicts follow from the labels."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tussis.functions import rules
from tussis.functions.clinical_terms import DEFAULT_TERMS
from tussis.functions.scoring import predicted
from tussis.operators import boosting, models as M, trees
from tussis.operators.profile import top_features
from tussis.plans.model_plans import vectors
from tussis.plans.registry import query, sql_list
from tussis.plans.sql_rules import sql_fused
from tussis.plans.stand_ins import note_of, note_sql
from tussis.session import scratch_path

_SIZES = M.ModelSizes()
_FAMILIES = M.model_families(_SIZES)


def _rows(spark, folder):
    return vectors(spark, folder).select("vec_id", "target", "x")


def _apart(spark, folder):
    """Vectors whose classes lie apart in every position, so that each family's verdict is known beforehand."""
    shifted = F.transform("x", lambda v: v * 0.1 + (2 * F.col("target") - 1))
    return _rows(spark, folder).withColumn("x", shifted)


def _held_out(rows, per_class=260):
    """Every fifth row is held out; scaling and balancing see the rest only."""
    return M.ready_part(rows, F.col("vec_id") % 5 == 0, "vec_id", "target", "x", per_class, 42)


_LABELS_SQL = "SELECT CAST(vec_id AS VARCHAR) AS vec_id, (label >= 5)::INTEGER AS target, vec_id AS n FROM embeddings"
_TOLD_SQL = f"SELECT vec_id, target, target AS prediction FROM ({_LABELS_SQL}) WHERE n % 5 = 0"
_SURE_SQL = f"SELECT vec_id, target, target::DOUBLE AS disease_probability, target AS prediction FROM ({_LABELS_SQL}) WHERE n % 5 = 0"


def _register(name: str, family: str, sql: str, rows=_apart, per_class: int = 260, probability: bool = True):
    @query(name, sql)
    def run(spark, folder):
        part = _held_out(rows(spark, folder), per_class)
        model = _FAMILIES[family](part.train)
        scored = model.score(part.test, "p")
        sure = [F.round("p", 6).alias("disease_probability")] if probability else []
        return scored.select(F.col("row_key").alias("vec_id"), F.col("target").cast("int").alias("target"), *sure, predicted(F.col("p")).alias("prediction"))

    return run


# Every tree parts the classes at its root, so its leaves are pure and the share of class 1 is exactly 0 or 1.
for _name, _family in {"fit_random_forest": "random_forest", "fit_extra_trees": "extra_trees", "fit_bagging": "bagging", "fit_tree": "decision_tree"}.items():
    _register(_name, _family, _SURE_SQL)
# The others' probabilities depend on how far a solver or a sum of rounds went; the verdict doesn't.
for _name, _family in {
    "fit_gbt": "gradient_boosting", "fit_adaboost": "adaboost", "fit_svc": "svc", "fit_logistic": "logistic", "fit_sgd": "sgd", "fit_voting": "voting_ensemble",
}.items():
    _register(_name, _family, _TOLD_SQL, probability=False)

# Without synthetic rows the neighbour vote on scaled features has an exact twin.
_register("fit_knn", "knn", rows=_rows, per_class=0, sql="""WITH c AS (SELECT vec_id, (label >= 5)::INTEGER AS target, unnest(range(64)) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings),
    m AS (SELECT j, avg(v) AS mean, stddev_pop(v) AS spread FROM c WHERE vec_id % 5 <> 0 GROUP BY j),
    z AS (SELECT vec_id, target, list((v - mean) / spread ORDER BY j) AS x FROM c JOIN m USING (j) GROUP BY vec_id, target),
    d AS (SELECT q.vec_id, q.target, t.vec_id AS other, t.target AS y, round(list_distance(q.x, t.x), 9) AS d FROM z q JOIN z t ON q.vec_id % 5 = 0 AND t.vec_id % 5 <> 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, CAST(other AS VARCHAR)) AS n FROM d),
    p AS (SELECT vec_id, target, sum(y / d) / sum(1 / d) AS p FROM r WHERE n <= 5 GROUP BY vec_id, target)
    SELECT CAST(vec_id AS VARCHAR) AS vec_id, target, round(p, 6) AS disease_probability, CAST(p > 0.5 AS INTEGER) AS prediction FROM p""")


@query("compare_fitted", f"""SELECT vec_id AS row_key, model, CASE target WHEN 1 THEN 'Disease' ELSE 'Healthy' END AS label, target AS prediction,
      CASE model WHEN 'random_forest' THEN 0.7857::DOUBLE ELSE 0.0::DOUBLE END AS accuracy
    FROM ({_LABELS_SQL}), (SELECT unnest({sql_list(_FAMILIES)}) AS model) WHERE n % 5 = 0""")
def compare_fitted(spark, folder):
    """All families side by side on the held-out rows."""
    part = _held_out(_apart(spark, folder))
    errors: dict[str, str] = {}
    fitted = M.fit_parts(_FAMILIES, [part], errors)
    if errors:
        raise ValueError("; ".join(f"{name}: {error}" for name, error in errors.items()))
    return M.compare_fitted([replace(fitted[name][0], name=name) for name in _FAMILIES], part.test, ["row_key"], {"random_forest": 0.7857}).select("row_key", "model", "label", "prediction", "accuracy")


@query("cv_accuracy", """WITH e AS (SELECT vec_id, (label >= 5)::INTEGER AS target, (row_number() OVER (PARTITION BY label >= 5 ORDER BY vec_id) - 1) % 5 AS fold, embedding FROM embeddings),
    c AS (SELECT vec_id, target, fold, unnest(range(64)) AS j, unnest(embedding)::DOUBLE AS v FROM e),
    m AS (SELECT f, j, avg(v) AS mean, stddev_pop(v) AS spread FROM c, range(5) AS g(f) WHERE fold <> f GROUP BY f, j),
    z AS (SELECT f, vec_id, target, fold, list((v - mean) / spread ORDER BY j) AS x FROM c JOIN m USING (j) GROUP BY f, vec_id, target, fold),
    d AS (SELECT q.f, q.vec_id, q.target, t.vec_id AS other, t.target AS y, round(list_distance(q.x, t.x), 9) AS d FROM z q JOIN z t ON q.f = t.f AND q.fold = q.f AND t.fold <> t.f),
    r AS (SELECT *, row_number() OVER (PARTITION BY f, vec_id ORDER BY d, CAST(other AS VARCHAR)) AS n FROM d),
    p AS (SELECT f, vec_id, target, sum(y / d) / sum(1 / d) AS p FROM r WHERE n <= 5 GROUP BY f, vec_id, target)
    SELECT CAST(f AS INTEGER) AS fold, round(avg(((p > 0.5)::INTEGER = target)::INTEGER), 9) AS accuracy FROM p GROUP BY f""")
def cv_accuracy(spark, folder):
    """Held-out accuracy per fold of the neighbour vote, scaled inside each fold."""
    scores = M.cross_validate(_rows(spark, folder), _FAMILIES["knn"], "vec_id", "target", "x", 5, 0, 42, order_by=["vec_id"])
    return spark.createDataFrame([(i, round(s, 9)) for i, s in enumerate(scores)], "fold INT, accuracy DOUBLE")


_SCORES = ["accuracy", "test_accuracy", "cv_accuracy", "f1_score", "sensitivity_recall", "precision", "roc_auc"]


@query("train_leaderboard", f"SELECT unnest({sql_list(_FAMILIES)}) AS model, " + ", ".join(f"1.0::DOUBLE AS {c}" for c in _SCORES) + ", CAST(NULL AS VARCHAR) AS error")
def train_leaderboard(spark, folder):
    """All families at their published sizes, on a hold-out and five folds."""
    board = M.train_and_evaluate(_apart(spark, folder), _FAMILIES, key="vec_id", target="target", vector="x", folds=5, per_class=260)
    return board.select("model", *_SCORES, "error")


# Eight positions cut to whole steps: classes overlap, and every cut point lies between two of a few values.
_STEPS = 8


def _stepped(spark, folder):
    """Training rows of whole steps, as one part."""
    rows = _rows(spark, folder).select(
        F.col("vec_id").cast("string").alias("row_key"), "target", array_to_vector(F.transform(F.slice("x", 1, _STEPS), lambda v: F.floor(v * 16).cast("double"))).alias("features"))
    return trees.training([rows])


_CELLS_SQL = f"""cells AS (SELECT vec_id, (label >= 5)::INTEGER AS y, unnest(range({_STEPS})) AS j, floor(unnest(embedding[1:{_STEPS}])::DOUBLE * 16) AS v FROM embeddings)"""


def _cut_sql(name: str, rows: str, scale: str = "1") -> str:
    """CTEs for the best cut of weighted cells (j, v, y, w): {name} has j, cut, sides and weights; {name} has one row."""
    return f"""{name}_sums AS (SELECT j, v, sum(CASE WHEN y = 0 THEN w ELSE 0 END) AS a, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS b FROM {rows} GROUP BY j, v),
    {name}_cuts AS (SELECT j, v, lead(v) OVER o AS nv, sum(a) OVER o AS la, sum(b) OVER o AS lb, sum(a) OVER (PARTITION BY j) AS ta, sum(b) OVER (PARTITION BY j) AS tb FROM {name}_sums WINDOW o AS (PARTITION BY j ORDER BY v)),
    {name} AS (SELECT j, (v + nv) / 2 AS cut, la, lb, ta - la AS ra, tb - lb AS rb, ta, tb,
        ((la * la + lb * lb) / (la + lb) + ((ta - la) * (ta - la) + (tb - lb) * (tb - lb)) / (ta + tb - la - lb)) / ({scale}) AS pure FROM {name}_cuts WHERE nv IS NOT NULL AND ta > 0 AND tb > 0
        ORDER BY round(pure, 9) DESC, j, v LIMIT 1)"""


def _stump_sql(rounds: int, rate: float) -> str:
    steps, out = [_CELLS_SQL, "w0 AS (SELECT DISTINCT vec_id, y, 1.0::DOUBLE AS w FROM cells)"], []
    for r in range(rounds):
        steps.append(f"c{r} AS (SELECT cells.*, w FROM cells JOIN w{r} USING (vec_id))")
        steps.append(_cut_sql(f"b{r}", f"c{r}", "ta + tb"))
        steps.append(f"""s{r} AS (SELECT *, (lb > la)::INTEGER AS low, (rb > ra)::INTEGER AS high,
            ((CASE WHEN lb > la THEN la ELSE lb END) + (CASE WHEN rb > ra THEN ra ELSE rb END)) / (ta + tb) AS error FROM b{r})""")
        steps.append(f"""w{r + 1} AS (SELECT w{r}.vec_id, w{r}.y, w * CASE WHEN (CASE WHEN v <= cut THEN low ELSE high END) <> w{r}.y THEN pow((1 - error) / error, {rate}) ELSE 1 END AS w
            FROM w{r} JOIN cells USING (vec_id) JOIN s{r} USING (j))""")
        out.append(f"SELECT {r + 1} AS round, CAST(j AS INTEGER) AS feature, cut AS threshold, low, high, round(error, 9) AS error, round({rate} * ln((1 - error) / error), 9) AS alpha FROM s{r}")
    return f"WITH {', '.join(steps)} {' UNION ALL '.join(out)}"


@query("adaboost_rounds", _stump_sql(3, _SIZES.adaboost_rate))
def adaboost_rounds(spark, folder):
    """The first three boosted stumps on overlapping classes, each from one scan of all rows."""
    found = boosting.adaboost(_stepped(spark, folder), 3, _SIZES.adaboost_rate, small=0)[0]
    rows = [(i, s["feature"], s["threshold"], s["low"], s["high"], round(s["error"], 9), round(s["alpha"], 9)) for i, s in enumerate(found, 1)]
    return spark.createDataFrame(rows, "round INT, feature INT, threshold DOUBLE, low INT, high INT, error DOUBLE, alpha DOUBLE")


def _tree_sql(depth: int) -> str:
    """Nodes of a class-weighted tree, by one group-by a node."""
    steps = [_CELLS_SQL, """n AS (SELECT count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1 FROM cells WHERE j = 0)""",
             "r1 AS (SELECT cells.*, CASE WHEN y = 0 THEN (n0 + n1) / (2.0::DOUBLE * n0) ELSE (n0 + n1) / (2.0::DOUBLE * n1) END AS w FROM cells, n)"]
    out = []
    for node in range(1, 2 ** (depth + 1)):
        inner = node < 2**depth
        if inner:
            steps.append(_cut_sql(f"t{node}", f"r{node}"))
            for child, sign in ((2 * node, "<="), (2 * node + 1, ">")):
                steps.append(f"k{child} AS (SELECT vec_id FROM r{node} JOIN t{node} USING (j) WHERE v {sign} cut)")
                steps.append(f"r{child} AS (SELECT r{node}.* FROM r{node} JOIN k{child} USING (vec_id))")
        cut = f"coalesce((SELECT CAST(j AS INTEGER) FROM t{node}), -1), coalesce((SELECT cut FROM t{node}), 0.0::DOUBLE)" if inner else "-1, 0.0::DOUBLE"
        out.append(f"SELECT CAST({node} AS BIGINT) AS node, {cut}, count(*) FILTER (y = 0), count(*) FILTER (y = 1) FROM r{node} WHERE j = 0")
    return f"WITH {', '.join(steps)} SELECT * FROM ({' UNION ALL '.join(out)}) AS t(node, feature, threshold, n0, n1) WHERE n0 + n1 > 0"


@query("tree_nodes", _tree_sql(3))
def tree_nodes(spark, folder):
    """All nodes of a class-weighted tree of depth 3, grown level by level from histograms."""
    grown = trees.grow(_stepped(spark, folder), trees.TreeSpec(depth=3), small=0)[0][0]
    rows = [(node, *(grown.cuts[node][:2] if node in grown.cuts else (-1, 0.0)), *n) for node, n in sorted(grown.counts.items())]
    return spark.createDataFrame(rows, "node LONG, feature INT, threshold DOUBLE, n0 LONG, n1 LONG")


def _importance_sql(depth: int) -> str:
    """Share of each feature in the decrease of impurity of that tree."""
    steps = _tree_sql(depth).rsplit(" SELECT * FROM (", 1)[0]
    gains = " UNION ALL ".join(f"SELECT j, pure - (ta * ta + tb * tb) / (ta + tb) AS gain FROM t{node}" for node in range(1, 2**depth))
    return f"""{steps}, gains AS ({gains}) SELECT 'x' || f AS feature, round(coalesce(sum(gain), 0) / (SELECT sum(gain) FROM gains), 9) AS importance
        FROM range({_STEPS}) AS r(f) LEFT JOIN gains ON j = f GROUP BY f"""


@query("tree_importance", _importance_sql(3))
def tree_importance(spark, folder):
    """The importance of every feature of the tree of depth 3, those that are never cut included."""
    grown = trees.grow(_stepped(spark, folder), trees.TreeSpec(depth=3), small=0)[0]
    rows = [(f"x{j}", round(float(v), 9)) for j, v in enumerate(trees.importance(grown, _STEPS))]
    return spark.createDataFrame(rows, "feature STRING, importance DOUBLE")


_STEP, _MIX1, _MIX2, _WORD = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 2**64


def _mixed_sql(*parts: str) -> str:
    """The hash of the growers in 64-bit arithmetic."""
    state = "0::UBIGINT"
    for part in parts:
        state = f"CAST((xor({state}, CAST({part} AS UBIGINT))::UHUGEINT + {_STEP}::UHUGEINT) % {_WORD}::UHUGEINT AS UBIGINT)"
        for shift, factor in ((30, _MIX1), (27, _MIX2)):
            state = f"list_transform([{state}], lambda s: CAST((xor(s, s >> {shift})::UHUGEINT * {factor}::UHUGEINT) % {_WORD}::UHUGEINT AS UBIGINT))[1]"
        state = f"list_transform([{state}], lambda s: xor(s, s >> 31))[1]"
    return state


_EXTRA_SQL = f"""WITH cells AS (SELECT vec_id, (label >= 5)::INTEGER AS y, unnest(range(64)) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings),
    n AS (SELECT count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1 FROM cells WHERE j = 0),
    span AS (SELECT j, min(v) AS low, max(v) AS high FROM cells GROUP BY j),
    draws AS (SELECT t, j, low, high, {_mixed_sql("42", "2", "t", "1", "j")} AS h, {_mixed_sql("42", "3", "t", "1", "j")} AS u FROM span, range({_SIZES.forest_trees}) AS trees(t)),
    points AS (SELECT t, j, low + (u >> 11)::DOUBLE / 9007199254740992.0::DOUBLE * (high - low) AS cut FROM draws QUALIFY row_number() OVER (PARTITION BY t ORDER BY h, j) <= 8),
    sides AS (SELECT t, j, cut, n0, n1, count(*) FILTER (y = 0 AND v <= cut) AS l0, count(*) FILTER (y = 1 AND v <= cut) AS l1 FROM points JOIN cells USING (j), n GROUP BY ALL),
    w AS (SELECT *, l0 * (n0 + n1) / (2.0::DOUBLE * n0) AS a0, l1 * (n0 + n1) / (2.0::DOUBLE * n1) AS a1, (n0 + n1) / 2.0::DOUBLE AS half FROM sides),
    gains AS (SELECT *, (a0 * a0 + a1 * a1) / (a0 + a1) + ((half - a0) * (half - a0) + (half - a1) * (half - a1)) / (2 * half - a0 - a1) - half AS gain FROM w WHERE l0 + l1 > 0 AND l0 + l1 < n0 + n1)
    SELECT CAST(t AS INTEGER) AS tree, CAST(j AS INTEGER) AS feature, round(cut, 9) AS threshold, CAST(l0 AS BIGINT) AS left_0, CAST(l1 AS BIGINT) AS left_1
    FROM gains QUALIFY row_number() OVER (PARTITION BY t ORDER BY round(gain, 9) DESC, j) = 1"""


@query("extra_trees_roots", _EXTRA_SQL)
def extra_trees_roots(spark, folder):
    """The root cut of each extremely randomised tree: drawn features, random points, best of them."""
    rows = _rows(spark, folder).select(F.col("vec_id").cast("string").alias("row_key"), "target", array_to_vector("x").alias("features"))
    spec = trees.TreeSpec(_SIZES.forest_trees, 1, -1, random_cuts=True, min_split=_SIZES.min_split, seed=_SIZES.seed)
    grown = trees.grow(trees.training([rows]), spec, small=0)[0]
    found = [(i, t.cuts[1][0], round(t.cuts[1][1], 9), *t.counts[2]) for i, t in enumerate(grown)]
    return spark.createDataFrame(found, "tree INT, feature INT, threshold DOUBLE, left_0 LONG, left_1 LONG")


_NAMES = [f"x{i}" for i in range(64)]


def _wide(spark, folder):
    v = vectors(spark, folder)
    return v.select("vec_id", F.col("target").cast("double").alias("target"), *[F.get("x", F.lit(i)).alias(n) for i, n in enumerate(_NAMES)])


@query("feature_importance", "WITH c AS (SELECT unnest(range(64)) AS j, unnest(embedding)::DOUBLE * 0.1 + CASE WHEN unnest(range(64)) = 17 THEN (label >= 5)::INTEGER * 2 - 1 ELSE 0 END AS v, (label >= 5)::INTEGER AS t FROM embeddings)"
       " SELECT 'x' || j AS feature, 1 AS position FROM c GROUP BY j ORDER BY abs(corr(v, t)) DESC LIMIT 1")
def feature_importance(spark, folder):
    """The one position that parts the classes comes first among 64."""
    one = F.transform("x", lambda v, i: v * 0.1 + F.when(i == 17, 2 * F.col("target") - 1).otherwise(0))
    part = _held_out(_rows(spark, folder).withColumn("x", one))
    forest = M.random_forest(_SIZES)(part.train)
    return top_features(M.feature_importance(spark, forest, _NAMES), 1).select("feature", F.lit(1).alias("position"))


@query("model_roundtrip", "SELECT vec_id, true AS equal_to_fitted, 64 AS width FROM embeddings")
def model_roundtrip(spark, folder):
    """A fitted pipeline stored, loaded with its width checked, and used beside the one that was stored."""
    wide = _wide(spark, folder)
    classifier = LogisticRegression(labelCol="target", maxIter=_SIZES.logistic_iterations)
    fitted = Pipeline(stages=[VectorAssembler(inputCols=_NAMES, outputCol="features"), classifier]).fit(wide)
    path = scratch_path(spark, "model")
    M.save_model(fitted, path)
    loaded = M.load_compatible(spark, path, len(_NAMES))
    first = fitted.transform(wide).select("vec_id", *_NAMES, F.col("probability").alias("p"))
    both = loaded.transform(first)
    return both.select("vec_id", (vector_to_array("p") == vector_to_array("probability")).alias("equal_to_fitted"), F.lit(loaded.stages[-1].numFeatures).alias("width"))


_BATCH_SQL = f"""SELECT vec_id, (label >= 5)::INTEGER AS prediction, (label >= 5)::INTEGER::DOUBLE AS probability, {note_sql("vec_id")} AS notes,
    (vec_id % 5 = 0) AS respiratory_condition, (vec_id % 7 = 0) AS fever_muscle_pain, CAST(vec_id % 90 AS DOUBLE) AS age FROM embeddings"""


@query("score_batch", f"SELECT * EXCLUDE (confidence) FROM ({sql_fused(_BATCH_SQL, 'vec_id', DEFAULT_TERMS)})")
def score_batch(spark, folder):
    """Fitted model, then the text rules, for every recording."""
    rows = _apart(spark, folder)
    part = _held_out(rows)
    model = M.logistic(_SIZES)(part.train)
    everything = part.scaling.apply(rows, "x").select("vec_id", array_to_vector("x").alias("features"))
    i = F.col("vec_id")
    scored = model.score(everything, "probability").select(
        "vec_id", "probability", predicted(F.col("probability")).alias("prediction"), note_of(i).alias("notes"),
        (i % 5 == 0).alias("respiratory_condition"), (i % 7 == 0).alias("fever_muscle_pain"), (i % 90).cast("double").alias("age"),
    )
    return rules.fuse(scored, keep=["vec_id"]).drop("confidence").withColumn("symptoms_detected", F.array_join("symptoms_detected", "; "))
