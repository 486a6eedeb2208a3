"""Model comparison, votes, metrics, neighbours and balancing."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tussis.functions import scoring as S
from tussis.operators import balance as B, balls, evaluate as E, neighbors as N, prepare as P
from tussis.plans.registry import query, spread_table, table
from tussis.plans.scorers import NAMES, SCORERS, sql_probability, sql_score


def vectors(spark, folder):
    return spread_table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label", (F.col("label") >= 5).cast("int").alias("target"))


def _probabilities():
    return {s.name: S.sigmoid(s.score(F.col("x"))) for s in SCORERS}


_ACCURACY = {"extra_trees": 0.8571, "svc": 0.9}
_LONG_SQL = "WITH long AS (" + " UNION ALL ".join(
    f"SELECT vec_id, label, '{n}' AS model, {sql_probability(m)} AS p, {_ACCURACY.get(n, 0.0)}::DOUBLE AS accuracy FROM embeddings" for m, n in enumerate(NAMES)
) + ")"


@query("sigmoid_score", f"SELECT vec_id, round({sql_score(1)}, 9) AS score, round({sql_probability(1)}, 9) AS probability FROM embeddings")
def sigmoid_score(spark, folder):
    v = vectors(spark, folder).select("vec_id", SCORERS[1].score(F.col("x")).alias("score"))
    return v.select("vec_id", F.round("score", 9).alias("score"), F.round(S.sigmoid(F.col("score")), 9).alias("probability"))


@query("model_probability", f"""WITH p AS (SELECT vec_id, {sql_probability(3)} AS p FROM embeddings)
    SELECT vec_id, CAST(p > 0.5 AS INTEGER) AS prediction, CAST(p >= 0.5 AS INTEGER) AS decision, round(greatest(p, 1 - p), 9) AS confidence, round(p, 9) AS disease_probability FROM p""")
def model_probability(spark, folder):
    p = F.col("p")
    v = vectors(spark, folder).select("vec_id", S.sigmoid(SCORERS[3].score(F.col("x"))).alias("p"))
    return v.select("vec_id", S.predicted(p).alias("prediction"), S.predicted(p, True).alias("decision"),
                    F.round(S.confidence(p), 9).alias("confidence"), F.round(p, 9).alias("disease_probability"))


def scored(spark, folder, *keep):
    return vectors(spark, folder).select(*keep, *[p.alias(n) for n, p in _probabilities().items()])


def comparison(spark, folder, *keep):
    return scored(spark, folder, *keep).select(*keep, F.inline(S.model_rows({n: F.col(n) for n in NAMES}, _ACCURACY)))


@query("compare_models", f"""{_LONG_SQL} SELECT vec_id, model, CASE WHEN p >= 0.5 THEN 'Disease' ELSE 'Healthy' END AS label, CAST(p >= 0.5 AS INTEGER) AS prediction,
    round(greatest(p, 1 - p), 9) AS confidence, round(p, 9) AS disease_probability, accuracy FROM long""")
def compare_models(spark, folder):
    return comparison(spark, folder, "vec_id").withColumns({c: F.round(c, 9) for c in ["confidence", "disease_probability"]})


@query("consensus_vote", f"""{_LONG_SQL}, v AS (SELECT vec_id, CAST(sum((p >= 0.5)::INTEGER) AS BIGINT) AS d, count(*) AS n FROM long WHERE model <> 'svc' GROUP BY vec_id)
    SELECT vec_id, n - d AS healthy_votes, d AS disease_votes, CASE WHEN d > n / 2.0 THEN 'Disease signal' ELSE 'Healthy signal' END AS consensus FROM v""")
def consensus_vote(spark, folder):
    """Four voters, so that ties occur."""
    votes = S.consensus([S.predicted(F.col(n), True) for n in NAMES if n != "svc"])
    return scored(spark, folder, "vec_id").select("vec_id", votes.alias("v")).select("vec_id", "v.*")


@query("soft_vote", f"""{_LONG_SQL}, v AS (SELECT vec_id, avg(p) AS p FROM long GROUP BY vec_id)
    SELECT vec_id, round(p, 9) AS disease_probability, CAST(p > 0.5 AS INTEGER) AS prediction FROM v""")
def soft_vote(spark, folder):
    v = vectors(spark, folder).select("vec_id", S.soft_vote(list(_probabilities().values())).alias("p"))
    return v.select("vec_id", F.round("p", 9).alias("disease_probability"), S.predicted(F.col("p")).alias("prediction"))


_METRIC_SQL = """round(CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn)::DOUBLE / (tp + fp + fn + tn) ELSE 0 END, 9) AS accuracy,
    round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END, 9) AS precision, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 9) AS recall,
    round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1_score"""


def _counts_sql(y: str, p: str) -> str:
    return ", ".join(f"count(*) FILTER ({y} = {a} AND {p} = {b}) AS {n}" for n, a, b in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0)))


def _rounded_metrics(df):
    return df.withColumns({c: F.round(c, 9) for c in ["accuracy", "precision", "recall", "f1_score"]})


@query("binary_metrics", f"""WITH r AS (SELECT lang, quality AS y, CASE lang WHEN 'en' THEN (n_chars > 1000)::INTEGER WHEN 'fr' THEN 0 ELSE (n_chars % 2)::INTEGER END AS p FROM documents JOIN labels USING (doc_id)),
    c AS (SELECT lang, {_counts_sql('y', 'p')} FROM r GROUP BY lang) SELECT lang, tp, fp, fn, tn, {_METRIC_SQL} FROM c""")
def binary_metrics(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "lang", "n_chars").join(table(spark, folder, "labels"), "doc_id")
    n = F.col("n_chars")
    rule = F.when(F.col("lang") == "en", (n > 1000).cast("int")).when(F.col("lang") == "fr", 0).otherwise((n % 2).cast("int"))
    return _rounded_metrics(E.binary_metrics(d.withColumn("p", rule), "quality", "p", ["lang"]))


@query("model_metrics", f"""{_LONG_SQL}, r AS (SELECT model, (label >= 5)::INTEGER AS y, (p >= 0.5)::INTEGER AS pred FROM long),
    c AS (SELECT model, {_counts_sql('y', 'pred')} FROM r GROUP BY model) SELECT model, tp, fp, fn, tn, {_METRIC_SQL} FROM c""")
def model_metrics(spark, folder):
    return _rounded_metrics(E.binary_metrics(comparison(spark, folder, "target"), "target", "prediction", ["model"]))


@query("roc_auc", f"""{_LONG_SQL}, s AS (SELECT model, (label >= 5)::INTEGER AS y, round(p, 2) AS p FROM long),
    r AS (SELECT model, y, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2.0::DOUBLE AS r FROM s),
    t AS (SELECT model, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg, sum(r) FILTER (y = 1) AS sr FROM r GROUP BY model)
    SELECT model, n_pos, n_neg, round((sr - n_pos * (n_pos + 1) / 2.0::DOUBLE) / (n_pos * n_neg), 9) AS auc FROM t""")
def roc_auc(spark, folder):
    """Scores are rounded so that ties occur."""
    v = vectors(spark, folder).select("target", *[p.alias(n) for n, p in _probabilities().items()])
    long = v.select("target", F.inline(F.array(*[F.struct(F.lit(n).alias("model"), F.round(n, 2).alias("p")) for n in NAMES])))
    return E.roc_auc(long, "target", "p", ["model"]).withColumn("auc", F.round("auc", 9))


_KNN_SQL = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)"""


_KNN_CLASS_SQL = f"""{_KNN_SQL}, d AS (SELECT a.label, a.vec_id AS query_id, b.vec_id AS neighbor_id, round(list_distance(a.x, b.x), 9) AS distance
      FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d)
    SELECT label, query_id, neighbor_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"""


@query("knn_within_class", _KNN_CLASS_SQL)
def knn_within_class(spark, folder):
    v = vectors(spark, folder)
    near = N.nearest_neighbors(v, v, 5, query_id="vec_id", corpus_id="vec_id", vector="x", by=["label"], exclude_same=True)
    return near.withColumn("distance", F.round("distance", 6))


@query("knn_pruned", _KNN_CLASS_SQL)
def knn_pruned(spark, folder):
    """The same neighbours, where balls of rows that can't hold any are left out before the join."""
    v = vectors(spark, folder)
    near, _ = balls.nearest_in_balls(v, v, 5, query_id="vec_id", corpus_id="vec_id", vector="x", by=["label"], exclude_same=True)
    return near.withColumn("distance", F.round("distance", 6))


@query("knn_classify", f"""{_KNN_SQL}, d AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, (b.label >= 5)::INTEGER AS y, round(list_distance(a.x, b.x), 9) AS distance
      FROM e a JOIN e b ON a.vec_id % 2 = 1 AND b.vec_id % 2 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d),
    v AS (SELECT query_id, sum(y / distance) / sum(1 / distance) AS p FROM r WHERE rank <= 5 GROUP BY query_id)
    SELECT query_id, round(p, 6) AS disease_probability, CAST(p > 0.5 AS INTEGER) AS prediction FROM v""")
def knn_classify(spark, folder):
    v = vectors(spark, folder)
    train, rows = v.where("vec_id % 2 = 0"), v.where("vec_id % 2 = 1")
    near = N.nearest_neighbors(rows, train, 5, query_id="vec_id", corpus_id="vec_id", vector="x")
    p = F.col("disease_probability")
    return N.distance_vote(near, train, "vec_id", "target").select("query_id", F.round(p, 6).alias("disease_probability"), S.predicted(p).alias("prediction"))


_PER_CLASS = 55


@query("smote_counts", f"""WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
    SELECT label, n AS n_original, greatest({_PER_CLASS} - n, 0) AS n_synthetic, greatest(n, {_PER_CLASS}) AS n_total FROM c""")
def smote_counts(spark, folder):
    rows = B.balanced(vectors(spark, folder), "vec_id", "label", "x", per_class=_PER_CLASS)
    return rows.groupBy("label").agg(
        F.count_if(~F.col("synthetic")).alias("n_original"), F.count_if("synthetic").alias("n_synthetic"), F.count("*").alias("n_total")
    )


@query("union_balanced", f"""WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
    SELECT 64 AS width, false AS synthetic, count(*) AS n, count(vec_id) AS n_keyed FROM embeddings
    UNION ALL SELECT 64, true, CAST(sum(greatest({_PER_CLASS} - n, 0)) AS BIGINT), CAST(0 AS BIGINT) FROM c HAVING sum(greatest({_PER_CLASS} - n, 0)) > 0""")
def union_balanced(spark, folder):
    rows = B.balanced(vectors(spark, folder), "vec_id", "label", "x", per_class=_PER_CLASS)
    return rows.groupBy(F.size("x").alias("width"), "synthetic").agg(F.count("*").alias("n"), F.count("vec_id").alias("n_keyed"))


def _u(parts: str) -> str:
    return f"(('0x' || substr(sha256('42|' || {parts}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


@query("smote_balance", f"""{_KNN_SQL}, n AS (SELECT label, count(*) AS n FROM e GROUP BY label),
    d AS (SELECT label, n, unnest(range(1, {_PER_CLASS} - n + 1)) AS draw FROM n WHERE n < {_PER_CLASS}),
    num AS (SELECT label, vec_id, x, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS at FROM e),
    b AS (SELECT d.label, d.draw, d.n, num.vec_id AS base_id, num.x AS base, 1 + floor({_u("d.label || '|' || d.draw || '|neighbor'")} * least(5, d.n - 1)) AS rank,
      0.15::DOUBLE + 0.7::DOUBLE * {_u("d.label || '|' || d.draw || '|blend'")} AS blend
      FROM d JOIN num ON num.label = d.label AND num.at = 1 + floor({_u("d.label || '|' || d.draw || '|base'")} * d.n)),
    nd AS (SELECT a.vec_id AS base_id, c.vec_id AS neighbor_id, c.x AS neighbor, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.x, c.x), 9), c.vec_id) AS rank
      FROM e a JOIN e c ON a.label = c.label AND a.vec_id <> c.vec_id),
    m AS (SELECT label, draw, base_id, neighbor_id, blend, unnest(base) AS p, unnest(neighbor) AS q, unnest(range(64)) AS j FROM b JOIN nd USING (base_id, rank))
    SELECT label, draw, base_id, neighbor_id, CAST(j AS INTEGER) AS j, round(p + blend * (q - p) + 0.015::DOUBLE * sqrt(-2 * ln(1 - {_u("label || '|' || draw || '|' || j || '|radius'")}))
      * cos(2 * pi() * {_u("label || '|' || draw || '|' || j || '|angle'")}), 6) AS v FROM m""")
def smote_balance(spark, folder):
    """Every coordinate of every synthetic row, drawn with the portable digest."""
    rows = B.synthesize(vectors(spark, folder), "vec_id", "label", "x", per_class=_PER_CLASS, draw=B.digest_uniform)
    cells = rows.select(F.col("class").alias("label"), "draw", "base_id", "neighbor_id", F.posexplode("vector").alias("j", "v"))
    return cells.withColumn("v", F.round("v", 6))


@query("stratified_folds", """WITH r AS (SELECT vec_id, (label >= 5)::INTEGER AS target, row_number() OVER (PARTITION BY label >= 5 ORDER BY vec_id) AS n FROM embeddings)
    SELECT vec_id, target, CAST((n - 1) % 5 AS INTEGER) AS fold FROM r""")
def stratified_folds(spark, folder):
    return B.stratified_folds(vectors(spark, folder).select("vec_id", "target"), "vec_id", "target", order_by=["vec_id"])


@query("stratified_split", """WITH r AS (SELECT vec_id, (label >= 5)::INTEGER AS target, row_number() OVER (PARTITION BY label >= 5 ORDER BY vec_id) AS n, count(*) OVER (PARTITION BY label >= 5) AS c FROM embeddings)
    SELECT vec_id, target, n <= round(c * 0.2::DOUBLE) AS is_test FROM r""")
def stratified_split(spark, folder):
    return B.stratified_split(vectors(spark, folder).select("vec_id", "target"), "vec_id", "target", order_by=["vec_id"])


@query("class_weights", """SELECT doc_id, quality, round((SELECT count(*) FROM labels)::DOUBLE / ((SELECT count(DISTINCT quality) FROM labels) * count(*) OVER (PARTITION BY quality)), 9) AS weight FROM labels""")
def class_weights(spark, folder):
    return B.class_weights(table(spark, folder, "labels").select("doc_id", "quality"), "quality").select("doc_id", "quality", F.round("weight", 9).alias("weight"))


@query("standardize", """WITH m AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, 7.0::DOUBLE AS flat FROM lineitem),
    s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS me, stddev_pop(l_extendedprice) AS se FROM m)
    SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 6) AS l_quantity, round((l_extendedprice - me) / se, 6) AS l_extendedprice, 0.0::DOUBLE AS flat FROM m, s""")
def standardize(spark, folder):
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", F.lit(7.0).alias("flat"))
    out = P.standardize(li, ["l_quantity", "l_extendedprice", "flat"])
    return out.withColumns({c: F.round(c, 6) for c in ["l_quantity", "l_extendedprice"]})


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("one_hot", "SELECT c_custkey, " + ", ".join(f"(c_mktsegment = '{s}')::INTEGER::DOUBLE AS \"c_mktsegment_{s}\"" for s in _SEGMENTS) + " FROM customer")
def one_hot(spark, folder):
    c = P.one_hot(table(spark, folder, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")
    return c.drop("c_mktsegment")


@query("preprocess_vector", "WITH s AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS d, avg(c_nationkey) AS nm, stddev_pop(c_nationkey) AS nd FROM customer) SELECT c_custkey, 7 AS width, round((c_acctbal - m) / d, 6) AS v0, round((c_nationkey - nm) / nd, 6) AS v1, "
       + ", ".join(f"(c_mktsegment = '{s}')::INTEGER::DOUBLE AS v{i + 2}" for i, s in enumerate(_SEGMENTS)) + " FROM customer, s")
def preprocess_vector(spark, folder):
    c = table(spark, folder, "customer")
    fitted = P.preprocessor(["c_acctbal", "c_nationkey"], ["c_mktsegment"], c.count()).fit(c)
    a = fitted.transform(c).select("c_custkey", vector_to_array("features").alias("v"))
    return a.select("c_custkey", F.size("v").alias("width"), *[F.round(F.get("v", F.lit(i)), 6).alias(f"v{i}") for i in range(7)])
