"""Table profiles and leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from tussis.operators import leaderboard as B, profile as P
from tussis.plans.registry import query, table
from tussis.sources.sidecars import model_summary_rows as summary_rows


def _orders_with_gaps(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"),
        F.when(F.col("o_orderkey") % 11 == 0, float("nan")).when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("o_orderpriority"),
    )


_GAPS = """SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus,
    CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 THEN o_totalprice END AS o_totalprice, nullif(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority FROM orders"""
_GAP_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query("missingness", f"WITH g AS ({_GAPS}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count, round((count(*) - count({c}))::DOUBLE / count(*) * 100, 6) AS missing_pct FROM g" for c in _GAP_COLUMNS))
def missingness(spark, folder):
    return P.missingness(_orders_with_gaps(spark, folder)).withColumn("missing_pct", F.round("missing_pct", 6))


@query("completeness", f"""WITH g AS ({_GAPS}), t AS (SELECT count(*) * 5 AS cells, {' + '.join(f'(count(*) - count({c}))' for c in _GAP_COLUMNS)} AS missing FROM g)
    SELECT round((cells - missing)::DOUBLE / cells * 100, 6) AS complete_pct, round(missing::DOUBLE / cells * 100, 2) AS missing_pct FROM t""")
def completeness(spark, folder):
    return P.completeness(_orders_with_gaps(spark, folder)).withColumn("complete_pct", F.round("complete_pct", 6))


@query("value_counts", """WITH e AS (SELECT nullif(event_type, 'error') AS v FROM events), c AS (SELECT v AS value, count(*) AS n FROM e WHERE v IS NOT NULL GROUP BY 1)
    SELECT value, n, round(n::DOUBLE / (SELECT count(v) FROM e), 6) AS proportion FROM c""")
def value_counts(spark, folder):
    e = table(spark, folder, "events").select(F.nullif("event_type", F.lit("error")).alias("event_type"))
    return P.value_counts(e, "event_type").withColumn("proportion", F.round("proportion", 6))


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("crosstab", "SELECT o_orderstatus, " + ", ".join(f"""count(*) FILTER (o_orderpriority = '{p}') AS "{p}" """ for p in _PRIORITIES) + " FROM orders GROUP BY 1")
def crosstab(spark, folder):
    return P.crosstab(table(spark, folder, "orders"), "o_orderstatus", "o_orderpriority", _PRIORITIES)


_MEASURED = ["l_quantity", "l_extendedprice", "l_discount"]
# Some lines lack a quantity (NaN) or a price (null): missing, both.
_LINES = """(SELECT * REPLACE (CASE WHEN l_linenumber <> 5 THEN l_quantity END AS l_quantity,
    CASE WHEN l_suppkey % 7 <> 0 THEN l_extendedprice END AS l_extendedprice) FROM lineitem)"""


def _lines(spark, folder):
    return table(spark, folder, "lineitem").withColumns({
        "l_quantity": F.when(F.col("l_linenumber") == 5, float("nan")).otherwise(F.col("l_quantity")),
        "l_extendedprice": F.when(F.col("l_suppkey") % 7 != 0, F.col("l_extendedprice")),
    })


def _describe_sql(c: str, digits: int, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    q = ", ".join(f"round(quantile_cont({c}, {p}::DOUBLE), {digits}) AS q{int(p * 100)}" for p in (0.25, 0.5, 0.75))
    return (f"SELECT {keys}'{c}' AS column_name, count({c}) AS count, round(avg({c}), {digits}) AS mean, round(stddev_samp({c}), {digits}) AS std, "
            f"min({c}) AS min, {q}, max({c}) AS max FROM {_LINES}{group}")


def _rounded(df, digits):
    return df.withColumns({c: F.round(c, digits) for c in ["mean", "std", "q25", "q50", "q75"]})


@query("describe_numeric", " UNION ALL ".join(_describe_sql(c, 6) for c in _MEASURED))
def describe_numeric(spark, folder):
    return _rounded(P.describe(_lines(spark, folder), _MEASURED), 6)


@query("describe_by_group", " UNION ALL ".join(_describe_sql(c, 3, "l_returnflag") for c in _MEASURED))
def describe_by_group(spark, folder):
    return _rounded(P.describe(_lines(spark, folder), _MEASURED, ["l_returnflag"]), 3)


_WIDE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("corr_matrix", " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r FROM {_LINES}" for a in _WIDE for b in _WIDE))
def corr_matrix(spark, folder):
    return P.correlation_matrix(_lines(spark, folder), _WIDE).withColumn("r", F.round("r", 6))


_PAIRED = f"(SELECT *, l_extendedprice * (1 - l_discount) AS net, -l_extendedprice * (1 + l_tax) AS owed FROM {_LINES})"
_PAIR_COLUMNS = [*_WIDE, "net", "owed"]


@query("corr_embedding", """WITH c AS (SELECT vec_id, unnest(range(64)) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings),
    m AS (SELECT vec_id, j, CASE WHEN (vec_id + j) % 50 <> 0 THEN v END AS v FROM c)
    SELECT 'x' || a.j AS x, 'x' || b.j AS y, round(corr(a.v, b.v), 6) AS r FROM m a JOIN m b USING (vec_id) WHERE a.j < b.j GROUP BY a.j, b.j""")
def corr_embedding(spark, folder):
    """All 64 columns; every fiftieth cell is missing."""
    e = table(spark, folder, "embeddings")
    cells = {f"x{i}": F.when((F.col("vec_id") + i) % 50 != 0, F.get("embedding", F.lit(i))).otherwise(float("nan")) for i in range(64)}
    return P.correlations(e.select(*[c.alias(n) for n, c in cells.items()]), list(cells)).withColumn("r", F.round("r", 6))


@query("high_corr_pairs", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r FROM {_PAIRED}" for i, a in enumerate(_PAIR_COLUMNS) for b in _PAIR_COLUMNS[i + 1:]) + ") WHERE abs(r) > 0.5")
def high_corr_pairs(spark, folder):
    lines = _lines(spark, folder).withColumns({"net": F.col("l_extendedprice") * (1 - F.col("l_discount")), "owed": -F.col("l_extendedprice") * (1 + F.col("l_tax"))})
    return P.redundant_pairs(lines, _PAIR_COLUMNS, 0.5).withColumn("r", F.round("r", 6))


@query("quality_report", f"""WITH g AS ({_GAPS}), d AS (SELECT count(*) AS n FROM g GROUP BY o_custkey, o_orderstatus, o_orderpriority)
    SELECT count(*) AS total_records, count(*) FILTER (o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL) AS complete_cases,
      count(*) FILTER (o_orderstatus IS NULL OR o_orderpriority IS NULL OR o_totalprice IS NULL) AS records_with_missing, 5 AS total_features, 3 AS numeric_features,
      2 AS categorical_features, (SELECT CAST(sum(n - 1) AS BIGINT) FROM d) AS duplicate_rows FROM g""")
def quality_report(spark, folder):
    return P.quality_report(_orders_with_gaps(spark, folder), ["o_custkey", "o_orderstatus", "o_orderpriority"])


@query("duplicate_rows", "SELECT count(*) - count(DISTINCT text) AS duplicate_rows FROM documents")
def duplicate_rows(spark, folder):
    return P.duplicate_rows(table(spark, folder, "documents").select("text"))


@query("distinct_status", """SELECT 'event_type' AS column_name, count(DISTINCT event_type) AS n_distinct FROM events
    UNION ALL SELECT 'props', count(DISTINCT props) FROM events UNION ALL SELECT 'user_id', count(DISTINCT user_id) FROM events""")
def distinct_status(spark, folder):
    return P.distinct_counts(table(spark, folder, "events"), ["event_type", "props", "user_id"])


@query("histogram", """WITH l AS (SELECT CASE WHEN l_linenumber <> 5 THEN l_extendedprice END AS l_extendedprice FROM lineitem),
    r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM l),
    b AS (SELECT CAST(least(floor((l_extendedprice - lo) / (hi - lo) * 30), 29) AS INTEGER) AS bin, count(*) AS n FROM l, r WHERE l_extendedprice IS NOT NULL GROUP BY 1)
    SELECT CAST(i AS INTEGER) AS bin, round(lo + (hi - lo) * i / 30, 6) AS lower, round(lo + (hi - lo) * (i + 1) / 30, 6) AS upper, coalesce(n, 0) AS n
    FROM range(30) AS g(i) CROSS JOIN r LEFT JOIN b ON b.bin = i""")
def histogram(spark, folder):
    holes = F.when(F.col("l_linenumber") == 5, float("nan")).otherwise(F.col("l_extendedprice"))
    h = P.histogram(table(spark, folder, "lineitem").withColumn("l_extendedprice", holes), "l_extendedprice", 30)
    return h.withColumns({"lower": F.round("lower", 6), "upper": F.round("upper", 6)})


@query("class_counts", "SELECT count(*) AS n, count(*) FILTER (quality = 0) AS n_healthy, count(*) FILTER (quality = 1) AS n_disease FROM labels")
def class_counts(spark, folder):
    return P.class_counts(table(spark, folder, "labels"), "quality")


@query("top_features", """WITH c AS (SELECT (label >= 5)::INTEGER::DOUBLE AS t, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS feature FROM embeddings)
    SELECT CAST(feature AS INTEGER) AS feature, round(abs(corr(v, t)), 6) AS importance FROM c GROUP BY feature ORDER BY importance DESC, feature LIMIT 15""")
def top_features(spark, folder):
    e = table(spark, folder, "embeddings")
    r = P.correlation_with_target(e, F.col("embedding"), (F.col("label") >= 5).cast("int"))
    return P.top_features(r.select("feature", F.round(F.abs("r"), 6).alias("importance")))


# Suppliers stand in for models: the accuracy of one is the share of its lines
# that were not returned; a third of them "failed" and carry an error instead.
_MODELS_SQL = """WITH a AS (SELECT l_suppkey, round(avg(CASE WHEN l_returnflag <> 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) + 0.15::DOUBLE, 2) AS accuracy FROM lineitem GROUP BY 1),
    models AS (SELECT 'model_' || l_suppkey AS model, CASE WHEN l_suppkey % 3 <> 0 THEN 'out/model_' || l_suppkey || '.bin' END AS path,
      CASE WHEN l_suppkey % 3 <> 0 THEN accuracy END AS accuracy, CASE WHEN l_suppkey % 3 <> 0 THEN 'Trained' ELSE 'Error' END AS status FROM a)"""


def _summaries(spark, folder):
    share = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(
        F.round(F.avg(F.when(F.col("l_returnflag") != "R", 1.0).otherwise(0.0)) + 0.15, 2).alias("accuracy")
    )
    name, trained = F.concat(F.lit("model_"), F.col("l_suppkey")), F.col("l_suppkey") % 3 != 0
    entry = F.struct(
        F.when(trained, F.concat(F.lit("out/"), name, F.lit(".bin"))).alias("path"),
        F.when(trained, F.col("accuracy")).alias("accuracy"),
        F.when(~trained, "did not converge").alias("error"),
    )
    return share.select(F.to_json(F.create_map(name, entry)).alias("summary"))


def _models(spark, folder):
    return summary_rows(_summaries(spark, folder), "summary")


@query("model_summary_rows", f"{_MODELS_SQL} SELECT model, path, accuracy, status FROM models")
def model_summary_rows(spark, folder):
    return _models(spark, folder)


@query("leaderboard_stats", f"""{_MODELS_SQL} SELECT count(accuracy) AS trained, count(*) - count(accuracy) AS failed, round(avg(accuracy), 6) AS mean_accuracy,
    max(accuracy) AS best_accuracy, min(accuracy) AS worst_accuracy, round(stddev_samp(accuracy), 6) AS std_accuracy,
    round(max(accuracy) - min(accuracy), 6) AS accuracy_range, round(count(accuracy)::DOUBLE / count(*) * 100, 6) AS success_rate,
    round(quantile_cont(accuracy, 0.5::DOUBLE), 6) AS median_accuracy,
    round(max(accuracy) * 0.5::DOUBLE + min(accuracy) * 0.5::DOUBLE, 4) AS blended FROM models""")
def leaderboard_stats(spark, folder):
    s = B.statistics(_models(spark, folder))
    digits = ["mean_accuracy", "std_accuracy", "accuracy_range", "success_rate", "median_accuracy"]
    return s.withColumns({c: F.round(c, 6) for c in digits}).withColumn("blended", B.blended_accuracy(F.col("best_accuracy"), F.col("worst_accuracy")))


@query("accuracy_tiers", f"""{_MODELS_SQL} SELECT count(*) FILTER (accuracy > 0.85::DOUBLE) AS top_tier,
    count(*) FILTER (accuracy >= 0.75::DOUBLE AND accuracy <= 0.85::DOUBLE) AS mid_tier, count(*) FILTER (accuracy < 0.75::DOUBLE) AS low_tier FROM models""")
def accuracy_tiers(spark, folder):
    return B.tiers(_models(spark, folder))


@query("leaderboard_rank", f"""{_MODELS_SQL} SELECT model, accuracy, row_number() OVER (ORDER BY accuracy DESC NULLS LAST, model) AS position FROM models""")
def leaderboard_rank(spark, folder):
    return B.ranked(_models(spark, folder).select("model", "accuracy"))


@query("best_worst", f"""{_MODELS_SQL}, o AS (SELECT model, accuracy, row_number() OVER (ORDER BY accuracy DESC, model) AS a, row_number() OVER (ORDER BY accuracy, model DESC) AS z FROM models WHERE accuracy IS NOT NULL)
    SELECT b.model AS best_model, b.accuracy AS best_accuracy, w.model AS worst_model, w.accuracy AS worst_accuracy FROM o b, o w WHERE b.a = 1 AND w.z = 1""")
def best_worst(spark, folder):
    return B.best_and_worst(_models(spark, folder))


@query("top_models", f"{_MODELS_SQL} SELECT model, accuracy FROM models WHERE accuracy IS NOT NULL ORDER BY accuracy DESC, model LIMIT 10")
def top_models(spark, folder):
    return B.top_models(_models(spark, folder)).select("model", "accuracy")


@query("choose_best", f"""{_MODELS_SQL} SELECT model, model || '.bin' AS filename, accuracy FROM models WHERE path IS NOT NULL ORDER BY accuracy DESC NULLS LAST, filename LIMIT 1""")
def choose_best(spark, folder):
    m = _models(spark, folder).withColumn("filename", F.concat("model", F.lit(".bin")))
    return B.choose_best(m).select("model", "filename", "accuracy")


@query("choose_by_priority", f"""{_MODELS_SQL} SELECT model, accuracy FROM models WHERE path IS NOT NULL AND model IN ('model_9', 'model_7', 'model_5')
    ORDER BY CASE model WHEN 'model_9' THEN 1 WHEN 'model_7' THEN 2 ELSE 3 END LIMIT 1""")
def choose_by_priority(spark, folder):
    m = _models(spark, folder).withColumn("filename", F.concat("model", F.lit(".bin")))
    return B.choose_by_priority(m, ["model_9", "model_7", "model_5"]).select("model", "accuracy")
