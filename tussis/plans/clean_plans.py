"""Cleaning, labelling, column selection and metadata joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tussis.functions import clean as C
from tussis.operators import clean as O, lookup as L
from tussis.plans.registry import query, spread_table, sql_list, sql_strip, table


def _messy_segment(spark, folder):
    k, s = F.col("c_custkey"), F.col("c_mktsegment")
    text = F.when(k % 5 == 0, F.concat(F.lit("\t\u00a0 "), s, F.lit("\r\n"))).when(k % 5 == 1, "NaN").when(k % 5 == 2, "").when(k % 5 == 3, s)
    return table(spark, folder, "customer").select("c_custkey", text.alias("segment"))


_MESSY_SQL = """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN chr(9) || chr(160) || ' ' || c_mktsegment || chr(13) || chr(10) WHEN 1 THEN 'NaN' WHEN 2 THEN ''
    WHEN 3 THEN c_mktsegment END AS segment FROM customer"""


@query("clean_category", f"""WITH m AS ({_MESSY_SQL}) SELECT c_custkey,
    coalesce(nullif(nullif(nullif(lower({sql_strip('segment')}), ''), 'nan'), 'none'), 'unknown') AS segment FROM m""")
def clean_category(spark, folder):
    return _messy_segment(spark, folder).select("c_custkey", C.clean_category(F.col("segment")).alias("segment"))


@query("clamp_domain", f"""WITH m AS ({_MESSY_SQL}) SELECT c_custkey,
    CASE WHEN lower({sql_strip('segment')}) IN ('building', 'furniture', 'household') THEN lower({sql_strip('segment')}) ELSE 'unknown' END AS segment FROM m""")
def clamp_domain(spark, folder):
    allowed = ["building", "furniture", "household"]
    return _messy_segment(spark, folder).select("c_custkey", C.clamp_domain(F.col("segment"), allowed).alias("segment"))


def _number_text(spark, folder):
    k = F.regexp_extract("props", r"(\d+)", 1)
    i = F.col("event_id")
    text = (
        F.when(i % 6 == 0, F.col("props")).when(i % 6 == 1, k).when(i % 6 == 2, F.concat(k, F.lit("d")))
        .when(i % 6 == 3, F.concat(F.lit("\t"), k, F.lit(".5e1\u00a0"))).when(i % 6 == 4, "nan")
    )
    return table(spark, folder, "events").select("event_id", text.alias("text"))


_NUMBER_SQL = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN regexp_extract(props, '([0-9]+)', 1)
    WHEN 2 THEN regexp_extract(props, '([0-9]+)', 1) || 'd' WHEN 3 THEN chr(9) || regexp_extract(props, '([0-9]+)', 1) || '.5e1' || chr(160)
    WHEN 4 THEN 'nan' END AS text FROM events"""


@query("coerce_numeric", f"""WITH m AS ({_NUMBER_SQL})
    SELECT event_id, CASE WHEN text <> 'nan' THEN try_cast({sql_strip('text')} AS DOUBLE) END AS number FROM m""")
def coerce_numeric(spark, folder):
    return _number_text(spark, folder).select("event_id", C.to_number(F.col("text")).alias("number"))


@query("impute_const", f"""WITH m AS ({_NUMBER_SQL}), n AS (SELECT event_id, CASE WHEN text <> 'nan' THEN try_cast({sql_strip('text')} AS DOUBLE) END AS v FROM m)
    SELECT event_id, coalesce(v, 35.0::DOUBLE) AS age, coalesce(v, 0.85::DOUBLE) AS cough_detected FROM n""")
def impute_const(spark, folder):
    return _number_text(spark, folder).select(
        "event_id",
        C.number_or(F.col("text"), C.DEFAULT_AGE).alias("age"),
        C.number_or(F.col("text"), C.DEFAULT_COUGH).alias("cough_detected"),
    )


_BOOL_WORDS = ["True\n", "\tyes ", "1", "T", "\u00a0on", "Y", "False", "no", "0", "f", "OFF", "n", "maybe", ""]


@query("parse_bool", f"""WITH m AS (SELECT c_custkey, nullif({sql_list(_BOOL_WORDS)}[c_custkey % {len(_BOOL_WORDS)} + 1], '') AS w FROM customer),
    p AS (SELECT c_custkey, w, lower({sql_strip('w')}) AS x FROM m)
    SELECT c_custkey, w AS text, coalesce(x IN ('true','1','yes','y','t','on'), false) AS lenient,
      CASE WHEN x IS NULL OR x IN ('false','0','no','n','f','off') THEN false WHEN x IN ('true','1','yes','y','t','on') THEN true END AS strict
    FROM p""")
def parse_bool(spark, folder):
    words = F.array(*[F.lit(w) for w in _BOOL_WORDS])
    text = F.nullif(F.element_at(words, (F.col("c_custkey") % len(_BOOL_WORDS) + 1).cast("int")), F.lit(""))
    d = table(spark, folder, "customer").select("c_custkey", text.alias("text"))
    return d.select("c_custkey", "text", C.parse_bool(F.col("text")).alias("lenient"), C.parse_bool(F.col("text"), "strict").alias("strict"))


@query("impute_median", """WITH m AS (SELECT l_orderkey, l_linenumber, nullif(l_quantity, 25) AS l_quantity,
      CASE WHEN l_linenumber <> 3 THEN l_extendedprice END AS l_extendedprice FROM lineitem),
    md AS (SELECT quantile_cont(l_quantity, 0.5) AS q, quantile_cont(l_extendedprice, 0.5) AS e FROM m)
    SELECT l_orderkey, l_linenumber, coalesce(l_quantity, (SELECT q FROM md)) AS l_quantity,
      round(coalesce(l_extendedprice, (SELECT e FROM md)), 6) AS l_extendedprice FROM m""")
def impute_median(spark, folder):
    li = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_quantity") == 25, float("nan")).otherwise(F.col("l_quantity")).alias("l_quantity"),
        F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice")).alias("l_extendedprice"),
    )
    filled = O.impute_median(li, ["l_quantity", "l_extendedprice"])
    return filled.withColumn("l_extendedprice", F.round("l_extendedprice", 6))


_NESTED_SQL = sql_strip("""coalesce(CASE WHEN o_custkey % 3 = 0 THEN o_orderpriority END,
      CASE WHEN o_orderstatus = 'F' THEN chr(9) || 'Wet' || chr(160) END, nullif(o_orderstatus, 'P'))""")


@query("first_nested", f"SELECT o_orderkey, lower({_NESTED_SQL}) AS diagnosis FROM orders")
def first_nested(spark, folder):
    k = F.col("o_custkey") % 3
    nested = table(spark, folder, "orders").select(
        "o_orderkey",
        F.struct(F.when(k == 0, F.col("o_orderpriority")).when(k == 1, "").alias("diagnosis")).alias("e1"),
        F.struct(F.when(F.col("o_orderstatus") == "F", "\tWet\u00a0").alias("diagnosis")).alias("e2"),
        F.struct(F.nullif("o_orderstatus", F.lit("P")).alias("diagnosis")).alias("e3"),
    )
    return nested.select("o_orderkey", C.first_label([F.col(f"{e}.diagnosis") for e in ("e1", "e2", "e3")]).alias("diagnosis"))


@query("derive_label", f"""WITH m AS (SELECT CAST(o_orderkey AS VARCHAR) AS file_id,
      CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN chr(160) || 'COVID-19' || chr(10) WHEN '2' THEN 'Symptomatic' WHEN '3' THEN 'healthy' WHEN '4' THEN '' ELSE 'other' END AS status,
      CASE o_orderstatus WHEN 'F' THEN 'lower_infection' WHEN 'O' THEN NULL ELSE 'Healthy_Cough' END AS d1,
      CASE o_custkey % 4 WHEN 0 THEN 'covid' WHEN 1 THEN 'Obstructive_Disease' WHEN 2 THEN 'unclear' END AS d2, o_totalprice, o_custkey FROM orders),
    s AS (SELECT *, lower({sql_strip('status')}) AS st, lower(coalesce(d1, d2)) AS dx FROM m),
    l AS (SELECT *, CASE WHEN st IN ('covid-19','covid') THEN 1 WHEN st = 'symptomatic' THEN 1 WHEN st = 'healthy' THEN 0
      WHEN dx IN ('covid-19','covid') THEN 1 WHEN dx IN ('lower_infection','upper_infection') THEN 1 WHEN dx = 'obstructive_disease' THEN 1
      WHEN dx = 'healthy_cough' THEN 0 END AS target,
      CASE WHEN st IN ('covid-19','covid') THEN 'COVID-19' WHEN st = 'symptomatic' THEN 'Symptomatic Respiratory Infection' WHEN st = 'healthy' THEN 'Healthy Baseline'
      WHEN dx IN ('covid-19','covid') THEN 'COVID-19' WHEN dx IN ('lower_infection','upper_infection') THEN 'Respiratory Tract Infection'
      WHEN dx = 'obstructive_disease' THEN 'Obstructive Lung Condition / Wheeze' WHEN dx = 'healthy_cough' THEN 'Healthy Baseline' END AS disease_subtype FROM s)
    SELECT file_id, CAST(target AS INTEGER) AS target, disease_subtype,
      CASE WHEN o_custkey % 5 IN (0, 1) THEN 'female' WHEN o_custkey % 5 = 2 THEN 'other' ELSE 'unknown' END AS gender,
      CASE WHEN o_custkey % 7 = 0 THEN 35.0::DOUBLE ELSE CAST(o_custkey % 90 AS DOUBLE) END AS age, 0.85::DOUBLE AS cough_detected,
      (o_custkey % 2 = 0) AS respiratory_condition, false AS fever_muscle_pain FROM l WHERE target IS NOT NULL""")
def derive_label(spark, folder):
    p, k = F.substring("o_orderpriority", 1, 1), F.col("o_custkey")
    o = spread_table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("file_id"),
        F.when(p == "1", "\u00a0COVID-19\n").when(p == "2", "Symptomatic").when(p == "3", "healthy").when(p == "4", "").otherwise("other").alias("status"),
        F.struct(F.when(F.col("o_orderstatus") == "F", "lower_infection").when(F.col("o_orderstatus") == "P", "Healthy_Cough").alias("diagnosis")).alias("expert_labels_1"),
        F.struct(F.when(k % 4 == 0, "covid").when(k % 4 == 1, "Obstructive_Disease").when(k % 4 == 2, "unclear").alias("diagnosis")).alias("expert_labels_2"),
        F.when(k % 5 == 0, "female").when(k % 5 == 1, "\tFemale\u00a0").when(k % 5 == 2, "OTHER").when(k % 5 == 3, "f").alias("gender"),
        F.when(k % 7 == 0, "n/a").otherwise((k % 90).cast("string")).alias("age"),
        F.when(k % 2 == 0, "True").otherwise("yes").alias("respiratory_condition"),
    )
    return O.label_metadata(o)


_STATUS_SQL = "SELECT event_id, CASE event_type WHEN 'click' THEN 'healthy' WHEN 'error' THEN 'covid-19' ELSE event_type END AS status FROM events"


@query("binary_filter", f"""WITH s AS ({_STATUS_SQL}) SELECT event_id, status, CAST(CASE status WHEN 'healthy' THEN 0 ELSE 1 END AS INTEGER) AS target
    FROM s WHERE status IN ('healthy', 'covid-19')""")
def binary_filter(spark, folder):
    t = F.col("event_type")
    s = table(spark, folder, "events").select("event_id", F.when(t == "click", "healthy").when(t == "error", "covid-19").otherwise(t).alias("status"))
    return O.binary_rows(s)


@query("project_numeric", "SELECT l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def project_numeric(spark, folder):
    return O.numeric_projection(table(spark, folder, "lineitem"), exclude=["l_orderkey"])


@query("conform_columns", """SELECT s_suppkey, s_acctbal, 0.0::DOUBLE AS latitude, 'unknown' AS gender, s_name FROM supplier""")
def conform_columns(spark, folder):
    return O.conform_columns(table(spark, folder, "supplier"), ["s_suppkey", "s_acctbal", "latitude", "gender", "s_name"], ["gender"])


@query("limit_ordered", "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 50")
def limit_ordered(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "lang", "n_chars").orderBy("doc_id").limit(50)


@query("factorize", """WITH m AS (SELECT event_id, nullif(event_type, 'error') AS event_type FROM events),
    f AS (SELECT event_type, min(event_id) AS first FROM m WHERE event_type IS NOT NULL GROUP BY 1),
    c AS (SELECT event_type, row_number() OVER (ORDER BY first) - 1 AS code FROM f)
    SELECT m.event_id, m.event_type, coalesce(c.code, -1) AS code FROM m LEFT JOIN c USING (event_type)""")
def factorize(spark, folder):
    e = table(spark, folder, "events").select("event_id", F.nullif("event_type", F.lit("error")).alias("event_type"))
    return O.factorize(e, "event_type", "event_id")


@query("email_rule", r"""WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \t\r\n]+')) AS token FROM documents WHERE contains(text, '@'))
    SELECT doc_id, token, regexp_full_match(token, '[^\s@]+@[^\s@]+\.[^\s@]+') AS is_email FROM t WHERE contains(token, '@')""")
def email_rule(spark, folder):
    d = table(spark, folder, "documents").where(F.col("text").contains("@"))
    tokens = d.select("doc_id", F.explode(F.split("text", r"[ \t\r\n]+")).alias("token")).where(F.col("token").contains("@"))
    return tokens.withColumn("is_email", C.is_email(F.col("token")))


@query("numeric_columns", """WITH c AS (SELECT 'c_custkey' AS column_name, count(try_cast(c_custkey AS DOUBLE)) AS n_numeric FROM customer
    UNION ALL SELECT 'c_name', count(try_cast(c_name AS DOUBLE)) FROM customer
    UNION ALL SELECT 'c_acctbal', count(try_cast(c_acctbal AS DOUBLE)) FROM customer
    UNION ALL SELECT 'code', count(try_cast(CASE WHEN c_custkey % 3 = 0 THEN substr(c_name, 10) ELSE c_mktsegment END AS DOUBLE)) FROM customer
    UNION ALL SELECT 'c_mktsegment', count(try_cast(c_mktsegment AS DOUBLE)) FROM customer)
    SELECT * FROM c WHERE n_numeric > 0""")
def numeric_columns(spark, folder):
    c = table(spark, folder, "customer").withColumn(
        "code", F.when(F.col("c_custkey") % 3 == 0, F.substring("c_name", 10, 20)).otherwise(F.col("c_mktsegment"))
    )
    texts = c.select(*[F.col(x).cast("string").alias(x) for x in ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "code"]])
    return O.numeric_columns(texts, exclude=["c_nationkey"])


@query("join_meta_features", "SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)")
def join_meta_features(spark, folder):
    return L.with_features(table(spark, folder, "documents").select("doc_id", "lang", "n_chars"), table(spark, folder, "labels"), "doc_id")


@query("has_audio_semi", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def has_audio_semi(spark, folder):
    return L.having(table(spark, folder, "documents").select("doc_id", "source"), table(spark, folder, "labels"), "doc_id")


@query("missing_audio_anti", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_audio_anti(spark, folder):
    return L.lacking(table(spark, folder, "documents").select("doc_id", "source"), table(spark, folder, "labels"), "doc_id")


@query("score_lookup", "SELECT d.doc_id, d.lang, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def score_lookup(spark, folder):
    return L.lookup_or(table(spark, folder, "documents").select("doc_id", "lang"), table(spark, folder, "labels"), "doc_id", "quality", -1)
