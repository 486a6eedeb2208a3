"""Sources, sinks and caches, each read back after writing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tussis.functions import clean as C
from tussis.operators import lookup as L
from tussis.plans.registry import query, sql_strip, table
from tussis.session import scratch_path
from tussis.sources import sidecars, sinks


@query("json_props", """WITH m AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN substr(props, 1, 4) ELSE props END AS props FROM events)
    SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END AS k,
      CASE WHEN event_id % 13 = 0 THEN props END AS corrupt FROM m""")
def json_props(spark, folder):
    e = table(spark, folder, "events").select(
        "event_id", F.when(F.col("event_id") % 13 == 0, F.substring("props", 1, 4)).otherwise(F.col("props")).alias("props")
    )
    return sidecars.parse_json(e, "props", "k BIGINT", "corrupt").select("event_id", "k", "corrupt")


_PAGE_PRIORITY = ["https", "http"]


@query("priority_pick", r"""WITH p AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '^([a-z]+):', 1) AS scheme, url FROM pages),
    r AS (SELECT host, url, row_number() OVER (PARTITION BY host ORDER BY CASE scheme WHEN 'https' THEN 1 ELSE 2 END, url) AS n FROM p)
    SELECT host, url FROM r WHERE n = 1""")
def priority_pick(spark, folder):
    p = table(spark, folder, "pages").select(
        F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract("url", "^([a-z]+):", 1).alias("scheme"), "url"
    )
    return L.pick_first(p, "host", [L.priority_rank(F.col("scheme"), _PAGE_PRIORITY), F.col("url")], ["url"])


@query("source_priority", """SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, 'microphone-' || o_custkey) AS source FROM orders""")
def source_priority(spark, folder):
    k = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        sidecars.source_of(
            F.when(k % 3 == 0, F.col("o_orderpriority")).otherwise("\t\u00a0"),
            F.when(k % 2 == 0, F.concat(F.lit("\n "), F.col("o_orderstatus"), F.lit("\u00a0"))),
            F.concat(F.lit("microphone-"), F.col("o_custkey")),
        ).alias("source"),
    )


@query("source_object_keys", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'uploads/' || o_orderstatus || '.wav' WHEN 1 THEN CAST(o_custkey AS VARCHAR)
      WHEN 2 THEN 'tmp-' || o_orderkey ELSE 'microphone' END AS source FROM orders""")
def source_object_keys(spark, folder):
    """Objects with several keys, some blank; one without any falls back to the next input."""
    k, blank = F.col("o_orderkey"), F.lit(" \t")
    own = F.concat(F.lit("uploads/"), F.col("o_orderstatus"), F.lit(".wav"))
    item = (
        F.when(k % 4 == 0, F.to_json(F.struct(own.alias("path"), F.col("o_clerk_name").alias("name"))))
        .when(k % 4 == 1, F.to_json(F.struct(blank.alias("path"), F.col("o_custkey").cast("string").alias("file_name"), F.lit("later").alias("tmp_path"))))
        .when(k % 4 == 2, F.concat(F.lit("tmp-"), k, F.lit("\n")))
        .otherwise(F.to_json(F.struct(blank.alias("filepath"), F.lit("x").alias("unknown"))))
    )
    orders = table(spark, folder, "orders").withColumn("o_clerk_name", F.lit("second"))
    return orders.select("o_orderkey", sidecars.source_of(item, F.lit("microphone")).alias("source"))


@query("ext_filter", r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '([^/]*)$', 1) AS base FROM pages),
    e AS (SELECT page_id, url || CASE WHEN page_id % 4 = 0 THEN '.PDF' WHEN page_id % 4 = 1 THEN '.wav' ELSE '' END AS path,
      CASE WHEN page_id % 4 = 0 THEN CASE WHEN base = '' THEN '' ELSE '.pdf' END WHEN page_id % 4 = 1 THEN CASE WHEN base = '' THEN '' ELSE '.wav' END
      ELSE lower(regexp_extract(base, '.(\.[^.]*)$', 1)) END AS ext FROM p)
    SELECT page_id, path, ext FROM e WHERE ext NOT IN ('.pdf','.doc','.docx','.txt','.json','.zip','.tar','.gz','.csv','.xlsx','.png','.jpg','.jpeg','.exe','.bin','.py')""")
def ext_filter(spark, folder):
    i = F.col("page_id")
    p = table(spark, folder, "pages").select(
        "page_id", F.concat(F.col("url"), F.when(i % 4 == 0, ".PDF").when(i % 4 == 1, ".wav").otherwise("")).alias("path")
    )
    return L.reject_non_audio(p).withColumn("ext", C.extension(F.col("path")))


@query("feature_cache_roundtrip", """SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n_samples,
      round(list_max(embedding::DOUBLE[]), 6) AS top, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings""")
def feature_cache_roundtrip(spark, folder):
    def features(df):
        y = F.col("embedding").cast("array<double>")
        return df.select(
            "vec_id", F.size(y).alias("n_samples"), F.round(F.array_max(y), 6).alias("top"),
            F.round(F.aggregate(y, F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
        )

    return sinks.cached(table(spark, folder, "embeddings"), scratch_path(spark, "features"), features)


@query("sink_csv_roundtrip", "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def sink_csv_roundtrip(spark, folder):
    path = scratch_path(spark, "csv")
    sinks.write_csv(table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"), path)
    return sinks.read_csv(spark, path, "p_partkey BIGINT, p_name STRING, p_brand STRING, p_size INT, p_retailprice DOUBLE")


@query("sink_json_roundtrip", "SELECT s_suppkey, s_name, n_name, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def sink_json_roundtrip(spark, folder):
    path = scratch_path(spark, "json")
    s = table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    sinks.write_json(s.select("s_suppkey", "s_name", "n_name", "s_acctbal"), path)
    return spark.read.schema("s_suppkey BIGINT, s_name STRING, n_name STRING, s_acctbal DOUBLE").json(path)


@query("message_text", f"""SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN {sql_strip("text || chr(10) || role")} ELSE {sql_strip("text")} END AS message FROM conversations""")
def message_text(spark, folder):
    n = F.col("turn")
    t = F.when(n % 4 != 3, F.concat(F.lit("\u00a0\t"), F.col("text"), F.lit("\n\u2003"))).otherwise(F.col("text"))
    as_list = F.to_json(F.array(t))

    def part(kind, value):
        return F.struct(F.lit(kind).alias("type"), value.alias("text"))

    parts = F.to_json(F.array(part("text", t), part("image", F.lit("skipped")), part("text", F.col("role"))))
    content = (
        F.when(n % 4 == 0, F.substring(as_list, F.lit(2), F.length(as_list) - 2))
        .when(n % 4 == 1, F.to_json(F.struct(t.alias("text"))))
        .when(n % 4 == 2, F.to_json(F.struct(t.alias("content"))))
        .otherwise(parts)
    )
    c = table(spark, folder, "conversations").select("conv_id", "turn", content.alias("content"))
    return c.select("conv_id", "turn", sidecars.message_text(F.col("content")).alias("message"))
