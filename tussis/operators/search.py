"""Substring search over identifiers through trigram postings.

Each row is posted under every distinct trigram of its lower-cased identifier, with the identifier itself. Postings are
range-partitioned and sorted by (bucket, trigram), so that a trigram's rows lie together, may span many files however
common it is, and are found by partition folder and Parquet statistics. A search reads the rarest trigram of its needle
and verifies the identifiers there; what the other trigrams hold needn't be read, as the verification is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

GRAM = 3
BUCKETS = 64
POSTING = ["__bucket", "__gram"]


def _bucket(gram, buckets: int):
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def write_index(rows: DataFrame, identifier: str, folder: str, buckets: int = BUCKETS) -> None:
    """Write the postings of ``rows`` (all its columns are kept) under ``folder/postings``, and the rows under ``folder/rows``.

    Identifiers that are null or shorter than a trigram have no postings; only needles shorter than a trigram, which read
    all rows, can match them. Repeated rows are posted each. An empty table gives an empty index.
    """
    rows.write.parquet(f"{folder}/rows")
    lowered = F.lower(F.col(identifier).cast("string"))
    length = F.char_length(lowered)
    starts = F.when(length >= GRAM, F.sequence(F.lit(1), length - (GRAM - 1)))
    grams = F.array_distinct(F.transform(starts, lambda i: F.substring(lowered, i, F.lit(GRAM))))
    posted = rows.select(F.explode(grams).alias("__gram"), "*").withColumn("__bucket", _bucket(F.col("__gram"), buckets))
    spread = posted.repartitionByRange("__bucket", "__gram", F.xxhash64(identifier)).sortWithinPartitions(*POSTING)
    spread.write.partitionBy("__bucket").parquet(f"{folder}/postings")


def grams_of(needle: str) -> list[str]:
    return sorted({needle[i : i + GRAM] for i in range(len(needle) - GRAM + 1)})


def postings(spark: SparkSession, folder: str, schema: StructType, grams: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Postings of the given trigrams."""
    wanted = spark.createDataFrame([(g,) for g in grams], "g string").select(_bucket(F.col("g"), buckets)).collect()  # as many as the needle has
    posted = StructType([*schema.fields, StructField("__gram", StringType()), StructField("__bucket", IntegerType())])
    table = spark.read.schema(posted).parquet(f"{folder}/postings")
    return table.where(F.col("__bucket").isin(sorted({r[0] for r in wanted})) & F.col("__gram").isin(grams))


def search(spark: SparkSession, folder: str, identifier: str, needle: str | None, buckets: int = BUCKETS) -> DataFrame:
    """Rows whose identifier contains ``needle``, in any case and without blanks around it; a blank needle finds all rows.

    A needle shorter than a trigram is looked for in all rows.
    """
    wanted = (needle or "").strip().lower()
    rows = spark.read.parquet(f"{folder}/rows")
    if not wanted:
        return rows
    holds = F.lower(F.col(identifier).cast("string")).contains(wanted)
    grams = grams_of(wanted)
    if not grams:
        return rows.where(holds)
    held = {r[0]: r[1] for r in postings(spark, folder, rows.schema, grams, buckets).groupBy("__gram").count().collect()}  # a row a trigram of the needle
    rarest = min(grams, key=lambda g: (held.get(g, 0), g))
    if rarest not in held:
        return rows.limit(0)
    return postings(spark, folder, rows.schema, [rarest], buckets).where(holds).select(*rows.columns)
