"""Contiguous shards of near-equal bytes.

Documents are put in one global order (id, then checksum and size), prefix sums of their bytes come from
per-partition totals, and the running total is cut at equal targets. Every shard is therefore one
contiguous stretch of the order, and differs from the target by at most one document at either end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tussis.llm.common import whole_text
from tussis.operators.running import with_running_totals


def assign_shards(docs: DataFrame, n_shards: int = 8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, shard, slot``.

    ``size`` is the UTF-8 bytes of the text plus one, ``text_crc32`` its unsigned CRC-32, ``slot`` counts from 0
    inside a shard without gaps. A document belongs to the shard in whose stretch its middle byte lies.

    Null texts count as empty; null ids come first. Repeated rows (same id and text) are counted once, shuffled
    once and dealt out again afterwards, next to each other, so they may straddle a cut. An empty table gives no
    rows. Other columns are ignored, whatever their names. A shard can stay empty where one document is
    larger than a whole target.
    """
    text = whole_text(F.col(text_column))
    groups = (
        docs.select(
            F.col(id_column).alias("doc_id"),
            (F.octet_length(text).cast("bigint") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        )
        .groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    )
    totals = with_running_totals(
        groups, ["doc_id", "text_crc32", "size"], {"rows": F.col("n"), "bytes": F.col("n") * F.col("size")}, grand_totals={"bytes": "all_bytes"}
    )
    rows = (
        totals.withColumn("copy", F.explode(F.expr("sequence(0L, n - 1)")))
        .withColumn("row", F.expr("rows - n + copy"))
        .withColumn("start", F.expr("bytes - (n - copy) * size"))
        .withColumn("shard", F.expr(f"cast(least({n_shards} - 1, ((2 * start + size) * {n_shards}) div (2 * all_bytes)) as int)"))
        .select("doc_id", "size", "text_crc32", "row", "shard")
    )
    firsts = rows.groupBy("shard").agg(F.min("row").alias("first_row"))  # n_shards rows
    return rows.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot"))
