"""Mix sources to target weights by repeating documents.

Sizes are summed per source; a source's repetition rate is its target over its size. Every document is taken
floor(rate) times, and once more with a probability equal to the fraction, drawn from a hash of the seed, the
document's id, its text and, among rows equal in both, the row's number, so that reruns and recomputed tasks agree and
repeated or missing ids come near the target as well.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tussis.llm.common import WORD, fresh, if_small, whole_text, written
from tussis.operators.running import with_row_number, with_running_totals

SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("bigint")


def source_targets(sized: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """Per source ``source, source_size, target, rate`` from rows of ``source, size``.

    Sources in code-point order, null last, take the weights in turn. They share the total by weight, but no
    target passes ``max_repeats`` times its source; the excess is shared again by weight. The fixed point is
    target = least(weight * level, cap), and the level is the first one, in the order of cap over weight, that
    leaves its own source below the cap. Both orders use distributed running totals: sources may be many.
    A source without any word has target and rate 0.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = with_row_number(sums, [F.col("source").isNull(), F.col("source")], "rank")
    turn = F.element_at(F.array(*[F.lit(int(w)).cast("bigint") for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("weight", turn).withColumn("cap", F.col("source_size") * max_repeats)
    capped = capped.withColumn("ratio", F.col("cap") / F.col("weight"))
    totals = written(
        with_running_totals(
            capped, ["ratio", "rank"], {"caps": F.col("cap"), "weights": F.col("weight"), "sizes": F.col("source_size")},
            grand_totals={"weights": "all_weights", "sizes": "all_sizes"},
        ).withColumn("level", F.expr("(all_sizes - (caps - cap)) / (all_weights - (weights - weight))")),
        "mix-sources",
    )
    level = totals.filter("level <= ratio").agg(F.min_by("level", F.struct("ratio", "rank")).alias("level"))
    return (
        totals.withColumn("level", level.scalar())
        .select("source", "source_size", F.expr("least(weight * level, cast(cap as double))").alias("target"))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    )


def copies_of(rate: Column, doc_id: Column, digest: Column, number: Column, seed: str = SEED) -> Column:
    """floor(rate), plus one with a probability of the fraction. 52 bits of a hash of seed, id, text digest and number decide."""
    drawn = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), digest, F.lit(":"), number.cast("string"))
    bits = F.conv(F.substring(F.md5(drawn), 1, 13), 16, 10).cast("bigint")
    return F.floor(rate) + F.when(bits / F.lit(float(1 << 52)) < rate - F.floor(rate), 1).otherwise(0)


def text_digest(text: Column) -> Column:
    return F.md5(whole_text(text).cast("binary"))


def _numbered(rows: DataFrame, digest: str, number: str) -> DataFrame:
    """Number rows of equal id, source and text digest from 1. Only such rows are put in order, by running totals over slices."""
    keys = ["doc_id", "source", digest]
    names = fresh(rows, "__id", "__src", "__dig")
    again = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    again = written(again.select(*[F.col(k).alias(n) for k, n in zip(keys, names)]), "repeated-rows")
    if again.isEmpty():
        return rows.withColumn(number, F.lit(1).cast("bigint"))
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(F.col(n)) for k, n in zip(keys, names)])
    (place,) = fresh(rows, "__place")
    many = rows.join(if_small(again), same, "left_semi").withColumn(place, F.monotonically_increasing_id())
    many = with_row_number(many, [place], number, keys).select(*rows.columns, number)
    return rows.join(if_small(again), same, "left_anti").withColumn(number, F.lit(1).cast("bigint")).unionByName(many)


def mix_plan(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeats: int = 3, seed: str = SEED) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, copies, taken``.

    Null texts have no words; null is a source of its own, ordered last. Every row has a draw of its own, rows with one
    id or none included.
    An empty table gives no rows; other columns are ignored. Only the table of sources is joined to the documents.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), text_digest(F.col("text")).alias("digest"))
    targets = if_small(written(source_targets(sized.select("source", "size"), weights, max_repeats), "mix-targets")).withColumnRenamed("source", "mixed_source")
    return (
        _numbered(sized, "digest", "number").join(targets, F.col("source").eqNullSafe(F.col("mixed_source")))
        .withColumn("copies", copies_of(F.col("rate"), F.col("doc_id"), F.col("digest"), F.col("number"), seed))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeats: int = 3, seed: str = SEED) -> DataFrame:
    """The mixed documents themselves: every row of ``docs`` as often as the plan takes it, with all its columns.

    Nulls and repeated rows as in ``mix_plan``; extra columns may have any names, an empty table gives no rows.
    """
    sized = docs.select("source", word_count(F.col("text")).alias("size"))
    source, rate, copies, copy, digest, number = fresh(docs, "__source", "__rate", "__copies", "__copy", "__digest", "__number")
    targets = written(source_targets(sized, weights, max_repeats).select(F.col("source").alias(source), F.col("rate").alias(rate)), "mix-targets")
    rows = _numbered(docs.withColumn(digest, text_digest(docs["text"])), digest, number)
    return (
        rows.join(if_small(targets), rows["source"].eqNullSafe(F.col(source)))
        .withColumn(copies, copies_of(F.col(rate), F.col("doc_id"), F.col(digest), F.col(number), seed))
        .filter(F.col(copies) > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copies))))
        .select(*docs.columns)
    )
