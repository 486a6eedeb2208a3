"""Exact, linearly interpolated quantiles without sorting the table, in two scans.

The built-in exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer. Here one wide aggregate brackets each wanted rank with a
mergeable sketch of known error. The second scan counts what lies below each
bracket and counts the values inside it, combined in every task before the
shuffle; the ranks are then exact. Brackets follow ranks, not distances, so outliers and skewed
values change nothing, and any number of groups takes the same way.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: A sketch is wrong by one part in so many; a bracket reaches twice as far on either side.
ACCURACY = 10_000
MARGIN = 2.0 / ACCURACY
#: Smaller groups are taken whole: there the margin wouldn't cover the neighbouring rank.
WHOLE = 5 * ACCURACY


def _numbers(column: str) -> Column:
    """The column as double, null where it isn't a number."""
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def brackets(df: DataFrame, columns: Sequence[str], probabilities: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column_name, q, p, total, lo, hi): where each quantile's neighbouring ranks must lie."""
    wanted = list(probabilities.items())
    ends = {"low": [max(0.0, p - MARGIN) for _, p in wanted], "high": [min(1.0, p + MARGIN) for _, p in wanted]}
    aggregates = []
    for c in columns:
        value = _numbers(c)
        aggregates += [F.count(value).alias(f"__n_{c}"), F.min(value).alias(f"__min_{c}"), F.max(value).alias(f"__max_{c}")]
        aggregates += [F.percentile_approx(value, at, ACCURACY).alias(f"__{end}_{c}") for end, at in ends.items()]
    totals = df.groupBy(*by).agg(*aggregates)

    def bracket(c: str, k: int) -> Column:
        name, p = wanted[k]
        n, least, most = (F.col(f"__{x}_{c}") for x in ("n", "min", "max"))
        low = F.when((n < WHOLE) | F.lit(p <= MARGIN), least).otherwise(F.get(F.col(f"__low_{c}"), F.lit(k)))
        high = F.when((n < WHOLE) | F.lit(p >= 1 - MARGIN), most).otherwise(F.get(F.col(f"__high_{c}"), F.lit(k)))
        return F.struct(F.lit(c).alias("column_name"), F.lit(name).alias("q"), F.lit(float(p)).alias("p"), n.alias("total"), low.alias("lo"), high.alias("hi"))

    rows = F.array(*[bracket(c, k) for c in columns for k in range(len(wanted))])
    return totals.select(*by, F.inline(rows)).where("total > 0")


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """One row per (by..., column_name) with a column per requested quantile.

    Nulls and NaN are left out; a column without any number has no row. Lazy: nothing runs before the result is read.
    """
    groups = [*by, "column_name"]
    found = brackets(df, columns, probabilities, by)
    found = found.withColumnsRenamed({g: f"__b_{g}" for g in groups})
    if not by:
        found = F.broadcast(found)  # a row per column and quantile
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), _numbers(c).alias("value")) for c in columns])
    values = df.select(*by, F.inline(cells)).where("value IS NOT NULL")

    on = F.lit(True)
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"__b_{g}"))
    met = values.join(found, on).where("value <= hi").select(
        *groups, "q", "p", "total", F.when(F.col("value") >= F.col("lo"), F.col("value")).alias("v"))
    counts = met.groupBy(*groups, "q", "p", "total", "v").agg(F.count("*").alias("n"))  # v null: everything below

    # At most some ten-thousandths of a group's rows, value by value.
    along = Window.partitionBy(*groups, "q").orderBy(F.asc_nulls_first("v"))
    upto, position = F.sum("n").over(along), F.col("p") * (F.col("total") - 1)
    ranked = counts.withColumns({"upto": upto, "low": F.floor(position), "high": F.ceil(position), "weight": position - F.floor(position)})

    def holds(rank: str) -> Column:
        return (F.col("upto") - F.col("n") <= F.col(rank)) & (F.col(rank) < F.col("upto")) & F.col("v").isNotNull()

    near = ranked.groupBy(*groups, "q").agg(
        F.max(F.when(holds("low"), F.col("v"))).alias("a"), F.max(F.when(holds("high"), F.col("v"))).alias("b"), F.max("weight").alias("weight"))
    a, b = F.col("a"), F.col("b")
    exact = near.withColumn("value", F.when(a == b, a).otherwise(a + (b - a) * F.col("weight")))
    return exact.groupBy(*groups).agg(*[F.max(F.when(F.col("q") == name, F.col("value"))).alias(name) for name in probabilities])
