"""Running totals and row numbers over an order that no single task could hold.

``Window.orderBy`` without a partition, or with a partition that owns a large
share of the table, sends those rows to one task. Here the rows are range
partitioned on (group, order) so that each slice is bounded, totals are taken
inside each slice, and the small table of slice sums supplies the offsets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tussis.session import durable

SLICE = "__slice"


def _sort_name(order) -> Column:
    return F.col(order) if isinstance(order, str) else order


def with_running_totals(
    df: DataFrame,
    order_by: Sequence,
    totals: Mapping[str, Column],
    partition_by: Sequence[str] = (),
    grand_totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add an inclusive running sum per entry of ``totals``.

    ``order_by`` should end in a unique column so that the order, and therefore
    the range split, never has to keep equal keys together. ``grand_totals``
    maps an entry of ``totals`` to the name of a column for its group total.
    """
    groups = list(partition_by)
    orders = [_sort_name(o) for o in order_by]
    step = {name: f"__step_{name}" for name in totals}
    source = df.columns

    sliced = durable(
        df.withColumns({step[name]: value for name, value in totals.items()})
        .repartitionByRange(*[F.col(g) for g in groups], *orders)
        .withColumn(SLICE, F.spark_partition_id())
    )

    inside = Window.partitionBy(SLICE, *groups).orderBy(*orders).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = sliced.select(
        *source, SLICE, *[F.sum(step[name]).over(inside).alias(name) for name in totals]
    )

    # One row per (slice, group): slices before this one give the offset.
    sums = sliced.groupBy(SLICE, *groups).agg(*[F.sum(step[name]).alias(name) for name in totals])
    earlier = Window.partitionBy(*groups).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    wanted = dict(grand_totals or {})
    offsets = sums.select(
        F.col(SLICE).alias("__o_slice"),
        *[F.col(g).alias(f"__o_{g}") for g in groups],
        *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"__before_{name}") for name in totals],
        *[F.sum(name).over(whole).alias(out) for name, out in wanted.items()],
    )

    condition = F.col(SLICE) == F.col("__o_slice")
    for g in groups:
        condition = condition & F.col(g).eqNullSafe(F.col(f"__o_{g}"))
    return local.join(offsets, condition).select(
        *source,
        *[(F.col(name) + F.col(f"__before_{name}")).alias(name) for name in totals],
        *wanted.values(),
    )


def with_row_number(df: DataFrame, order_by: Sequence, name: str = "row_number", partition_by: Sequence[str] = ()) -> DataFrame:
    """``row_number()`` for groups of any size."""
    return with_running_totals(df, order_by, {name: F.lit(1).cast("bigint")}, partition_by)
