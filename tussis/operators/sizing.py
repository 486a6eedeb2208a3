"""Joins whose broadcast side is measured first."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BROADCAST_ROWS = 100_000


def within_rows(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows.

    ``take`` reads partitions a few at a time and stops once it has enough, and
    only a constant per row comes back.
    """
    return len(df.select(F.lit(1)).take(max_rows + 1)) <= max_rows


def spread(scan: DataFrame) -> DataFrame:
    """Repartition a scan that has fewer partitions than there are cores.

    Only small inputs qualify (a large one has more splits than cores), so the
    shuffle this adds is small too. ``scan`` must be a plain scan: its number
    of partitions is known without running anything.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def join_measured(big: DataFrame, small: DataFrame, on, how: str = "inner", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``small`` by broadcast when its row count is within ``max_rows``.

    Beyond the bound the join is left to Catalyst and AQE, which sort-merges
    and splits skewed partitions.
    """
    if within_rows(small, max_rows):
        small = F.broadcast(small)
    return big.join(small, on, how)
