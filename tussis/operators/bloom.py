"""Membership of ids by a Bloom filter of bounded size, whatever the number of ids.

Used where a row carries something large that must not be shuffled and the ids may be too many to broadcast: rows that
can't be members go before the costly step, and the few false members go afterwards by a join on ids alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Bits of the filter (8 MiB); with 3 hashes, ten million ids leave one false member in 20.
BITS = 1 << 26
HASHES = 3


def _places(id_: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(id_, F.lit(i)), F.lit(BITS)) for i in range(HASHES)]


def might_be_in(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose id may occur in ``ids`` (same column name); all that do occur are kept. A null id goes."""
    places = ids.where(F.col(column).isNotNull()).select(F.explode(F.array(*_places(F.col(column)))).alias("p"))
    words = places.groupBy(F.floor(F.col("p") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 AS int))")).alias("bits"))
    held = words.toArrow()  # at most one row per 64 bits
    filled = np.zeros(BITS // 64, dtype=np.int64)
    filled[held["word"].to_numpy()] = held["bits"].to_numpy()
    sent = df.sparkSession.sparkContext.broadcast(filled)

    @F.pandas_udf(T.BooleanType())
    def told(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        hit = np.ones(len(a), dtype=bool)
        for place in (a.to_numpy(), b.to_numpy(), c.to_numpy()):
            hit &= (sent.value[place // 64] >> (place % 64)) & 1 == 1
        return pd.Series(hit)

    return df.where(F.col(column).isNotNull() & told(*_places(F.col(column))))
