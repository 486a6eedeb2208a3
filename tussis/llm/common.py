"""What the training-data operators share: text conventions, written intermediates and measured joins."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tussis.session import scratch_path

#: White space that parts words: blank and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Largest table, in bytes of its values, that is sent whole to every task.
BROADCAST_BYTES = 8 << 20


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z and nothing else. Pure ASCII takes the fast built-in way."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def whole_text(column: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(column, F.lit(""))


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Cuts the lineage: lost executors never cause more than the current step to run again,
    and values that depend on the run (row ids) are fixed from here on.
    """
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` doesn't have, whatever extra columns it came with."""
    taken = {c.lower() for c in df.columns}
    names = []
    for stem in stems:
        name = stem if stem.lower() not in taken else f"{stem}_{uuid.uuid4().hex[:8]}"
        taken.add(name.lower())
        names.append(name)
    return names


def value_bytes(df: DataFrame) -> int:
    """Bytes of all values of a small written table: 8 a fixed-width value, texts and arrays as they are."""
    sizes = [F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0)) + 16 for name, _ in df.dtypes]
    row = df.agg(F.sum(reduce(lambda a, b: a + b, sizes))).first()
    return int(row[0] or 0)


def if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a written table for broadcast when its measured bytes are within ``max_bytes``.

    Beyond the bound it is left as it is, and the join is shuffled (AQE splits hot keys).
    """
    return F.broadcast(df) if value_bytes(df) <= max_bytes else df


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Equal in all ``names``, where null equals null."""
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])
