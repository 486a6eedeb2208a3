"""Recordings meet what was entered for them, as two streams.

Either side may come first. Both keep a watermark, so a row waits for its partner only as long as an allowed time
difference plus lateness lets one come; then it leaves the state. A recording that no entry meets gets a row without entry, so that it is
screened on sound alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def met(recordings: DataFrame, entries: DataFrame, key: str, ts: str, within: str, late: str) -> DataFrame:
    """Every recording with the columns of each entry of the same key at most ``within`` before or after it, or with nulls.

    ``within`` and ``late`` are intervals. A null key meets nothing. Two entries in time give two rows, as a join does.
    The same plan serves two batches; of streams, rows without a partner come when the watermark has passed them.
    """
    if recordings.isStreaming:
        recordings, entries = recordings.withWatermark(ts, late), entries.withWatermark(ts, late)
    ours, theirs = recordings.alias("r"), entries.alias("e")
    span = F.expr(f"INTERVAL {within}")
    close = (F.col(f"e.{ts}") >= F.col(f"r.{ts}") - span) & (F.col(f"e.{ts}") <= F.col(f"r.{ts}") + span)
    both = ours.join(theirs, (F.col(f"r.{key}") == F.col(f"e.{key}")) & close, "left_outer")
    extra = [c for c in entries.columns if c not in (key, ts)]
    return both.select("r.*", F.col(f"e.{ts}").alias("entered_at"), *[F.col(f"e.{c}") for c in extra])
