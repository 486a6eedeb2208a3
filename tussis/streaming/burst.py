"""Burst detection with a refractory time, as a batch job and as a stream.

A burst fires when the level exceeds a threshold and the last burst is more
than the refractory time ago. That depends on the whole past of a device, but
the dependence is short: a fire cannot block anything later than the
refractory time. The batch job therefore cuts a device's time line into chunks
longer than that, works out what each chunk would hand on for every state it
could be handed, chains only those small answers by doubling steps, and then replays all
chunks at once. No task holds the time line of a device.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tussis.session import durable
from tussis.streaming.common import epoch_micros

# Trigger level and refractory time.
BURST_LEVEL = 0.42
REFRACTORY_MS = 300
CHUNKS_PER_REFRACTORY = 1000


#: State of a chunk after which nothing is blocked; so early that no instant is near it.
NONE = -(1 << 62)


def _exits(times: Column, n_firsts: Column, gap: int) -> Column:
    """Last fire of a chunk for each of its first ``n_firsts`` instants as the first fire.

    The next fire after an instant is the first one beyond the refractory time, so all starts walk on together.
    """

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def walk(lists: pd.Series, counts: pd.Series) -> pd.Series:
        out = []
        for values, n in zip(lists, counts):
            t = np.asarray(values, dtype=np.int64)
            following = np.append(np.searchsorted(t, t + gap, side="right"), len(t))
            at = np.arange(int(n))
            ahead = following[at]
            while (ahead < len(t)).any():
                at = np.where(ahead < len(t), ahead, at)
                ahead = following[at]
            out.append(t[at])
        return pd.Series(out, dtype=object)

    return walk(times, n_firsts)


def _handed_on(first_times: Column, exits: Column, entry: Column) -> Column:
    """Exit state of a chunk for one entry state; the gap is added to ``first_times`` already."""
    blocked = F.size(F.filter(first_times, lambda t: t <= entry))
    return F.when(blocked < F.size(exits), F.get(exits, blocked)).otherwise(NONE)


def bursts(df: DataFrame, device: str, ts: str, level: str, threshold: float = BURST_LEVEL,
           refractory_ms: int = REFRACTORY_MS, chunk_ms: int | None = None) -> DataFrame:
    """(device, fired_at) in epoch microseconds.

    A chunk holds the distinct candidate instants of one device in
    ``chunk_ms``; choose it by how fine the clock of the recordings is.
    """
    gap = refractory_ms * 1000
    width = (chunk_ms or refractory_ms * CHUNKS_PER_REFRACTORY) * 1000
    if width <= gap:
        raise ValueError("a chunk must be longer than the refractory time")

    candidates = df.where(F.col(level) > threshold).select(device, epoch_micros(df, ts).alias("t"))
    chunks = durable(
        candidates.withColumn("chunk", F.floor(F.col("t") / width)).groupBy(device, "chunk").agg(F.array_sort(F.collect_set("t")).alias("times"))
    )

    # What a chunk hands on, for each candidate that could be its first fire.
    opening = F.filter("times", lambda t: t <= F.col("chunk") * width + gap)
    n_firsts = F.least(F.size(opening) + 1, F.size("times"))
    next_start = (F.col("chunk") + 1) * width
    answers = chunks.select(
        device, "chunk", F.transform(F.slice("times", F.lit(1), n_firsts), lambda t: t - gap).alias("firsts"),
        _exits(F.col("times"), n_firsts, gap).alias("reach"), (F.size(opening) == F.size("times")).alias("may_skip"),
    )
    # A fire too early to block the next chunk is the same as none.
    answers = answers.withColumn("exits", F.transform("reach", lambda x: F.when(x + gap >= next_start, x).otherwise(NONE)))
    outs = F.array_distinct(F.concat("exits", F.when(F.col("may_skip"), F.array(F.lit(NONE))).otherwise(F.array().cast("array<bigint>"))))
    answers = durable(answers.select(device, "chunk", "firsts", "exits", outs.alias("outs")))

    entries = _entries(answers, device)
    # Replay every chunk from its entry state.
    def replay(s: Column, t: Column) -> Column:
        fires = t - s["last"] > gap
        return F.struct(
            F.when(fires, t).otherwise(s["last"]).alias("last"),
            F.when(fires, F.concat(s["fired"], F.array(t))).otherwise(s["fired"]).alias("fired"),
        )

    begin = F.struct(F.col("entry").alias("last"), F.array().cast("array<bigint>").alias("fired"))
    fired = F.aggregate("times", begin, replay, lambda s: s["fired"])
    return chunks.join(entries, [device, "chunk"]).select(device, F.explode(fired).alias("fired_at"))


def _entries(answers: DataFrame, device: str) -> DataFrame:
    """(device, chunk, entry): the state each chunk is handed.

    A state is known after a gap in the chunks and after a chunk that hands on the same whatever it gets. From there, states
    lead on chunk by chunk. Steps of one chunk are joined to steps of two, four and so on until none is
    left, then the known states follow the longest steps first. Rows are keyed by device and chunk throughout, and the
    number of rounds is the logarithm of the longest stretch of open chunks.
    """
    key = [device, "chunk"]
    before = answers.select(device, (F.col("chunk") + 1).alias("chunk"), F.col("outs").alias("given"))
    after = answers.select(device, (F.col("chunk") - 1).alias("chunk"))
    led = answers.join(before, key, "left")
    open_ = F.coalesce(F.size("given") > 1, F.lit(False))
    known = led.where(~open_).select(*key, F.coalesce(F.get("given", F.lit(0)), F.lit(NONE)).alias("entry"), "firsts", "exits", "outs")
    guessed = led.where(open_).select(*key, F.explode("given").alias("entry"), "firsts", "exits", "outs")
    states = known.unionByName(guessed).where(F.size("outs") > 1).join(after, key, "left_semi")
    steps = [durable(states.select(*key, "entry", (F.col("chunk") + 1).alias("to_chunk"), _handed_on(F.col("firsts"), F.col("exits"), F.col("entry")).alias("to_entry")))]
    while not steps[-1].isEmpty():
        one = steps[-1]
        two = one.select(device, F.col("chunk").alias("to_chunk"), F.col("entry").alias("to_entry"), F.col("to_chunk").alias("far_chunk"), F.col("to_entry").alias("far_entry"))
        steps.append(durable(one.join(two, [device, "to_chunk", "to_entry"]).select(*key, "entry", F.col("far_chunk").alias("to_chunk"), F.col("far_entry").alias("to_entry"))))
    reached = known.select(*key, "entry")
    for step in reversed(steps[:-1]):
        further = reached.join(step, [*key, "entry"]).select(device, F.col("to_chunk").alias("chunk"), F.col("to_entry").alias("entry"))
        reached = durable(reached.unionByName(further))
    return reached


def burst_stream(stream: DataFrame, device: str, ts: str, level: str, threshold: float = BURST_LEVEL,
                 refractory_ms: int = REFRACTORY_MS, late: str | None = None) -> DataFrame:
    """The streaming twin: one remembered fire per device.

    Without ``late`` every micro-batch is taken in time order as it arrives.
    With it, candidates wait in the state until the watermark has passed them,
    so files that arrive out of order give the same bursts.
    """
    gap = refractory_ms * 1000
    kind = dict(stream.dtypes)[device]
    candidates = stream.where(F.col(level) > threshold).select(device, epoch_micros(stream, ts).alias("t"))
    candidates = candidates.withColumn("ts", F.timestamp_micros("t"))
    if late:
        candidates = candidates.withWatermark("ts", late)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = state.get if state.exists else (None, [])
        arrived = [t for pdf in batches for t in pdf["t"].tolist()]
        waiting = sorted({*waiting, *arrived})
        ready = waiting
        if late:
            mark = state.getCurrentWatermarkMs() * 1000
            ready = [t for t in waiting if t <= mark]
            waiting = waiting[len(ready):]
        else:
            waiting = []
        fired = []
        for t in ready:
            if last is None or t - last > gap:
                last = t
                fired.append(t)
        state.update((last, waiting))
        if late and waiting:
            state.setTimeoutTimestamp(max(waiting[0] // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({device: [key[0]] * len(fired), "fired_at": fired}, columns=[device, "fired_at"])

    timeout = GroupStateTimeout.EventTimeTimeout if late else GroupStateTimeout.NoTimeout
    return candidates.groupBy(device).applyInPandasWithState(
        step, f"{device} {kind}, fired_at BIGINT", "last BIGINT, waiting ARRAY<BIGINT>", "append", timeout
    )
