"""Overlapping frames of live sample streams and their spectra.

A frame is a sliding event-time window of length L that starts every hop H, cut into ``slots`` equal slots. A slot's value
is the mean of its samples, zero where none fell into it, so irregular and missing samples make no difference to the
frame's shape. What a stream remembers of an open frame is a sum and a count per slot, whatever the sample rate. A
frame leaves the state, and gets its spectrum, when the watermark has passed its end; late samples within it count.
The same plan serves a batch, where every frame is closed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F


def frames(samples: DataFrame, device: str, ts: str, sample: str, length: str, hop: str, slots: int = 16, late: str | None = None) -> DataFrame:
    """``device, frame_start, n, y``: slot values of every frame (of every closed frame of a stream).

    Null samples and null instants count for nothing. ``ts`` is a timestamp with time zone.
    """
    if samples.isStreaming:
        samples = samples.withWatermark(ts, late or "0 seconds")
    rows = samples.where(F.col(sample).isNotNull() & F.col(ts).isNotNull()).withColumn("__frame", F.window(ts, length, hop))
    start, end = F.unix_micros("__frame.start"), F.unix_micros("__frame.end")
    slot = F.floor((F.unix_micros(F.col(ts)) - start) * slots / (end - start))
    cells = [F.avg(F.when(slot == i, F.col(sample))).alias(f"__s{i}") for i in range(slots)]
    grouped = rows.groupBy(device, "__frame").agg(F.count("*").alias("n"), *cells)
    y = F.array(*[F.coalesce(F.col(f"__s{i}"), F.lit(0.0)) for i in range(slots)])
    return grouped.select(device, F.col("__frame.start").alias("frame_start"), "n", y.alias("y"))


def magnitudes(y: Column, slots: int) -> Column:
    """Magnitude spectrum of a Hann-windowed frame: bins 0 to half the slots."""
    hann = [0.5 - 0.5 * math.cos(2 * math.pi * i / (slots - 1)) for i in range(slots)]

    def part(k: int, wave) -> Column:
        basis = F.array(*[F.lit(hann[i] * wave(2 * math.pi * k * i / slots)) for i in range(slots)])
        return F.aggregate(F.zip_with(y, basis, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)

    return F.array(*[F.sqrt(F.pow(part(k, math.cos), 2) + F.pow(part(k, math.sin), 2)) for k in range(slots // 2 + 1)])


def spectra(framed: DataFrame, device: str, slots: int = 16) -> DataFrame:
    """RMS of the slots, spectral centroid in bins and the strongest bin of every frame."""
    told = framed.withColumn("m", magnitudes(F.col("y"), slots))
    total = F.aggregate("m", F.lit(0.0), lambda a, b: a + b)
    moment = F.aggregate(F.transform("m", lambda m, i: m * i), F.lit(0.0), lambda a, b: a + b)
    rms = F.sqrt(F.aggregate(F.transform("y", lambda v: v * v), F.lit(0.0), lambda a, b: a + b) / slots)
    strongest = F.array_position(F.transform("m", lambda m: F.round(m, 9)), F.round(F.array_max("m"), 9)) - 1
    return told.select(device, "frame_start", "n", rms.alias("rms"), (moment / F.greatest(total, F.lit(1e-10))).alias("centroid"), strongest.cast("int").alias("strongest"))
