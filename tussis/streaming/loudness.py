"""Per-frame loudness of live sample streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Centre and scale of byte samples, level of silence, band limits.
BYTE_CENTRE, BYTE_SCALE = 128.0, 128.0
SILENT_DBFS = -90.0
BAND_HIGH, BAND_LOW = 0.4, 0.15


def from_byte(value: Column) -> Column:
    return (value - BYTE_CENTRE) / BYTE_SCALE


def peak_dbfs(peak: Column) -> Column:
    return F.when(peak > 0, F.round(20 * F.log10(peak), 1)).otherwise(SILENT_DBFS)


def loudness(samples: DataFrame, device: str, ts: str, sample: str, frame: str, late: str | None = None) -> DataFrame:
    """RMS, peak and dBFS per device and frame; the same plan for batch and stream.

    ``late`` sets the watermark, which lets a stream drop closed frames from its state.
    """
    if late and samples.isStreaming:
        samples = samples.withWatermark(ts, late)
    x = F.col(sample)
    frames = samples.groupBy(device, F.window(ts, frame).alias("frame")).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(x * x)).alias("rms"), F.max(F.abs(x)).alias("peak")
    )
    return frames.select(device, F.col("frame.start").alias("frame_start"), "n", "rms", "peak", peak_dbfs(F.col("peak")).alias("dbfs"))
