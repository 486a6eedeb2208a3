"""Waveform arithmetic on array columns.

Everything here is higher-order array functions: one row stays one row, so
there is no shuffle, and no Python worker is started.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# Level floor, gate thresholds, messages, gain and framing.
LEVEL_FLOOR = 1e-8
CLIP_LEVEL = 0.99
SILENCE_SECONDS = 0.05
SILENCE_RMS = 0.004
GAIN_FROM, GAIN_TO, GAIN_TARGET = 0.001, 0.25, 0.65
MAX_SECONDS = 30
FRAME_LENGTH, HOP_LENGTH = 2048, 512
ISSUE_SHORT = "Recording is short; capture 2–6 seconds of cough."
ISSUE_QUIET = "Signal level is quiet; auto-gain boosted for analysis."
ISSUE_CLIPPING = "Audio is clipping; move slightly away from the microphone."
ISSUE_SILENCE = "Noticeable silence in recording."
ISSUE_LONG = "Only the first 30 seconds were analysed."


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body`` (array lambdas re-evaluate free expressions)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, total(values) / F.size(values))


def var_pop(values: Column) -> Column:
    return let(mean(values), lambda m: mean(F.transform(values, lambda x: (x - m) * (x - m))))


def root_mean_square(y: Column) -> Column:
    return F.sqrt(F.try_divide(F.aggregate(y, F.lit(0.0), lambda s, x: s + x * x), F.size(y)))


def peak(y: Column) -> Column:
    return F.array_max(F.transform(y, lambda x: F.abs(x)))


def decibels(rms: Column) -> Column:
    return 20 * F.log10(F.greatest(rms, F.lit(LEVEL_FLOOR)))


def share(values: Column, test: Callable[[Column], Column]) -> Column:
    return F.try_divide(F.size(F.filter(values, test)), F.size(values))


def clipping_ratio(y: Column, level: float = CLIP_LEVEL) -> Column:
    return share(y, lambda x: F.abs(x) >= level)


def ramp(count: Column) -> Column:
    """0 .. count-1, empty for count = 0 (``sequence`` would count down)."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def silence_ratio(y: Column, frame: Column, quiet: float = SILENCE_RMS) -> Column:
    """Share of whole non-overlapping frames whose RMS is below ``quiet``; 1.0 without a whole frame."""
    blocks = F.floor(F.size(y) / frame).cast("int")
    levels = F.transform(ramp(blocks), lambda b: root_mean_square(F.slice(y, b * frame + 1, frame)))
    return F.when(blocks > 0, share(levels, lambda r: r < quiet)).otherwise(1.0)


def silence_frame(sample_rate: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(sample_rate * SILENCE_SECONDS).cast("int"))


def downmix(channels: Column) -> Column:
    """Mean over channels (array of equally long channels)."""
    first = F.transform(F.element_at(channels, 1), lambda x: F.lit(0.0))
    summed = F.aggregate(channels, first, lambda a, c: F.zip_with(a, c, lambda p, q: p + q))
    return F.transform(summed, lambda x: x / F.size(channels))


def without_nan(y: Column) -> Column:
    return F.transform(y, lambda x: F.when(x.isNull() | F.isnan(x), 0.0).otherwise(x))


def scale_integers(y: Column) -> Column:
    """Samples beyond full scale are 16-bit integers."""
    return let(peak(y), lambda p: F.transform(y, lambda x: F.when(p > 1.0, x / 32768.0).otherwise(x)))


def auto_gain(y: Column) -> Column:
    """Raise quiet recordings to a fixed peak."""
    return let(
        peak(y),
        lambda p: F.when((p > GAIN_FROM) & (p < GAIN_TO), F.transform(y, lambda x: x * (GAIN_TARGET / p))).otherwise(y),
    )


def trim(y: Column, samples: Column) -> Column:
    return F.slice(y, F.lit(1), samples)


def pad(y: Column, length: int) -> Column:
    """Zeros on the right up to ``length``."""
    missing = F.greatest(F.lit(length) - F.size(y), F.lit(0))
    return F.concat(y, F.array_repeat(F.lit(0.0), missing))


def frame_count(y: Column, length: int, hop: int) -> Column:
    return (F.floor((F.greatest(F.size(y), F.lit(length)) - length) / hop) + 1).cast("int")


def frames(y: Column, length: int = FRAME_LENGTH, hop: int = HOP_LENGTH) -> Column:
    """Overlapping frames, the signal padded to one frame if shorter."""
    return let(pad(y, length), lambda s: F.transform(ramp(frame_count(s, length, hop)), lambda f: F.slice(s, f * hop + 1, F.lit(length))))


def _negative(x: Column) -> Column:
    return (x < 0) | ((x == 0) & (x.cast("string") == "-0.0"))


def zero_crossing_rates(framed: Column) -> Column:
    """Sign changes between neighbours of each frame over (length - 1)."""

    def one(frame: Column) -> Column:
        n = F.size(frame)
        pairs = F.zip_with(F.slice(frame, F.lit(1), n - 1), F.slice(frame, F.lit(2), n - 1), lambda a, b: _negative(a) != _negative(b))
        return share(pairs, lambda changed: changed)

    return F.transform(framed, one)


def frame_levels(framed: Column) -> Column:
    return F.transform(framed, root_mean_square)


def envelope(y: Column, width: int) -> Column:
    """Array of (bucket, low, high, peak) for ``width`` buckets of equal sample count."""
    step = F.ceil(F.size(y) / width).cast("int")

    def bucket(b: Column) -> Column:
        part = F.slice(y, b * step + 1, step)
        return F.struct(b.alias("bucket"), F.array_min(part).alias("low"), F.array_max(part).alias("high"), peak(part).alias("peak"))

    filled = F.ceil(F.size(y) / step).cast("int")
    return F.transform(ramp(filled), bucket)


def level_band(level: Column, high: float, low: float) -> Column:
    return F.when(level > high, "high").when(level > low, "medium").otherwise("low")


@dataclass(frozen=True)
class GateLimits:
    """Thresholds of the quality gate."""

    short_seconds: float = 0.7
    quiet_rms: float = 0.002
    quiet_peak: float = 0.01
    clipping: float = 0.02
    silence: float = 0.9
    long_seconds: float = 25.0
    dead_seconds: float = 0.05
    dead_peak: float = 1e-6
    clip_level: float = CLIP_LEVEL
    silence_rms: float = SILENCE_RMS


def quality_measures(df, y: str = "y", sample_rate: str = "sr", limits: GateLimits = GateLimits(), silence_samples: int | None = None):
    """Add duration, rms, dbfs, peak, clipping_ratio and silence_ratio."""
    samples, rate = F.col(y), F.col(sample_rate)
    frame = F.lit(silence_samples) if silence_samples else silence_frame(rate)
    return df.withColumns(
        {
            "duration": F.size(samples) / rate,
            "rms": root_mean_square(samples),
            "peak": peak(samples),
            "clipping_ratio": clipping_ratio(samples, limits.clip_level),
            "silence_ratio": silence_ratio(samples, frame, limits.silence_rms),
        }
    ).withColumn("dbfs", decibels(F.col("rms")))


def quality_gate(df, limits: GateLimits = GateLimits()):
    """Add issues, blocking and status to a frame with the quality measures."""
    c = F.col
    tests = [
        (c("duration") < limits.short_seconds, ISSUE_SHORT),
        ((c("rms") < limits.quiet_rms) & (c("peak") < limits.quiet_peak), ISSUE_QUIET),
        (c("clipping_ratio") > limits.clipping, ISSUE_CLIPPING),
        (c("silence_ratio") > limits.silence, ISSUE_SILENCE),
        (c("duration") > limits.long_seconds, ISSUE_LONG),
    ]
    issues = F.filter(F.array(*[F.when(t, F.lit(m)) for t, m in tests]), lambda m: m.isNotNull())
    blocking = F.coalesce((c("duration") <= limits.dead_seconds) | (c("peak") < limits.dead_peak), F.lit(True))
    return df.withColumn("issues", issues).withColumn("blocking", blocking).withColumn(
        "status", F.when(c("blocking"), "poor").when(F.size("issues") > 0, "review").otherwise("good")
    )
