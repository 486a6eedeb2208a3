"""Bulk extraction: decode, measure and extract features in one Python pass per recording.

Samples never travel back to the JVM: a task receives the bytes of a recording
and returns a few dozen numbers. The gate itself is the same column expression
as for decoded signals.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tussis.functions import signal as S, spectral as X
from tussis.sources.audio import decode_wav

MEASURES = ["duration", "rms", "peak", "clipping_ratio", "silence_ratio", "dbfs"]


def measures_of(y: np.ndarray, rate: int, limits: S.GateLimits, silence_samples: int | None) -> list[float]:
    """Quality measures of one recording, in ``MEASURES`` order."""
    level = float(np.sqrt(np.mean(y**2)))
    frame = silence_samples or max(1, int(rate * S.SILENCE_SECONDS))
    whole = y[: y.size - y.size % frame].reshape(-1, frame)
    quiet = float(np.mean(np.sqrt(np.mean(whole**2, axis=1)) < limits.silence_rms)) if len(whole) else 1.0
    loud = float(np.mean(np.abs(y) >= limits.clip_level))
    return [y.size / rate, level, float(np.max(np.abs(y))), loud, quiet, 20 * float(np.log10(max(level, S.LEVEL_FLOOR)))]


def _conditioned(y: np.ndarray, rate: int, gain: bool, max_seconds: int | None) -> np.ndarray:
    top = float(np.max(np.abs(y)))
    if gain and S.GAIN_FROM < top < S.GAIN_TO:
        y = y * (S.GAIN_TARGET / top)
    return y[: int(rate * max_seconds)] if max_seconds else y


def analysis_struct(content: Column, spec: X.FrameSpec, limits: S.GateLimits, gain: bool, max_seconds: int | None, silence_samples: int | None) -> Column:
    """Struct of error, sample rate, measures and features for WAV bytes."""
    names = X.feature_names(spec)
    numbers = [*MEASURES, *names]
    kind = T.StructType(
        [T.StructField("error", T.StringType()), T.StructField("sr", T.IntegerType()), *[T.StructField(n, T.DoubleType()) for n in numbers]]
    )

    def one(blob) -> list:
        try:
            y, rate = decode_wav(bytes(blob))
            y = _conditioned(y, rate, gain, max_seconds)
            measures = measures_of(y, rate, limits, silence_samples)
            dead = measures[0] <= limits.dead_seconds or measures[2] < limits.dead_peak
            features = [None] * len(names) if dead else X.summary_vector(y, float(rate), spec).tolist()
            return [None, rate, *measures, *features]
        except Exception as exc:  # a bad file becomes a row with an error
            return [str(exc), None, *[None] * len(numbers)]

    @F.pandas_udf(kind)
    def run(blobs: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([one(b) for b in blobs], columns=kind.names)
        out["sr"] = out["sr"].astype("Int32")
        out[numbers] = out[numbers].astype("float64")
        return out

    # Filters on the result must stay above the UDF, or it would run twice.
    return run.asNondeterministic()(content)


def analyse(
    files: DataFrame,
    keep: list[str],
    spec: X.FrameSpec = X.FrameSpec(),
    limits: S.GateLimits = S.GateLimits(),
    gain: bool = True,
    max_seconds: int | None = S.MAX_SECONDS,
    silence_samples: int | None = None,
) -> DataFrame:
    """``keep`` columns, error, measures, gate result and features per file.

    Undecodable files carry their error; blocked recordings have no features.
    """
    analysed = files.select(*keep, analysis_struct(F.col("content"), spec, limits, gain, max_seconds, silence_samples).alias("a"))
    return S.quality_gate(analysed.select(*keep, "a.*"), limits)
