"""Spectra and cepstra.

The FFT and the two matrix products run in Arrow UDFs, one NumPy call per
recording over all its frames. Everything downstream of a spectrum is array
arithmetic in the JVM, and ``feature_struct`` computes all summary features of
a recording in a single UDF for bulk extraction.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from tussis.functions.signal import FRAME_LENGTH, HOP_LENGTH, let, total

# Filter bank, cepstrum size, floors, rolloff share, chroma range.
N_MELS = 128
N_MFCC = 20
POWER_FLOOR = 1e-10
ROLLOFF_SHARE = 0.85
CHROMA_LOW_HZ = 27.5
TUNING_HZ = 440.0
PITCH_CLASSES = 12

SUMMARIES = ["zero_crossing_rate", "spectral_centroid", "spectral_bandwidth", "spectral_rolloff", "chroma", "rms"]
MATRIX = T.ArrayType(T.ArrayType(T.DoubleType()))


@dataclass(frozen=True)
class FrameSpec:
    """Framing, filter bank and cepstrum sizes."""

    length: int = FRAME_LENGTH
    hop: int = HOP_LENGTH
    n_mels: int = N_MELS
    n_mfcc: int = N_MFCC

    @property
    def bins(self) -> int:
        return self.length // 2 + 1


def feature_names(spec: FrameSpec = FrameSpec()) -> list[str]:
    cepstra = [f"mfcc_{i + 1}_{s}" for s in ("mean", "var") for i in range(spec.n_mfcc)]
    return cepstra + [f"{n}_{s}" for n in SUMMARIES for s in ("mean", "var")]


def mfcc_names(spec: FrameSpec = FrameSpec()) -> list[str]:
    return feature_names(spec)[: 2 * spec.n_mfcc]


# -- NumPy helpers, used inside tasks ---------------------------------------


def frame_matrix(y, length: int, hop: int) -> np.ndarray:
    y = np.asarray(y, dtype=np.float64)
    if y.size < length:
        y = np.concatenate([y, np.zeros(length - y.size)])
    return np.lib.stride_tricks.sliding_window_view(y, length)[::hop]


def magnitudes(framed: np.ndarray) -> np.ndarray:
    """frames x bins magnitude spectrum under a symmetric Hann window."""
    return np.abs(np.fft.rfft(framed * np.hanning(framed.shape[1]), axis=1))


@lru_cache(maxsize=32)
def mel_filters(sample_rate: float, length: int, n_mels: int) -> np.ndarray:
    """n_mels x bins triangular filters with integer bin edges on the HTK scale."""
    bins = length // 2 + 1
    top = 2595.0 * np.log10(1.0 + sample_rate / 2.0 / 700.0)
    hertz = 700.0 * (10.0 ** (np.linspace(0.0, top, n_mels + 2) / 2595.0) - 1.0)
    edge = np.clip(np.floor((length + 1) * hertz / sample_rate).astype(int), 0, bins - 1)
    left, centre, right = (edge[i : i + n_mels, None] for i in range(3))
    k = np.arange(bins)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        rising = np.where((k >= left) & (k < centre), (k - left) / (centre - left), 0.0)
        falling = np.where((k >= centre) & (k < right), (right - k) / (right - centre), 0.0)
    return rising + falling


@lru_cache(maxsize=32)
def cosine_basis(n_in: int, n_out: int) -> np.ndarray:
    """Orthonormal DCT-II rows."""
    k, j = np.arange(n_out)[:, None], np.arange(n_in)[None, :]
    basis = np.cos(np.pi * k * (2 * j + 1) / (2 * n_in)) * np.sqrt(2.0 / n_in)
    basis[0] /= np.sqrt(2.0)
    return basis


@lru_cache(maxsize=32)
def pitch_class_matrix(sample_rate: float, length: int) -> np.ndarray:
    """bins x 12 indicator of the pitch class of each bin."""
    hertz = np.fft.rfftfreq(length, d=1.0 / sample_rate)
    out = np.zeros((hertz.size, PITCH_CLASSES))
    audible = np.flatnonzero(hertz >= CHROMA_LOW_HZ)
    note = np.rint(12 * np.log2(hertz[audible] / TUNING_HZ) + 69).astype(int) % PITCH_CLASSES
    out[audible, note] = 1.0
    return out


def mel_power_of(mag: np.ndarray, sample_rate: float, spec: FrameSpec) -> np.ndarray:
    return np.maximum((mag**2) @ mel_filters(float(sample_rate), spec.length, spec.n_mels).T, POWER_FLOOR)


def mfcc_of(mel_power: np.ndarray, spec: FrameSpec) -> np.ndarray:
    return 10.0 * np.log10(mel_power) @ cosine_basis(spec.n_mels, spec.n_mfcc).T


def summary_vector(y, sample_rate: float, spec: FrameSpec) -> np.ndarray:
    """All summary features of one recording, in ``feature_names`` order."""
    framed = frame_matrix(y, spec.length, spec.hop)
    mag = magnitudes(framed)
    hertz = np.fft.rfftfreq(spec.length, d=1.0 / sample_rate)
    weight = np.maximum(mag.sum(axis=1), POWER_FLOOR)

    cepstra = mfcc_of(mel_power_of(mag, sample_rate, spec), spec)
    centroid = mag @ hertz / weight
    spread = np.sqrt(((hertz[None, :] - centroid[:, None]) ** 2 * mag).sum(axis=1) / weight)
    running = np.cumsum(mag, axis=1)
    rolloff = hertz[np.argmax(running >= ROLLOFF_SHARE * running[:, -1:], axis=1)]
    chroma = mag @ pitch_class_matrix(float(sample_rate), spec.length)
    chroma = chroma / np.maximum(chroma.sum(axis=1, keepdims=True), POWER_FLOOR)
    crossings = np.mean(np.diff(np.signbit(framed), axis=1), axis=1)
    level = np.sqrt(np.mean(framed**2, axis=1))

    tracks = [crossings, centroid, spread, rolloff, chroma, level]
    pairs = [stat for track in tracks for stat in (np.mean(track), np.var(track))]
    return np.concatenate([cepstra.mean(axis=0), cepstra.var(axis=0), pairs])


# -- Arrow UDFs ---------------------------------------------------------------


def _rows(matrix: np.ndarray) -> list:
    return list(matrix)


def magnitude_spectrum(y: Column, length: int = FRAME_LENGTH, hop: int = HOP_LENGTH) -> Column:
    """frames x bins magnitudes as an array of arrays."""

    @F.pandas_udf(MATRIX)
    def run(samples: pd.Series) -> pd.Series:
        return samples.map(lambda v: _rows(magnitudes(frame_matrix(v, length, hop))))

    return run(y)


def mel_power(spectrum: Column, sample_rate: Column, spec: FrameSpec = FrameSpec()) -> Column:
    """frames x mels power from a magnitude spectrum, floored."""

    @F.pandas_udf(MATRIX)
    def run(mag: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series([_rows(mel_power_of(np.stack(m), r, spec)) for m, r in zip(mag, rate)])

    return run(spectrum, sample_rate)


def mfcc(mel: Column, spec: FrameSpec = FrameSpec()) -> Column:
    """frames x coefficients from mel power."""

    @F.pandas_udf(MATRIX)
    def run(power: pd.Series) -> pd.Series:
        return power.map(lambda p: _rows(mfcc_of(np.stack(p), spec)))

    return run(mel)


def feature_struct(y: Column, sample_rate: Column, spec: FrameSpec = FrameSpec()) -> Column:
    """Struct of every summary feature, one UDF call per Arrow batch of recordings."""
    names = feature_names(spec)
    kind = T.StructType([T.StructField(n, T.DoubleType()) for n in names])

    @F.pandas_udf(kind)
    def run(samples: pd.Series, rate: pd.Series) -> pd.DataFrame:
        vectors = [summary_vector(v, float(r), spec) for v, r in zip(samples, rate)]
        return pd.DataFrame(np.array(vectors).reshape(-1, len(names)), columns=names)

    return run(y, sample_rate)


# -- Array arithmetic on spectra, in the JVM ----------------------------------


def bin_hertz(sample_rate: Column, length: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(length // 2)), lambda k: k * sample_rate / length)


def log_power(power: Column) -> Column:
    return F.transform(power, lambda row: F.transform(row, lambda p: 10 * F.log10(F.greatest(p, F.lit(POWER_FLOOR)))))


def _weighted(mag: Column, weights: Column) -> Column:
    return total(F.zip_with(mag, weights, lambda m, w: m * w))


def _weight(mag: Column) -> Column:
    return F.greatest(total(mag), F.lit(POWER_FLOOR))


def centroids(spectrum: Column, hertz: Column) -> Column:
    return let(hertz, lambda f: F.transform(spectrum, lambda m: _weighted(m, f) / _weight(m)))


def bandwidths(spectrum: Column, hertz: Column) -> Column:
    def one(m: Column, f: Column) -> Column:
        return let(
            _weighted(m, f) / _weight(m),
            lambda c: F.sqrt(total(F.zip_with(m, f, lambda a, h: (h - c) * (h - c) * a)) / _weight(m)),
        )

    return let(hertz, lambda f: F.transform(spectrum, lambda m: one(m, f)))


def rolloffs(spectrum: Column, hertz: Column, share: float = ROLLOFF_SHARE) -> Column:
    """Frequency of the first bin at which the running sum reaches ``share`` of the total."""

    def one(m: Column, f: Column) -> Column:
        def first_bin(limit: Column) -> Column:
            start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at"))

            def step(s: Column, x: Column) -> Column:
                running = s["sum"] + x
                return F.struct(running.alias("sum"), (s["at"] + F.when(running < limit, 1).otherwise(0)).alias("at"))

            return F.element_at(f, F.aggregate(m, start, step, lambda s: s["at"]) + 1)

        return let(total(m) * share, first_bin)

    return let(hertz, lambda f: F.transform(spectrum, lambda m: one(m, f)))


def chroma(spectrum: Column, hertz: Column) -> Column:
    """frames x 12 share of magnitude per pitch class."""

    def note(h: Column) -> Column:
        audible = F.pmod(F.rint(12 * F.log2(h / TUNING_HZ) + 69), F.lit(float(PITCH_CLASSES)))
        return F.when(h >= CHROMA_LOW_HZ, audible).otherwise(-1.0)

    def one(m: Column, notes: Column) -> Column:
        sums = F.transform(
            F.sequence(F.lit(0), F.lit(PITCH_CLASSES - 1)),
            lambda c: total(F.zip_with(m, notes, lambda a, n: F.when(n == c, a).otherwise(0.0))),
        )
        return let(sums, lambda s: F.transform(s, lambda x: x / _weight(s)))

    return let(F.transform(hertz, note), lambda notes: F.transform(spectrum, lambda m: one(m, notes)))


def column_track(matrix: Column, position: int) -> Column:
    """One coefficient over all frames."""
    return F.transform(matrix, lambda row: F.element_at(row, position + 1))


def power_density(y: Column, sample_rate: Column, length: int, hop: int) -> Column:
    """Array of frames of one-sided power density in dB."""
    energy = float(np.sum(np.hanning(length) ** 2))

    def one(m: Column, rate: Column) -> Column:
        last = length // 2
        return F.transform(
            m,
            lambda a, k: 10 * F.log10(F.greatest(a * a * F.when((k > 0) & (k < last), 2.0).otherwise(1.0) / (rate * energy), F.lit(POWER_FLOOR**2))),
        )

    return F.transform(magnitude_spectrum(y, length, hop), lambda m: one(m, sample_rate))
