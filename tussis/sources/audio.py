"""PCM WAV decoding and the recording scan."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tussis.functions import signal as S
from tussis.functions.clean import stem

DECODED = T.StructType(
    [
        T.StructField("y", T.ArrayType(T.DoubleType())),
        T.StructField("sr", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ]
)

# WAV format tags and the full scale of each sample width.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
FULL_SCALE = {1: 128.0, 2: 32768.0, 3: 8388608.0, 4: 2147483648.0}


def _chunks(blob: bytes):
    if blob[:4] != b"RIFF" or blob[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(blob):
        name, size = blob[at : at + 4], struct.unpack_from("<I", blob, at + 4)[0]
        yield name, blob[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)


def _samples(data: bytes, tag: int, width: int) -> np.ndarray:
    if tag == FLOAT:
        return np.frombuffer(data, dtype=f"<f{width}").astype(np.float64)
    if tag != PCM or width not in FULL_SCALE:
        raise ValueError(f"unsupported WAV format {tag}/{8 * width} bit")
    if width == 1:
        whole = np.frombuffer(data, dtype=np.uint8).astype(np.float64) - 128.0
    elif width == 3:
        b = np.frombuffer(data, dtype=np.uint8).reshape(-1, 3).astype(np.int32)
        whole = ((b[:, 0] | (b[:, 1] << 8) | (b[:, 2] << 16)) ^ 0x800000) - 0x800000
    else:
        whole = np.frombuffer(data, dtype=f"<i{width}").astype(np.float64)
    return whole / FULL_SCALE[width]


def decode_wav(blob: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in [-1, 1] and the sample rate of one WAV file."""
    parts = dict(_chunks(blob))
    if b"fmt " not in parts or b"data" not in parts:
        raise ValueError("incomplete WAV file")
    tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", parts[b"fmt "])
    if tag == EXTENSIBLE:
        tag = struct.unpack_from("<H", parts[b"fmt "], 24)[0]
    width = bits // 8
    data = parts[b"data"]
    y = _samples(data[: len(data) - len(data) % (width * channels)], tag, width).reshape(-1, channels).mean(axis=1)
    if y.size == 0:
        raise ValueError("the recording is empty")
    return np.nan_to_num(y), int(rate)


def encode_wav(samples, sample_rate: int) -> bytes:
    """16-bit mono WAV bytes."""
    data = np.round(np.clip(samples, -1.0, 32767 / 32768) * 32768).astype("<i2").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, PCM, 1, sample_rate, 2 * sample_rate, 2, 16, b"data", len(data))
    return head + data


@F.pandas_udf(DECODED)
def _decode_wav_column(content: pd.Series) -> pd.DataFrame:
    rows = []
    for blob in content:
        try:
            y, rate = decode_wav(bytes(blob))
            rows.append((y, rate, None))
        except Exception as exc:  # a bad file becomes a quarantine row
            rows.append((None, None, str(exc)))
    return pd.DataFrame({"y": [r[0] for r in rows], "sr": pd.array([r[1] for r in rows], dtype="Int32"), "error": [r[2] for r in rows]})


# Filters on the result must not be pushed below the decoder: that would decode twice.
decode_wav_column = _decode_wav_column.asNondeterministic()


def encode_wav_column(samples: Column, sample_rate: int) -> Column:
    @F.pandas_udf(T.BinaryType())
    def run(y: pd.Series) -> pd.Series:
        return y.map(lambda v: encode_wav(np.asarray(v, dtype=np.float64), sample_rate))

    return run(samples)


def decode_recordings(files: DataFrame, keep: list[str], max_seconds: int | None = S.MAX_SECONDS, gain: bool = True) -> tuple[DataFrame, DataFrame]:
    """(recordings, quarantined) from a frame with a binary ``content`` column.

    Recordings carry ``y`` and ``sr``; gain and the length cap are arguments.
    """
    decoded = files.select(*keep, decode_wav_column("content").alias("d")).select(*keep, "d.*")
    y = F.col("y")
    y = S.auto_gain(y) if gain else y
    y = S.trim(y, F.col("sr") * max_seconds) if max_seconds else y
    good = decoded.where("error IS NULL").select(*keep, y.alias("y"), "sr")
    return good, decoded.where("error IS NOT NULL").select(*keep, "error")


def list_recordings(spark: SparkSession, folder: str) -> DataFrame:
    """Paths and sizes of a folder; file contents are not read."""
    return spark.read.format("binaryFile").load(folder).select("path", "length", "modificationTime")


def read_recordings(spark: SparkSession, folder: str, **options) -> tuple[DataFrame, DataFrame]:
    """Decode every WAV file of a folder, one task per slice of files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder)
    return decode_recordings(files.select(stem(F.col("path")).alias("file_id"), "content"), ["file_id"], **options)
