"""Tone, silence, WAV formats, and the two routes to the same features."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tussis.functions import signal as S, spectral as X
from tussis.sources import audio

RATE = 22050


def recording(spark, y, rate=RATE):
    return spark.createDataFrame([("a", [float(v) for v in y], rate)], "file_id STRING, y ARRAY<DOUBLE>, sr INT")


def gate(df):
    return S.quality_gate(S.quality_measures(df)).first()


def tone():
    return 0.12 * np.sin(2 * np.pi * 440 * np.arange(2 * RATE) / RATE)


def test_clear_tone_is_good(spark):
    q = gate(recording(spark, tone()).withColumn("y", S.auto_gain(F.col("y"))))
    assert (q["status"], q["blocking"], q["issues"]) == ("good", False, [])
    assert q["peak"] == pytest.approx(0.65, abs=1e-3) and q["rms"] == pytest.approx(0.46, abs=5e-3)


def test_silence_is_blocked(spark):
    q = gate(recording(spark, np.zeros(RATE)))
    assert (q["status"], q["blocking"], q["silence_ratio"]) == ("poor", True, 1.0)
    assert q["dbfs"] == pytest.approx(-160)


def test_short_clip_has_no_whole_frame(spark):
    q = gate(recording(spark, np.full(100, 0.5)))
    assert q["blocking"] and q["silence_ratio"] == 1.0


def test_issue_list_and_review(spark):
    q = gate(recording(spark, np.full(RATE // 2, 1.0)))
    assert (q["status"], q["issues"]) == ("review", [S.ISSUE_SHORT, S.ISSUE_CLIPPING])


def test_features_of_tone_and_short_signal(spark):
    names = X.feature_names()
    assert len(names) == 52
    for y in (tone(), tone()[:500]):
        row = recording(spark, y).select(X.feature_struct(F.col("y"), F.col("sr")).alias("f")).select("f.*").first()
        assert row["chroma_mean"] == pytest.approx(1 / 12)
        assert all(np.isfinite(row[n]) for n in names)
    assert row["rms_var"] == 0.0


def test_column_functions_equal_bulk_features(spark):
    rng = np.random.default_rng(0)
    spec = X.FrameSpec(length=64, hop=16, n_mels=12, n_mfcc=5)
    df = spark.createDataFrame([(i, rng.normal(0, 0.2, 400).tolist(), 8000) for i in range(4)], "i INT, y ARRAY<DOUBLE>, sr INT")
    df = df.withColumn("frames", S.frames(F.col("y"), 64, 16)).withColumn("mag", X.magnitude_spectrum(F.col("y"), 64, 16)).withColumn("hz", X.bin_hertz(F.col("sr"), 64))
    df = df.withColumn("cep", X.mfcc(X.mel_power(F.col("mag"), F.col("sr"), spec), spec))
    mag, hz = F.col("mag"), F.col("hz")
    tracks = {
        "zero_crossing_rate": S.zero_crossing_rates(F.col("frames")), "spectral_centroid": X.centroids(mag, hz), "spectral_bandwidth": X.bandwidths(mag, hz),
        "spectral_rolloff": X.rolloffs(mag, hz), "chroma": F.flatten(X.chroma(mag, hz)), "rms": S.frame_levels(F.col("frames")),
    }
    tracks |= {f"mfcc_{c + 1}": X.column_track(F.col("cep"), c) for c in range(5)}
    wide = df.select("i", *[t.alias(n) for n, t in tracks.items()])
    stats = wide.select("i", *[f(F.col(n)).alias(f"{n}_{s}") for n in tracks for s, f in (("mean", S.mean), ("var", S.var_pop))])
    bulk = df.select("i", X.feature_struct(F.col("y"), F.col("sr"), spec).alias("f")).select("i", "f.*")
    for a, b in zip(stats.orderBy("i").collect(), bulk.orderBy("i").collect()):
        for n in X.feature_names(spec):
            assert a[n] == pytest.approx(b[n], rel=1e-6, abs=1e-9), n


def wav(data: bytes, tag: int, channels: int, bits: int, rate: int = 8000) -> bytes:
    align = channels * bits // 8
    head = struct.pack("<4sIHHIIHH", b"fmt ", 16, tag, channels, rate, rate * align, align, bits)
    extra = struct.pack("<4sI3sx", b"LIST", 3, b"abc")
    body = b"WAVE" + extra + head + struct.pack("<4sI", b"data", len(data)) + data
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def test_wav_formats():
    y, rate = audio.decode_wav(wav(np.array([0, 16384, -32768], "<i2").tobytes(), 1, 1, 16))
    assert rate == 8000 and y.tolist() == [0.0, 0.5, -1.0]
    assert audio.decode_wav(wav(bytes([128, 192, 0]), 1, 1, 8))[0].tolist() == [0.0, 0.5, -1.0]
    assert audio.decode_wav(wav(bytes([0, 0, 64, 0, 0, 128]), 1, 1, 24))[0].tolist() == [0.5, -1.0]
    assert audio.decode_wav(wav(np.array([1 << 30], "<i4").tobytes(), 1, 1, 32))[0].tolist() == [0.5]
    assert audio.decode_wav(wav(np.array([0.25, -0.75], "<f4").tobytes(), 3, 2, 32))[0].tolist() == [-0.25]
    for bad in (b"", b"RIFFxxxx", wav(b"", 1, 1, 16), wav(b"ab", 6, 1, 8)):
        with pytest.raises(Exception):
            audio.decode_wav(bad)


def test_wav_folder(spark, tmp_path):
    (tmp_path / "good.wav").write_bytes(audio.encode_wav(tone(), RATE))
    (tmp_path / "bad.wav").write_bytes(b"RIFF")
    (tmp_path / "notes.txt").write_text("x")
    good, bad = audio.read_recordings(spark, str(tmp_path))
    row = good.first()
    assert (row["file_id"], row["sr"], len(row["y"])) == ("good", RATE, 2 * RATE)
    assert max(row["y"]) == pytest.approx(0.65, abs=1e-3)
    assert [r["file_id"] for r in bad.collect()] == ["bad"]
    assert good.count() == 1


def test_thirty_second_cap_is_an_argument(spark, tmp_path):
    (tmp_path / "long.wav").write_bytes(audio.encode_wav(np.full(100 * 40, 0.5), 100))
    for cap, n in ((30, 3000), (None, 4000)):
        good, _ = audio.read_recordings(spark, str(tmp_path), max_seconds=cap)
        assert good.select(F.size("y")).first()[0] == n


def test_envelope_of_uneven_length(spark):
    got = recording(spark, [0.1, -0.2, 0.3, 0.9, -0.5]).select(F.inline(S.envelope(F.col("y"), 4))).collect()
    assert [tuple(r) for r in got] == [(0, -0.2, 0.1, 0.2), (1, 0.3, 0.9, 0.9), (2, -0.5, -0.5, 0.5)]


def test_zero_crossing_counts_negative_zero(spark):
    df = spark.createDataFrame([([[0.0, -0.0, 1.0]],)], "f ARRAY<ARRAY<DOUBLE>>")
    assert df.select(S.zero_crossing_rates(F.col("f"))).first()[0] == [1.0]


def test_empty_signal_is_blocked_not_an_error(spark):
    q = gate(recording(spark, []))
    assert q["blocking"] and q["status"] == "poor" and q["rms"] is None


def test_bulk_pass_equals_the_column_route(spark, tmp_path):
    from tussis.operators import bulk

    rng = np.random.default_rng(3)
    (tmp_path / "tone.wav").write_bytes(audio.encode_wav(tone(), RATE))
    (tmp_path / "noise.wav").write_bytes(audio.encode_wav(rng.normal(0, 0.1, 30000), RATE))
    (tmp_path / "silent.wav").write_bytes(audio.encode_wav(np.zeros(4000), RATE))
    (tmp_path / "bad.wav").write_bytes(b"RIFF")
    files = spark.read.format("binaryFile").load(str(tmp_path)).select(F.regexp_extract("path", r"(\w+)\.wav", 1).alias("file_id"), "content")
    rows = {r["file_id"]: r for r in bulk.analyse(files, ["file_id"]).collect()}
    assert rows["bad"]["error"] and rows["bad"]["status"] == "poor"
    assert rows["silent"]["blocking"] and rows["silent"]["mfcc_1_mean"] is None
    good, _ = audio.read_recordings(spark, str(tmp_path))
    route = S.quality_gate(S.quality_measures(good)).withColumn("f", X.feature_struct(F.col("y"), F.col("sr"))).select("*", "f.*")
    for r in route.where("NOT blocking").collect():
        for name in [*bulk.MEASURES, "status", "issues", *X.feature_names()]:
            assert rows[r["file_id"]][name] == (pytest.approx(r[name], rel=1e-6, abs=1e-9) if isinstance(r[name], float) else r[name]), name
