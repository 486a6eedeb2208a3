"""Waveform, spectrum and cepstrum operators over ``embeddings`` as recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tussis.functions import signal as S, spectral as X
from tussis.operators import bulk
from tussis.plans.registry import query, spread_table, sql_text
from tussis.plans.sql_signal import SignalSql, stats_select, with_ctes
from tussis.sources import audio

SPEC = X.FrameSpec(length=16, hop=8, n_mels=8, n_mfcc=4)
Q = SignalSql(SPEC.length, SPEC.hop)
RATE = 64.0
CHROMA_RATE = 8000.0


def recordings(spark, folder):
    return spread_table(spark, folder, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("y"), F.lit(RATE).alias("sr")
    )


def _framed(spark, folder):
    return recordings(spark, folder).withColumn("frames", S.frames(F.col("y"), SPEC.length, SPEC.hop))


def _spectra(spark, folder, rate=RATE):
    return recordings(spark, folder).select(
        "vec_id", F.lit(rate).alias("sr"), X.magnitude_spectrum(F.col("y"), SPEC.length, SPEC.hop).alias("mag")
    )


def _stats(df, track, name):
    return df.select("vec_id", track.alias("t")).select(
        "vec_id", F.round(S.mean(F.col("t")), 9).alias(f"{name}_mean"), F.round(S.var_pop(F.col("t")), 9).alias(f"{name}_var")
    )


@query("signal_level", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS y FROM embeddings),
    l AS (SELECT vec_id, len(y) / 64.0::DOUBLE AS duration, sqrt(list_sum(list_transform(y, lambda x: x * x)) / len(y)) AS rms,
      list_max(list_transform(y, lambda x: abs(x))) AS peak FROM e)
    SELECT vec_id, duration, round(rms, 9) AS rms, round(20 * log10(greatest(rms, 1e-8)), 6) AS dbfs, round(peak, 9) AS peak FROM l""")
def signal_level(spark, folder):
    y = F.col("y")
    return recordings(spark, folder).select("vec_id", "sr", y, S.root_mean_square(y).alias("rms")).select(
        "vec_id", (F.size(y) / F.col("sr")).alias("duration"), F.round("rms", 9).alias("rms"),
        F.round(S.decibels(F.col("rms")), 6).alias("dbfs"), F.round(S.peak(y), 9).alias("peak"),
    )


@query("clipping_ratio", "SELECT vec_id, len(list_filter(embedding::DOUBLE[], lambda x: abs(x) >= 0.3::DOUBLE)) / 64.0::DOUBLE AS ratio FROM embeddings")
def clipping_ratio(spark, folder):
    return recordings(spark, folder).select("vec_id", S.clipping_ratio(F.col("y"), 0.3).alias("ratio"))


_SILENCE = """blocks AS (SELECT vec_id, n // 8 AS b, sqrt(avg(x * x)) AS r FROM samples GROUP BY vec_id, b),
    quiet AS (SELECT vec_id, count(*) FILTER (r < 0.11::DOUBLE) / 8.0::DOUBLE AS ratio FROM blocks GROUP BY vec_id)"""


@query("silence_ratio", f"{with_ctes(Q.samples, _SILENCE)} SELECT vec_id, ratio FROM quiet")
def silence_ratio(spark, folder):
    return recordings(spark, folder).select("vec_id", S.silence_ratio(F.col("y"), F.lit(8), 0.11).alias("ratio"))


@query("downmix_scale", """WITH c AS (SELECT vec_id, CAST(unnest(range(32)) AS INTEGER) AS n, unnest(embedding[1:32])::DOUBLE AS a, unnest(embedding[33:64])::DOUBLE AS b FROM embeddings),
    m AS (SELECT vec_id, n, CASE WHEN vec_id % 3 = 0 AND n = 5 THEN 0.0 ELSE (a + b) / 2 * CASE WHEN vec_id % 2 = 0 THEN 20000 ELSE 1 END END AS x FROM c),
    p AS (SELECT vec_id, max(abs(x)) AS p FROM m GROUP BY vec_id)
    SELECT vec_id, n, round(CASE WHEN p > 1 THEN x / 32768 ELSE x END, 9) AS x FROM m JOIN p USING (vec_id)""")
def downmix_scale(spark, folder):
    y, i = F.col("y"), F.col("vec_id")
    stereo = F.array(F.slice(y, 1, 32), F.slice(y, 33, 32))
    r = recordings(spark, folder).select("vec_id", F.transform(S.downmix(stereo), lambda x, n: F.when((i % 3 == 0) & (n == 5), float("nan")).otherwise(x * F.when(i % 2 == 0, 20000.0).otherwise(1.0))).alias("mono"))
    scaled = r.select("vec_id", S.scale_integers(S.without_nan(F.col("mono"))).alias("mono"))
    return scaled.select("vec_id", F.posexplode("mono").alias("n", "x")).withColumn("x", F.round("x", 9))


@query("auto_gain", """WITH e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / CASE WHEN vec_id % 2 = 0 THEN 4 ELSE 1 END) AS y FROM embeddings),
    p AS (SELECT vec_id, y, list_max(list_transform(y, lambda x: abs(x))) AS p FROM e),
    g AS (SELECT vec_id, p, list_transform(y, lambda x: CASE WHEN p > 0.001 AND p < 0.25 THEN x * (0.65::DOUBLE / p) ELSE x END) AS y FROM p)
    SELECT vec_id, round(list_max(list_transform(y, lambda x: abs(x))), 9) AS peak, round(list_sum(y), 9) AS total FROM g""")
def auto_gain(spark, folder):
    quiet = F.transform("y", lambda x: x / F.when(F.col("vec_id") % 2 == 0, 4.0).otherwise(1.0))
    r = recordings(spark, folder).select("vec_id", S.auto_gain(quiet).alias("y"))
    return r.select("vec_id", F.round(S.peak(F.col("y")), 9).alias("peak"), F.round(S.total(F.col("y")), 9).alias("total"))


@query("trim_pad", """WITH e AS (SELECT vec_id, (embedding::DOUBLE[])[1:(vec_id % 64) + 1] AS y FROM embeddings),
    p AS (SELECT vec_id, list_concat(y, list_transform(range(greatest(16 - len(y), 0)), lambda i: 0.0::DOUBLE)) AS y FROM e)
    SELECT vec_id, CAST(len(y) AS INTEGER) AS n, round(list_sum(y), 9) AS total, round(y[len(y)], 9) AS last FROM p""")
def trim_pad(spark, folder):
    y = S.pad(S.trim(F.col("y"), (F.col("vec_id") % 64 + 1).cast("int")), 16)
    r = recordings(spark, folder).select("vec_id", y.alias("y"))
    return r.select("vec_id", F.size("y").alias("n"), F.round(S.total(F.col("y")), 9).alias("total"), F.round(F.element_at("y", -1), 9).alias("last"))


@query("frame_signal", f"{with_ctes(Q.samples, Q.frames)} SELECT vec_id, f, k, round(x, 9) AS x FROM frames")
def frame_signal(spark, folder):
    f = _framed(spark, folder).select("vec_id", F.posexplode("frames").alias("f", "frame"))
    return f.select("vec_id", "f", F.posexplode("frame").alias("k", "x")).withColumn("x", F.round("x", 9))


@query("zero_crossing_rate", f"{with_ctes(Q.samples, Q.frames, Q.zcr)} SELECT vec_id, f, round(v, 9) AS rate FROM zcr")
def zero_crossing_rate(spark, folder):
    r = _framed(spark, folder).select("vec_id", F.posexplode(S.zero_crossing_rates(F.col("frames"))).alias("f", "rate"))
    return r.withColumn("rate", F.round("rate", 9))


@query("zcr_stats", f"{with_ctes(Q.samples, Q.frames, Q.zcr)} {stats_select('zcr', 'zcr')}")
def zcr_stats(spark, folder):
    return _stats(_framed(spark, folder), S.zero_crossing_rates(F.col("frames")), "zcr")


@query("rms_stats", f"{with_ctes(Q.samples, Q.frames, Q.levels)} {stats_select('lev', 'rms')}")
def rms_stats(spark, folder):
    return _stats(_framed(spark, folder), S.frame_levels(F.col("frames")), "rms")


@query("envelope", f"""{with_ctes(Q.samples)}, b AS (SELECT vec_id, n // 8 AS bucket, min(x) AS low, max(x) AS high, max(abs(x)) AS peak FROM samples GROUP BY vec_id, bucket)
    SELECT vec_id, bucket, round(low, 9) AS low, round(high, 9) AS high, round(peak, 9) AS peak,
      CASE WHEN abs(high) > 0.25::DOUBLE THEN 'high' WHEN abs(high) > 0.15::DOUBLE THEN 'medium' ELSE 'low' END AS band FROM b""")
def envelope(spark, folder):
    b = recordings(spark, folder).select("vec_id", F.inline(S.envelope(F.col("y"), 8)))
    return b.select(
        "vec_id", "bucket", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), F.round("peak", 9).alias("peak"),
        S.level_band(F.abs("high"), 0.25, 0.15).alias("band"),
    )


_LIMITS = S.GateLimits(short_seconds=0.3, quiet_rms=0.115, quiet_peak=0.35, clipping=0.02, silence=0.3, long_seconds=0.9,
                       dead_seconds=0.05, dead_peak=0.05, clip_level=0.3, silence_rms=0.11)


@query("quality_gate", f"""WITH e AS (SELECT vec_id, (embedding::DOUBLE[])[1:(vec_id % 64) + 1] AS y FROM embeddings),
    samples AS (SELECT vec_id, unnest(range(len(y))) AS n, unnest(y) AS x, len(y) AS size FROM e),
    m AS (SELECT vec_id, size / 64.0::DOUBLE AS duration, sqrt(avg(x * x)) AS rms, max(abs(x)) AS peak, count(*) FILTER (abs(x) >= 0.3::DOUBLE)::DOUBLE / size AS clipping_ratio FROM samples GROUP BY vec_id, size),
    b AS (SELECT vec_id, n // 8 AS b, sqrt(avg(x * x)) AS r FROM samples WHERE n < size - size % 8 GROUP BY vec_id, b),
    s AS (SELECT vec_id, count(*) FILTER (r < 0.11::DOUBLE)::DOUBLE / count(*) AS silence_ratio FROM b GROUP BY vec_id),
    q AS (SELECT m.*, coalesce(silence_ratio, 1.0) AS silence_ratio FROM m LEFT JOIN s USING (vec_id)),
    g AS (SELECT *, (duration <= 0.05 OR peak < 0.05) AS blocking, list_filter([CASE WHEN duration < 0.3::DOUBLE THEN {sql_text(S.ISSUE_SHORT)} END,
      CASE WHEN rms < 0.115::DOUBLE AND peak < 0.35::DOUBLE THEN {sql_text(S.ISSUE_QUIET)} END, CASE WHEN clipping_ratio > 0.02::DOUBLE THEN {sql_text(S.ISSUE_CLIPPING)} END,
      CASE WHEN silence_ratio > 0.3::DOUBLE THEN {sql_text(S.ISSUE_SILENCE)} END, CASE WHEN duration > 0.9::DOUBLE THEN {sql_text(S.ISSUE_LONG)} END], lambda i: i IS NOT NULL) AS issues FROM q)
    SELECT vec_id, duration, round(rms, 9) AS rms, round(20 * log10(greatest(rms, 1e-8)), 6) AS dbfs, round(peak, 9) AS peak, round(clipping_ratio, 9) AS clipping_ratio,
      round(silence_ratio, 9) AS silence_ratio, array_to_string(issues, ' | ') AS issues, blocking,
      CASE WHEN blocking THEN 'poor' WHEN len(issues) > 0 THEN 'review' ELSE 'good' END AS status FROM g""")
def quality_gate(spark, folder):
    r = recordings(spark, folder).withColumn("y", S.trim(F.col("y"), (F.col("vec_id") % 64 + 1).cast("int")))
    g = S.quality_gate(S.quality_measures(r, limits=_LIMITS, silence_samples=8), _LIMITS)
    return g.select(
        "vec_id", "duration", F.round("rms", 9).alias("rms"), F.round("dbfs", 6).alias("dbfs"), F.round("peak", 9).alias("peak"),
        F.round("clipping_ratio", 9).alias("clipping_ratio"), F.round("silence_ratio", 9).alias("silence_ratio"),
        F.array_join("issues", " | ").alias("issues"), "blocking", "status",
    )


_SPEC_SQL = (Q.samples, Q.frames, Q.spectrum)


@query("stft_magnitude", f"{with_ctes(*_SPEC_SQL)} SELECT vec_id, f, b, round(m, 9) AS m FROM spec")
def stft_magnitude(spark, folder):
    f = _spectra(spark, folder).select("vec_id", F.posexplode("mag").alias("f", "row"))
    return f.select("vec_id", "f", F.posexplode("row").alias("b", "m")).withColumn("m", F.round("m", 9))


def _long_mel(df, column, name, digits):
    f = df.select("vec_id", F.posexplode(column).alias("f", "row")).select("vec_id", "f", F.posexplode("row").alias("mel", name))
    return f.withColumn(name, F.round(name, digits))


def _mel(spark, folder):
    return _spectra(spark, folder).select("vec_id", X.mel_power(F.col("mag"), F.col("sr"), SPEC).alias("power"))


_MEL_SQL = (*_SPEC_SQL, Q.mel(RATE, SPEC.n_mels))


@query("mel_power", f"{with_ctes(*_MEL_SQL)} SELECT vec_id, f, mel, round(power, 9) AS power FROM mel")
def mel_power(spark, folder):
    return _long_mel(_mel(spark, folder), F.col("power"), "power", 9)


@query("log_mel", f"{with_ctes(*_MEL_SQL)} SELECT vec_id, f, mel, round(10 * log10(greatest(power, 1e-10)), 6) AS db FROM mel")
def log_mel(spark, folder):
    return _long_mel(_mel(spark, folder), X.log_power(F.col("power")), "db", 6)


@query("mfcc_stats", f"{with_ctes(*_MEL_SQL, Q.mfcc(8, 4))} SELECT vec_id, c, round(mean, 6) AS mean, round(var, 6) AS var FROM mfcc")
def mfcc_stats(spark, folder):
    m = _mel(spark, folder).select("vec_id", X.mfcc(F.col("power"), SPEC).alias("cep"))
    tracks = F.array(*[F.struct(F.lit(c).alias("c"), X.column_track(F.col("cep"), c).alias("t")) for c in range(SPEC.n_mfcc)])
    return m.select("vec_id", F.inline(tracks)).select(
        "vec_id", "c", F.round(S.mean(F.col("t")), 6).alias("mean"), F.round(S.var_pop(F.col("t")), 6).alias("var")
    )


def _hertz(rate=RATE):
    return X.bin_hertz(F.lit(rate), SPEC.length)


@query("spectral_centroid", f"{with_ctes(*_SPEC_SQL, Q.centroid(RATE))} {stats_select('cen', 'centroid')}")
def spectral_centroid(spark, folder):
    return _stats(_spectra(spark, folder), X.centroids(F.col("mag"), _hertz()), "centroid")


@query("spectral_bandwidth", f"{with_ctes(*_SPEC_SQL, Q.centroid(RATE), Q.bandwidth(RATE))} {stats_select('bw', 'bandwidth')}")
def spectral_bandwidth(spark, folder):
    return _stats(_spectra(spark, folder), X.bandwidths(F.col("mag"), _hertz()), "bandwidth")


@query("spectral_rolloff", f"{with_ctes(*_SPEC_SQL, Q.rolloff(RATE))} {stats_select('ro', 'rolloff')}")
def spectral_rolloff(spark, folder):
    return _stats(_spectra(spark, folder), X.rolloffs(F.col("mag"), _hertz()), "rolloff")


@query("chroma_stats", f"{with_ctes(*_SPEC_SQL, Q.chroma(CHROMA_RATE))} {stats_select('chr', 'chroma')}")
def chroma_stats(spark, folder):
    return _stats(_spectra(spark, folder), F.flatten(X.chroma(F.col("mag"), _hertz(CHROMA_RATE))), "chroma")


def features(spark, folder, rate=CHROMA_RATE, spec=SPEC):
    r = recordings(spark, folder)
    return r.select("vec_id", X.feature_struct(F.col("y"), F.lit(rate), spec).alias("f")).select("vec_id", "f.*")


@query("extract_features", Q.feature_row(CHROMA_RATE, 8, 4, 4))
def extract_features(spark, folder):
    return features(spark, folder).withColumns({c: F.round(c, 4) for c in X.feature_names(SPEC)})


@query("mfcc_only", Q.mfcc_row(CHROMA_RATE, 8, 4))
def mfcc_only(spark, folder):
    names = X.mfcc_names(SPEC)
    return features(spark, folder).select("vec_id", *[F.round(c, 6).alias(c) for c in names])


@query("extract_features_full", SignalSql(2048, 512).feature_row(22050.0, 128, 20, 3))
def extract_features_full(spark, folder):
    """The 52 published features at full frame size; each recording pads to one frame."""
    full = features(spark, folder, 22050.0, X.FrameSpec())
    return full.withColumns({c: F.round(c, 3) for c in X.feature_names()})


@query("spectrogram", """WITH samples AS (SELECT vec_id, unnest(range(len(embedding))) AS n, unnest(embedding)::DOUBLE AS x FROM embeddings),
    frames AS (SELECT vec_id, f, n - f * 16 AS k, x FROM samples JOIN range(3) AS g(f) ON n >= f * 16 AND n < f * 16 + 32),
    p AS (SELECT vec_id, f, b, sum(x * (0.5 - 0.5 * cos(2 * pi() * k / 31)) * cos(2 * pi() * b * k / 32)) AS re,
      sum(x * (0.5 - 0.5 * cos(2 * pi() * k / 31)) * sin(2 * pi() * b * k / 32)) AS im FROM frames, range(17) AS g(b) GROUP BY vec_id, f, b),
    w AS (SELECT sum(pow(0.5 - 0.5 * cos(2 * pi() * k / 31), 2)) AS energy FROM range(32) AS g(k))
    SELECT vec_id, (16 + f * 16) / 64.0::DOUBLE AS t, b * 64.0::DOUBLE / 32 AS hz,
      round(10 * log10(greatest((re * re + im * im) * CASE WHEN b > 0 AND b < 16 THEN 2 ELSE 1 END / (64 * energy), 1e-20)), 5) AS db FROM p, w""")
def spectrogram(spark, folder):
    r = recordings(spark, folder).select("vec_id", X.power_density(F.col("y"), F.col("sr"), 32, 16).alias("grid"))
    f = r.select("vec_id", F.posexplode("grid").alias("f", "row")).select("vec_id", "f", F.posexplode("row").alias("b", "db"))
    return f.select("vec_id", ((F.col("f") * 16 + 16) / RATE).alias("t"), (F.col("b") * RATE / 32).alias("hz"), F.round("db", 5).alias("db"))


@query("wav_scan", """SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS n, 64 AS sr,
    round(round_even(unnest(embedding)::DOUBLE * 32768, 0) / 32768, 9) AS x FROM embeddings WHERE vec_id % 10 <> 7""")
def wav_scan(spark, folder):
    """WAV bytes written from every recording, one in ten damaged, decoded again."""
    blob = audio.encode_wav_column(F.col("y"), 64)
    r = recordings(spark, folder).select("vec_id", blob.alias("whole"))
    damaged = F.when(F.col("vec_id") % 10 == 7, F.substring("whole", 1, 20)).otherwise(F.col("whole"))
    good, _ = audio.decode_recordings(r.select("vec_id", damaged.alias("content")), ["vec_id"], gain=False)
    return good.select("vec_id", F.posexplode("y").alias("n", "x"), "sr").withColumn("x", F.round("x", 9))


_PCM = SignalSql(SPEC.length, SPEC.hop, sample="round_even(x * 32768, 0) / 32768")
_BULK_LIMITS = S.GateLimits(short_seconds=0.3, clip_level=0.3, silence=0.3, silence_rms=0.11, dead_peak=0.28)


@query("bulk_analysis", f"""WITH feat AS ({_PCM.feature_row(64.0, 8, 4)}),
    s AS (SELECT vec_id, unnest(range(len(embedding))) AS n, round_even(unnest(embedding)::DOUBLE * 32768, 0) / 32768 AS x FROM embeddings),
    m AS (SELECT vec_id, count(*) / 64.0::DOUBLE AS duration, sqrt(avg(x * x)) AS rms, max(abs(x)) AS peak, count(*) FILTER (abs(x) >= 0.3::DOUBLE)::DOUBLE / count(*) AS clipping_ratio FROM s GROUP BY vec_id),
    b AS (SELECT vec_id, n // 8 AS b, sqrt(avg(x * x)) AS r FROM s GROUP BY vec_id, b),
    q AS (SELECT vec_id, count(*) FILTER (r < 0.11::DOUBLE)::DOUBLE / count(*) AS silence_ratio FROM b GROUP BY vec_id),
    j AS (SELECT vec_id, vec_id % 10 = 7 AS damaged, duration, rms, peak, clipping_ratio, silence_ratio, peak < 0.28::DOUBLE AS dead FROM m JOIN q USING (vec_id))
    SELECT vec_id, damaged AS failed, CASE WHEN NOT damaged THEN 64 END AS sr, {', '.join(f"CASE WHEN NOT damaged THEN round({c}, 9) END AS {c}" for c in ['duration', 'rms', 'peak', 'clipping_ratio', 'silence_ratio'])},
      CASE WHEN NOT damaged THEN round(20 * log10(rms), 6) END AS dbfs, damaged OR dead AS blocking,
      CASE WHEN damaged OR dead THEN 'poor' WHEN clipping_ratio > 0.02::DOUBLE OR silence_ratio > 0.3::DOUBLE THEN 'review' ELSE 'good' END AS status,
      {', '.join(f"CASE WHEN NOT damaged AND NOT dead THEN {n} END AS {n}" for n in X.feature_names(SPEC))}
    FROM j JOIN feat USING (vec_id)""")
def bulk_analysis(spark, folder):
    """WAV bytes of every recording, one in ten damaged, decoded, gated and described in one pass."""
    r = recordings(spark, folder).select("vec_id", audio.encode_wav_column(F.col("y"), 64).alias("whole"))
    damaged = F.when(F.col("vec_id") % 10 == 7, F.substring("whole", 1, 20)).otherwise(F.col("whole"))
    out = bulk.analyse(r.select("vec_id", damaged.alias("content")), ["vec_id"], SPEC, _BULK_LIMITS, gain=False, silence_samples=8)
    digits = {c: 9 for c in bulk.MEASURES} | {"dbfs": 6} | {n: 6 for n in X.feature_names(SPEC)}
    return out.select("vec_id", F.col("error").isNotNull().alias("failed"), "sr", "blocking", "status", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query("wav_quarantine", "SELECT vec_id, true AS quarantined FROM embeddings WHERE vec_id % 10 = 7")
def wav_quarantine(spark, folder):
    r = recordings(spark, folder).select("vec_id", audio.encode_wav_column(F.col("y"), 64).alias("whole"))
    damaged = F.when(F.col("vec_id") % 10 == 7, F.substring("whole", 1, 20)).otherwise(F.col("whole"))
    _, bad = audio.decode_recordings(r.select("vec_id", damaged.alias("content")), ["vec_id"])
    return bad.select("vec_id", F.col("error").isNotNull().alias("quarantined"))
