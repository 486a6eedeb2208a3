"""Streaming jobs over the given tables, and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tussis.functions import rules, scoring, signal as S
from tussis.functions.clinical_terms import DEFAULT_TERMS
from tussis.operators.history import kpis
from tussis.plans import sql_rules
from tussis.plans.registry import query, spread_table, table
from tussis.plans.scorers import SCORERS, sql_probability
from tussis.plans.stand_ins import note_of, note_sql
from tussis.plans.text_plans import HISTORY_SQL, KPI_SQL, assessments, rounded_kpis
from tussis.session import scratch_path
from tussis.sources.versions import VersionedTable, ddl
from tussis.streaming import burst, common, intake, loudness, screening, spectrum

#: Files a micro-batch takes: what a device has in them is the most that one group of a task holds.
FILES_PER_TRIGGER = 4
BURST_VALUE, REFRACTORY_HOURS = 60.0, 6
_REFRACTORY_MS = REFRACTORY_HOURS * 3600 * 1000


def stream(spark, folder, name):
    return common.read_table(spark, folder, f"{name}.parquet", table(spark, folder, name).schema, FILES_PER_TRIGGER)


def _samples(events):
    return events.select("user_id", common.instant(events, "ts").alias("ts"), loudness.from_byte(F.pmod(F.col("value"), F.lit(256.0))).alias("x"))


_LOUD_SQL = """WITH s AS (SELECT user_id, date_trunc('day', ts) AS day, (fmod(value, 256) - 128) / 128 AS x FROM events),
    w AS (SELECT user_id, day, count(*) AS n, sqrt(avg(x * x)) AS rms, max(abs(x)) AS peak FROM s GROUP BY user_id, day)
    SELECT user_id, strftime(day, '%Y-%m-%d') AS day, n, round(rms, 9) AS rms, round(peak, 9) AS peak, CASE WHEN peak > 0 THEN round(20 * log10(peak), 1) ELSE -90.0::DOUBLE END AS dbfs FROM w"""


def _loud_rows(df):
    day = F.date_from_unix_date(F.floor(F.unix_seconds("frame_start") / 86400).cast("int"))
    return df.select("user_id", F.date_format(day, "yyyy-MM-dd").alias("day"), "n", F.round("rms", 9).alias("rms"), F.round("peak", 9).alias("peak"), "dbfs")


@query("frame_loudness", _LOUD_SQL)
def frame_loudness(spark, folder):
    return _loud_rows(loudness.loudness(_samples(table(spark, folder, "events")), "user_id", "ts", "x", "1 day"))


@query("stream_loudness", _LOUD_SQL)
def stream_loudness(spark, folder):
    """Update-mode frames of a stream; the newest version of each frame is read back."""
    path = scratch_path(spark, "loudness")
    frames = loudness.loudness(_samples(stream(spark, folder, "events")), "user_id", "ts", "x", "1 day", "1 day")
    common.available_now(common.write_batches(frames, path, "update"), spark)
    return _loud_rows(common.newest_state(spark.read.parquet(path), ["user_id", "frame_start"]))


@query("level_band", "SELECT event_id, CASE WHEN abs((fmod(value, 256) - 128) / 128) > 0.4 THEN 'high' WHEN abs((fmod(value, 256) - 128) / 128) > 0.15 THEN 'medium' ELSE 'low' END AS band FROM events")
def level_band(spark, folder):
    x = F.abs(loudness.from_byte(F.pmod(F.col("value"), F.lit(256.0))))
    return table(spark, folder, "events").select("event_id", S.level_band(x, loudness.BAND_HIGH, loudness.BAND_LOW).alias("band"))


_BURST_SQL = f"""WITH RECURSIVE c AS (SELECT DISTINCT user_id, epoch_us(ts) AS t FROM events WHERE value > {BURST_VALUE}),
    f AS (SELECT user_id, min(t) AS t FROM c GROUP BY user_id
      UNION ALL SELECT f.user_id, min(c.t) AS t FROM f JOIN c ON c.user_id = f.user_id AND c.t - f.t > {_REFRACTORY_MS * 1000} GROUP BY f.user_id)
    SELECT user_id, t AS fired_at FROM f"""


@query("burst_refractory", _BURST_SQL)
def burst_refractory(spark, folder):
    events = table(spark, folder, "events")
    return burst.bursts(events, "user_id", "ts", "value", BURST_VALUE, _REFRACTORY_MS, chunk_ms=4 * _REFRACTORY_MS)


@query("stream_burst", _BURST_SQL)
def stream_burst(spark, folder):
    path = scratch_path(spark, "bursts")
    fired = burst.burst_stream(stream(spark, folder, "events"), "user_id", "ts", "value", BURST_VALUE, _REFRACTORY_MS)
    common.available_now(common.write_batches(fired, path, "append"), spark)
    return spark.read.parquet(path).select("user_id", "fired_at")


@query("stream_burst_late", f"""SELECT user_id, fired_at FROM ({_BURST_SQL}) WHERE fired_at <= (SELECT epoch_us(max(ts)) // 1000 * 1000 FROM events WHERE value > {BURST_VALUE}) - 86400000000""")
def stream_burst_late(spark, folder):
    """Bursts once the watermark has passed them: files may arrive up to a day late, in any order."""
    path = scratch_path(spark, "bursts-late")
    fired = burst.burst_stream(stream(spark, folder, "events"), "user_id", "ts", "value", BURST_VALUE, _REFRACTORY_MS, late="1 day")
    common.available_now(common.write_batches(fired, path, "append"), spark)
    return spark.read.parquet(path).select("user_id", "fired_at")


_SLOTS = 16
_FRAME_SQL = f"""WITH w AS (SELECT user_id, (fmod(value, 256) - 128) / 128 AS x, ts, date_trunc('day', ts)::TIMESTAMP - to_days(CAST(k AS INTEGER)) AS start FROM events, range(2) AS r(k)),
    c AS (SELECT user_id, start, (epoch_us(ts) - epoch_us(start)) // {2 * 86400 * 10**6 // _SLOTS} AS slot, avg(x) AS v, count(*) AS k FROM w GROUP BY ALL),
    f AS (SELECT user_id, start, CAST(sum(k) AS BIGINT) AS n, map_from_entries(list((slot, v))) AS m FROM c GROUP BY user_id, start),
    y AS (SELECT user_id, start, n, list_transform(range({_SLOTS}), lambda i: coalesce(m[i], 0.0::DOUBLE)) AS y FROM f),
    h AS (SELECT *, list_transform(range({_SLOTS}), lambda i: y[i + 1] * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / {_SLOTS - 1}))) AS z FROM y),
    s AS (SELECT *, list_transform(range({_SLOTS // 2 + 1}), lambda k: sqrt(pow(list_sum(list_transform(range({_SLOTS}), lambda i: z[i + 1] * cos(2 * pi() * k * i / {_SLOTS}))), 2)
        + pow(list_sum(list_transform(range({_SLOTS}), lambda i: z[i + 1] * sin(2 * pi() * k * i / {_SLOTS}))), 2))) AS m FROM h)
    SELECT user_id, strftime(start, '%Y-%m-%d') AS day, n, round(sqrt(list_sum(list_transform(y, lambda v: v * v)) / {_SLOTS}), 9) AS rms,
        round(list_sum(list_transform(range({_SLOTS // 2 + 1}), lambda k: k * m[k + 1])) / greatest(list_sum(m), 1e-10::DOUBLE), 6) AS centroid FROM s"""


def _frames(events):
    framed = spectrum.frames(_samples(events), "user_id", "ts", "x", "2 days", "1 day", _SLOTS, "1 day")
    return spectrum.spectra(framed, "user_id", _SLOTS)


def _frame_rows(df):
    day = F.date_from_unix_date(F.floor(F.unix_seconds("frame_start") / 86400).cast("int"))
    return df.select("user_id", F.date_format(day, "yyyy-MM-dd").alias("day"), "n", F.round("rms", 9).alias("rms"), F.round("centroid", 6).alias("centroid"))


@query("frame_spectrum", _FRAME_SQL)
def frame_spectrum(spark, folder):
    """Spectra of overlapping frames of two days, one a day."""
    return _frame_rows(_frames(table(spark, folder, "events")))


@query("stream_spectrum", f"SELECT * FROM ({_FRAME_SQL}) WHERE CAST(day AS DATE) + 3 <= (SELECT max(ts) FROM events)")
def stream_spectrum(spark, folder):
    """The frames that the watermark has closed, each with its spectrum."""
    path = scratch_path(spark, "spectra")
    common.available_now(common.write_batches(_frames(stream(spark, folder, "events")), path, "append"), spark)
    return _frame_rows(spark.read.parquet(path))


_MET_SQL = """WITH r AS (SELECT event_id, ts, value FROM events WHERE event_id % 3 <> 0),
    e AS (SELECT event_id, ts + to_hours(CAST(event_id % 5 - 2 AS INTEGER)) AS ts, event_type AS note FROM events WHERE event_id % 2 = 0)
    SELECT r.event_id, value, note, CAST(epoch_us(e.ts) - epoch_us(r.ts) AS BIGINT) AS micros_after FROM r
    LEFT JOIN e ON e.event_id = r.event_id AND e.ts BETWEEN r.ts - INTERVAL 1 HOUR AND r.ts + INTERVAL 1 HOUR WHERE r.ts <= (SELECT max(ts) FROM events) - INTERVAL 2 DAYS"""


def _met(events):
    rows = events.withColumn("ts", common.instant(events, "ts"))
    recordings = rows.where("event_id % 3 <> 0").select("event_id", "ts", "value")
    entries = rows.where("event_id % 2 = 0").select("event_id", (F.col("ts") + F.make_dt_interval(F.lit(0), (F.col("event_id") % 5 - 2).cast("int"))).alias("ts"), F.col("event_type").alias("note"))
    both = intake.met(recordings, entries, "event_id", "ts", "1 HOUR", "1 day")
    return both.select("event_id", "ts", "value", "note", (F.unix_micros("entered_at") - F.unix_micros("ts")).alias("micros_after"))


def _settled(rows, events):
    last = events.select(F.max(common.instant(events, "ts")).alias("last")).scalar()
    return rows.where(F.col("ts") <= last - F.expr("INTERVAL 2 DAYS")).drop("ts")


@query("intake_met", _MET_SQL)
def intake_met(spark, folder):
    events = table(spark, folder, "events")
    return _settled(_met(events), events)


@query("stream_intake", _MET_SQL)
def stream_intake(spark, folder):
    """Recordings and their intake entries as two streams; recordings that nothing meets have a row too."""
    path = scratch_path(spark, "intake")
    common.available_now(common.write_batches(_met(stream(spark, folder, "events")), path, "append"), spark)
    return _settled(spark.read.parquet(path).drop("batch_id"), table(spark, folder, "events"))


_GATE = S.GateLimits(dead_peak=0.28)


def _gate(df):
    return S.quality_gate(S.quality_measures(df, limits=_GATE, silence_samples=8), _GATE)


def _score(df):
    probability = scoring.sigmoid(SCORERS[0].score(F.col("y")))
    i = F.col("vec_id")
    return df.select(
        "vec_id", "gate_status", "gate_issues", probability.alias("probability"), scoring.predicted(probability, True).alias("prediction"), note_of(i).alias("notes"),
        (i % 5 == 0).alias("respiratory_condition"), (i % 7 == 0).alias("fever_muscle_pain"), (i % 90).cast("double").alias("age"),
    )


def _fuse(df):
    out = rules.fuse(df, keep=["vec_id", "gate_status", "gate_issues"])
    return out.withColumns({"symptoms_detected": F.array_join("symptoms_detected", "; "), "confidence": F.round("confidence", 6)})


def _recordings(df):
    return df.select("vec_id", F.col("embedding").cast("array<double>").alias("y"), F.lit(64.0).alias("sr"))


_SCORED_SQL = f"""SELECT vec_id, {sql_probability(0)} AS probability, CAST({sql_probability(0)} >= 0.5 AS INTEGER) AS prediction,
    {note_sql("vec_id")} AS notes, (vec_id % 5 = 0) AS respiratory_condition, (vec_id % 7 = 0) AS fever_muscle_pain,
    CAST(vec_id % 90 AS DOUBLE) AS age FROM embeddings WHERE list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) >= 0.28::DOUBLE"""
_BLOCKED_SQL = "SELECT vec_id, true AS blocked FROM embeddings WHERE NOT list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) >= 0.28::DOUBLE"
_SCREEN_SQL = f"""SELECT * REPLACE (round(confidence, 6) AS confidence), false AS blocked FROM ({sql_rules.sql_fused(_SCORED_SQL, 'vec_id', DEFAULT_TERMS)})
    UNION ALL BY NAME {_BLOCKED_SQL}"""


def _with_verdict(rows):
    return rows.withColumn("blocked", F.col("gate_status") == "poor").drop("gate_status", "gate_issues")


@query("screen_batch", _SCREEN_SQL)
def screen_batch(spark, folder):
    return _with_verdict(screening.screen(_recordings(spread_table(spark, folder, "embeddings")), _gate, _score, _fuse, ["vec_id"]))


@query("stream_score", _SCREEN_SQL)
def stream_score(spark, folder):
    path = scratch_path(spark, "screened")
    results = _with_verdict(screening.screen(_recordings(stream(spark, folder, "embeddings")), _gate, _score, _fuse, ["vec_id"]))
    common.available_now(screening.append_stream(results, path), spark)
    return spark.read.parquet(path).drop("batch_id")


@query("stream_history_kpis", f"{HISTORY_SQL} SELECT {KPI_SQL} FROM history")
def stream_history_kpis(spark, folder):
    path = scratch_path(spark, "kpis")
    arriving = assessments(stream(spark, folder, "events"))
    common.available_now(screening.history_kpi_stream(arriving, path), spark)
    return rounded_kpis(VersionedTable(spark, path).read(ddl(kpis(arriving))))


@query("stream_history_append", f"{HISTORY_SQL} SELECT patient_id, id, label, risk FROM history")
def stream_history_append(spark, folder):
    path = scratch_path(spark, "history-stream")
    common.available_now(screening.append_stream(assessments(stream(spark, folder, "events")), path), spark)
    return spark.read.parquet(path).select("patient_id", "id", "label", "risk")


@query("history_versions", f"{HISTORY_SQL} SELECT patient_id, id, label, risk, CAST((SELECT count(*) FROM history WHERE id % 2 = 0) AS BIGINT) AS n_first FROM history")
def history_versions(spark, folder):
    """Two appends and a compaction; a reader of the first version still sees that version."""
    rows = assessments(table(spark, folder, "events")).select("patient_id", "id", "label", "risk")
    store = VersionedTable(spark, scratch_path(spark, "versions"))
    first = store.append(rows.where("id % 2 = 0"))
    earlier = store.read(ddl(rows), first)
    store.append(rows.where("id % 2 = 1"))
    store.compact(ddl(rows), least=2)
    return store.read(ddl(rows)).withColumn("n_first", earlier.select(F.count("*")).scalar())
