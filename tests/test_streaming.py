"""Burst detection against a plain walk, and streams against their batch twins."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tussis.operators.history import kpis
from tussis.session import scratch_path
from tussis.sources.versions import VersionedTable, ddl
from tussis.streaming import burst, common, intake, loudness, screening, spectrum

START = dt.datetime(2024, 1, 1)


def walk(rows, threshold, gap_us):
    out = []
    for device in sorted({r[0] for r in rows}):
        last = None
        for t in sorted(r[1] for r in rows if r[0] == device and r[2] > threshold):
            us = int((t - START).total_seconds() * 1e6 + 0.5)
            if last is None or us - last > gap_us:
                last = us
                out.append((device, us))
    return sorted(out)


def micros(rows):
    base = int(START.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    return sorted((r["device"], r["fired_at"] - base) for r in rows)


def samples(seed, n, span_ms, step_ms=1):
    rng = random.Random(seed)
    return [
        ("hot" if rng.random() < 0.6 else rng.choice("ab"), START + dt.timedelta(milliseconds=rng.randrange(0, span_ms, step_ms)), rng.random())
        for _ in range(n)
    ]


SCHEMA = "device STRING, ts TIMESTAMP_NTZ, level DOUBLE"


@pytest.mark.parametrize("seed,span,chunk,step", [(1, 60_000, 500, 1), (2, 20_000, 301, 1), (3, 200_000, 3_000, 1), (4, 30_000, 700, 100), (5, 8_000, 400, 50), (6, 500_000, None, 1)])
def test_batch_bursts_equal_walk(spark, seed, span, chunk, step):
    rows = samples(seed, 700, span, step)
    df = spark.createDataFrame(rows, SCHEMA)
    got = burst.bursts(df, "device", "ts", "level", 0.42, 300, chunk)
    assert micros(got.collect()) == walk(rows, 0.42, 300_000)


def test_constant_noise_keeps_its_phase(spark):
    """A candidate every 23 ms never settles a chunk, so every chunk must be chained."""
    rows = [("d", START + dt.timedelta(milliseconds=23 * i), 1.0) for i in range(600)]
    got = burst.bursts(spark.createDataFrame(rows, SCHEMA), "device", "ts", "level", 0.42, 300, 450)
    assert micros(got.collect()) == walk(rows, 0.42, 300_000)


def test_chunk_must_exceed_refractory(spark):
    with pytest.raises(ValueError):
        burst.bursts(spark.createDataFrame([], SCHEMA), "device", "ts", "level", chunk_ms=300)


def _files(spark, rows, parts, shuffle_seed=None):
    path = scratch_path(spark, "stream-input")
    rows = sorted(rows, key=lambda r: r[1])
    if shuffle_seed is not None:
        random.Random(shuffle_seed).shuffle(rows)
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def test_stream_bursts_over_several_batches(spark):
    rows = samples(9, 400, 60_000)
    path, out = _files(spark, rows, 4), scratch_path(spark, "stream-output")
    stream = common.read_files(spark, path, "*.parquet", spark.read.parquet(path).schema, 1)
    common.available_now(common.write_batches(burst.burst_stream(stream, "device", "ts", "level"), out, "append"), spark)
    assert micros(spark.read.parquet(out).collect()) == walk(rows, 0.42, 300_000)


def test_stream_bursts_with_late_files(spark):
    """Shuffled files and a long watermark: everything the watermark has passed fires as in time order."""
    rows = samples(11, 300, 60_000) + [("end", START + dt.timedelta(hours=3), 0.9)]
    path, out = _files(spark, rows[:-1], 3, shuffle_seed=1), scratch_path(spark, "stream-output")
    spark.createDataFrame(rows[-1:], SCHEMA).write.mode("append").parquet(path)
    stream = common.read_files(spark, path, "*.parquet", spark.read.parquet(path).schema, 1)
    fired = burst.burst_stream(stream, "device", "ts", "level", late="2 hours")
    common.available_now(common.write_batches(fired, out, "append"), spark)
    assert micros(spark.read.parquet(out).where("device <> 'end'").collect()) == walk(rows[:-1], 0.42, 300_000)


def test_silent_frame_level(spark):
    df = spark.createDataFrame([("d", START, 0.0), ("d", START, 0.0)], SCHEMA)
    row = loudness.loudness(df, "device", "ts", "level", "1 second").first()
    assert (row["n"], row["peak"], row["dbfs"]) == (2, 0.0, -90.0)


def test_stream_kpis_equal_batch(spark):
    schema = "patient_id STRING, ts TIMESTAMP_NTZ, id BIGINT, label STRING, risk STRING, confidence DOUBLE"
    path, out = scratch_path(spark, "kpi-in"), scratch_path(spark, "kpi-out")
    for i in range(3):
        rows = [("p", START, i * 10 + j, "Disease" if j % 2 else "Healthy", "High", None if j == 3 else 0.5) for j in range(5)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    batch = spark.read.parquet(path)
    stream = common.read_files(spark, path, "*.parquet", batch.schema, 1)
    common.available_now(screening.history_kpi_stream(stream, out), spark)
    shown = VersionedTable(spark, out)
    assert shown.read(ddl(kpis(batch))).collect() == kpis(batch).collect() and len(shown.versions()) == 3


def test_timeout_is_reported(spark):
    stream = spark.readStream.format("rate").load()
    query = stream.writeStream.format("noop").option("checkpointLocation", scratch_path(spark, "c")).start()
    with pytest.raises(TimeoutError):
        common.finish(query, 1)
    assert not query.isActive


def test_newest_state(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 3, 1), ("b", 2, 0)], "k STRING, v INT, batch_id INT")
    assert sorted(map(tuple, common.newest_state(df, ["k"]).select("k", F.col("v")).collect())) == [("a", 3), ("b", 2)]


def test_stream_frames_with_late_files_equal_batch(spark):
    rows = [("end", START + dt.timedelta(hours=9), 0.5)] + samples(21, 500, 3_600_000)
    path, out = _files(spark, rows[1:], 5, shuffle_seed=3), scratch_path(spark, "frames-out")
    spark.createDataFrame(rows[:1], SCHEMA).write.mode("append").parquet(path)

    def framed(df):
        ready = df.select("device", common.instant(df, "ts").alias("ts"), "level")
        return spectrum.spectra(spectrum.frames(ready, "device", "ts", "level", "4 minutes", "1 minute", 8, "6 hours"), "device", 8)

    stream = common.read_files(spark, path, "*.parquet", spark.read.parquet(path).schema, 1)
    common.available_now(common.write_batches(framed(stream), out, "append"), spark)
    key = ("device", "frame_start", "n", F.round("rms", 9), F.round("centroid", 9), "strongest")
    expected = framed(spark.read.parquet(path)).where("device <> 'end'").select(*key).collect()
    got = spark.read.parquet(out).where("device <> 'end'").select(*key).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, expected)) and len(got) > 100


def test_frames_of_a_tone_peak_at_its_bin(spark):
    rows = [("d", START + dt.timedelta(seconds=i), float(__import__("math").cos(2 * 3.141592653589793 * 3 * i / 16))) for i in range(16)]
    df = spark.createDataFrame(rows + [("d", None, 1.0), ("d", START, None)], SCHEMA)
    ready = df.select("device", common.instant(df, "ts").alias("ts"), "level")
    row = spectrum.spectra(spectrum.frames(ready, "device", "ts", "level", "16 seconds", "16 seconds"), "device").first()
    assert (row["n"], row["strongest"]) == (16, 3)


@pytest.mark.parametrize("order", [(0, 1), (1, 0)])
def test_recordings_meet_entries_in_either_order(spark, order):
    schema, paths = "k STRING, ts TIMESTAMP, v STRING", [scratch_path(spark, "side") for _ in range(2)]
    at = lambda m: START + dt.timedelta(minutes=m)
    sides = [
        [[("a", at(0), "r1"), ("b", at(5), "r2"), (None, at(6), "r3")], [("late", at(4000), "end")]],
        [[("a", at(20), "e1"), ("a", at(3), "e2"), ("b", at(90), "too far"), ("c", at(1), "alone")], [("late", at(4000), "end")]],
    ]
    for side in order:
        for rows in sides[side]:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(paths[side])
    left, right = (common.read_files(spark, p, "*.parquet", spark.read.parquet(p).schema, 1) for p in paths)
    out = scratch_path(spark, "met")
    common.available_now(common.write_batches(intake.met(left, right.withColumnRenamed("v", "note"), "k", "ts", "30 MINUTES", "1 hour"), out, "append"), spark)
    got = {(r.k, r.v, r.note) for r in spark.read.parquet(out).where("v <> 'end'").collect()}
    assert got == {("a", "r1", "e1"), ("a", "r1", "e2"), ("b", "r2", None), (None, "r3", None)}


def test_blocked_recordings_have_a_row(spark):
    df = spark.createDataFrame([(1, True, "poor", ["quiet"]), (2, False, "good", []), (3, None, "poor", ["x", "y"])], "id INT, blocking BOOLEAN, status STRING, issues ARRAY<STRING>")
    out = screening.screen(df, lambda d: d, lambda d: d.select("id", "gate_status", "gate_issues", F.lit(0.5).alias("p")), lambda d: d, ["id"])
    assert sorted(map(tuple, out.select("id", "gate_status", "gate_issues", "p").collect())) == [(1, "poor", "quiet", None), (2, "good", "", 0.5), (3, "poor", "x; y", None)]


def test_versions_switch_in_one_step(spark):
    table = VersionedTable(spark, scratch_path(spark, "versioned"))
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id INT").coalesce(1)
    read = lambda version=None: sorted(r.id for r in table.read("id INT", version).collect())
    assert read() == [] and table.versions() == []
    table.append(rows(1), "batch-0")
    table.append(rows(1), "batch-0")  # a repeated micro-batch
    before = table.read("id INT")  # a reader in mid-write keeps what it has seen
    part = table._write(rows(2, 3))
    assert read() == [1]
    other = VersionedTable(spark, table.path)
    other.append(rows(4))
    table._commit(lambda parts: [*parts, part])
    assert read() == [1, 2, 3, 4] and sorted(r.id for r in before.collect()) == [1] and read(1) == [1]
    table.compact("id INT", least=2)
    assert read() == [1, 2, 3, 4] and len(table.parts()) == 1
    table.expire(keep=1)
    assert read() == [1, 2, 3, 4] and len(table.versions()) == 1
    table.replace(rows(9))
    assert read() == [9]
    table.clear()
    assert read() == []


def test_writers_at_once_lose_nothing(spark):
    from multiprocessing.pool import ThreadPool

    path = scratch_path(spark, "raced")
    with ThreadPool(4) as pool:
        pool.map(lambda i: VersionedTable(spark, path).append(spark.createDataFrame([(i,)], "id INT").coalesce(1)), range(8))
    table = VersionedTable(spark, path)
    assert sorted(r.id for r in table.read("id INT").collect()) == list(range(8)) and len(table.versions()) == 8


def test_a_table_of_many_files_is_streamed_whole(spark):
    """A table may be one file or a folder of files, beside other tables; a query over the folder has every recording."""
    from tussis.plans import streaming_plans

    folder = scratch_path(spark, "tables")
    rows = [(i, [0.01 * ((i * j) % 60) for j in range(1, 65)], i % 10) for i in range(40)]
    for name in ("embeddings", "others"):
        spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>, label INT").repartition(6).write.parquet(f"{folder}/{name}.parquet")
    streamed, batch = (f(spark, folder) for f in (streaming_plans.stream_score, streaming_plans.screen_batch))
    assert sorted(map(str, streamed.collect())) == sorted(map(str, batch.select(*streamed.columns).collect()))
    one = f"{folder}/others.parquet"
    part = next(r.path.rsplit("/", 1)[1] for r in spark.read.format("binaryFile").load(one).select("path").collect())
    out = scratch_path(spark, "one-file")
    stream = common.read_table(spark, one, part, spark.read.parquet(one).schema)
    common.available_now(common.write_batches(stream, out, "append"), spark)
    assert spark.read.parquet(out).count() == spark.read.parquet(f"{one}/{part}").count()
