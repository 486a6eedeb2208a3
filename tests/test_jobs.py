"""The whole way: folder of sidecars and WAV files, training, screening, history, exploration."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tussis import jobs
from tussis.functions import spectral as X, text
from tussis.operators import clean, models
from tussis.session import scratch_path
from tussis.sources import audio, sidecars, sinks

RATE = 4000
SPEC = X.FrameSpec(length=256, hop=128, n_mels=20, n_mfcc=6)


@pytest.fixture(scope="module")
def recordings(tmp_path_factory):
    """Healthy recordings are low tones, covid ones are noise; two cannot be used."""
    folder = tmp_path_factory.mktemp("recordings")
    rng = np.random.default_rng(1)
    t = np.arange(RATE) / RATE
    for i in range(36):
        sick = i % 3 == 0
        y = rng.normal(0, 0.2, RATE) if sick else 0.4 * np.sin(2 * np.pi * (150 + 5 * i) * t)
        (folder / f"r{i:02d}.wav").write_bytes(audio.encode_wav(y, RATE))
        meta = {"status": "COVID-19" if sick else "healthy", "gender": ["female", "male", None][i // 3 % 3], "age": str(20 + i), "respiratory_condition": str(i % 2 == 0)}
        (folder / f"r{i:02d}.json").write_text(json.dumps(meta))
    (folder / "silent.wav").write_bytes(audio.encode_wav(np.zeros(RATE), RATE))
    (folder / "silent.json").write_text('{"status": "healthy"}')
    (folder / "broken.wav").write_bytes(b"RIFF")
    (folder / "broken.json").write_text('{"status": "healthy"}')
    (folder / "r00.mp3").write_bytes(b"other copy")
    (folder / "only.ogg").write_bytes(b"OggS")
    (folder / "only.json").write_text('{"status": "healthy"}')
    (folder / "lost.json").write_text('{"status": "healthy"}')
    (folder / "undecided.json").write_text('{"status": "who knows"}')
    return str(folder)


@pytest.fixture(scope="module")
def trained(spark, recordings, tmp_path_factory):
    models_at = str(tmp_path_factory.mktemp("models"))
    wanted = {"decision_tree": models.decision_tree(models.QUICK), "logistic": models.logistic(models.QUICK)}
    return jobs.train(spark, recordings, models_at, wanted, SPEC, folds=2, per_class=24), models_at


def test_training_skips_unusable_recordings(spark, recordings):
    table = jobs.training_table(spark, recordings, SPEC)
    assert table.count() == 36 and table.where("target = 1").count() == 12
    dropped = dict(jobs.training_parts(spark, recordings, SPEC)[1].collect())
    assert set(dropped) == {"silent", "broken", "only", "lost", "undecided"} and all(dropped.values())
    assert (dropped["only"], dropped["lost"], dropped["undecided"]) == ("no decoder for .ogg", "no audio file", "no label")
    quick = jobs.training_table(spark, recordings, SPEC, limit=7)  # "broken", "lost" and "only" sort first and have no usable sound
    assert sorted(r["file_id"] for r in quick.collect()) == ["r00", "r01", "r02", "r03"]


def test_training_separates_and_stores(spark, trained):
    board, models_at = trained
    rows = {r["model"]: r for r in board.collect()}
    assert all(r["accuracy"] >= 0.9 and r["error"] is None for r in rows.values())
    name, model, scaling = jobs.best_model(spark, models_at)
    assert name in rows and len(scaling.mean) == 4 + 24 + 3 and scaling.spread[-3:] == [1.0, 1.0, 1.0]


def test_screening_a_folder(spark, recordings, trained):
    intake = spark.createDataFrame(
        [("r01", "gasping and blue lips", "yes", "61"), ("r03", "denies fever", "no", "30"), ("r04", "no symptoms", None, None)],
        "file_id STRING, notes STRING, respiratory_condition STRING, age STRING",
    )
    results = jobs.screen(spark, recordings, intake, trained[1], F.lit("2024-05-01 10:00:00").cast("timestamp_ntz"))
    rows = {r["file_id"]: r for r in results.collect()}
    assert len(rows) == 39
    for lost in ("silent", "broken", "only"):
        assert rows[lost]["label"] is None and (rows[lost]["error"] or rows[lost]["quality_issues"])
    rows = {k: r for k, r in rows.items() if r["label"]}
    compared = jobs.screen_models(spark, recordings, intake, trained[1])
    assert compared.count() == 72 and compared.where("model = 'logistic'").first()["accuracy"] >= 0.9
    assert (rows["r01"]["label"], rows["r01"]["risk_level"], rows["r01"]["plan_id"]) == ("Urgent review", "high", "emergency")
    assert rows["r03"]["label"] == "Disease" and rows["r04"]["label"] == "Healthy"
    assert rows["r04"]["symptoms_detected"] == ["No symptoms reported"]
    assert sum(r["acoustic_prediction"] == (int(k[1:]) % 3 == 0) for k, r in rows.items()) >= 34

    path = scratch_path(spark, "history")
    sinks.append_history(jobs.history_rows(results), path)
    stored = sinks.read_history(spark, scratch_path(spark, "nothing"), path)
    assert stored.count() == 36 and stored.where("label = 'Urgent review'").first()["patient_id"] == "r01"


def test_exploration_writes_every_table(spark, recordings, tmp_path):
    good, bad = sidecars.read_sidecars(spark, recordings)
    assert bad.count() == 0
    cleaned = clean.clean_metadata(good).drop("expert_labels_1", "expert_labels_2", "expert_labels_3")
    tables = jobs.explore(cleaned)
    for name, table in tables.items():
        sinks.write_csv(table, str(tmp_path / name))
    counts = {r["value"]: r["n"] for r in tables["status_counts"].collect()}
    assert counts == {"healthy": 28, "covid-19": 12, "who knows": 1}
    assert tables["quality_report"].first()["total_records"] == 41
    assert tables["gender_by_status"].where("gender = 'unknown'").first()["healthy"] == 12  # 8 of the tones and the four unusable ones


def test_report_texts(spark):
    df = spark.createDataFrame([("K1", "<b>" + "x" * 900 + "</b>", "<p>y</p>" * 1000)], "k STRING, r STRING, d STRING")
    row = df.select(text.report_summary(F.col("r"), F.col("d")), text.report_message(F.col("k"), F.col("r"), F.col("d"))).first()
    assert row[0] == "x" * 850 and len(row[1]) == 1800 and row[1].startswith("Respiratory screening report | Patient ID: K1 xxx")
