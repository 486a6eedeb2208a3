"""Sidecars, lookups, caches, history edge cases, chat, text helpers."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tussis.functions import clean as C, text as X
from tussis.operators import chat, clean, history, leaderboard, lookup, profile
from tussis.session import scratch_path
from tussis.sources import audio, sidecars, sinks

T0 = dt.datetime(2024, 1, 1)
H_SCHEMA = "patient_id STRING, ts TIMESTAMP_NTZ, id BIGINT, label STRING, risk STRING, confidence DOUBLE"


def test_sidecar_folder(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"gender": " Female ", "age": "41", "status": "healthy", "expert_labels_2": {"diagnosis": "COVID-19"}}))
    (tmp_path / "a.json").write_text('{"age": null,\n "status": "Symptomatic"}')
    (tmp_path / "broken.json").write_text('{"age": ')
    (tmp_path / "b.wav").write_bytes(b"")
    good, bad = sidecars.read_sidecars(spark, str(tmp_path))
    rows = {r["file_id"]: r for r in good.collect()}
    assert set(rows) == {"a", "b"} and rows["b"]["expert_labels_2"]["diagnosis"] == "COVID-19"
    assert [r["file_id"] for r in bad.collect()] == ["broken"]
    cleaned = {r["file_id"]: r for r in clean.clean_metadata(good).collect()}
    assert (cleaned["b"]["gender"], cleaned["b"]["age"], cleaned["a"]["gender"], cleaned["a"]["age"]) == ("female", 41.0, "unknown", None)
    labelled = {r["file_id"]: (r["target"], r["age"]) for r in clean.label_metadata(good).collect()}
    assert labelled == {"a": (1, 35.0), "b": (0, 41.0)}


def test_missing_and_empty_folders(spark, tmp_path):
    with pytest.raises(Exception):
        sidecars.read_sidecars(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        sidecars.require_rows(spark.range(0), "no metadata")
    with pytest.raises(ValueError):
        sidecars.require_rows(clean.binary_rows(spark.createDataFrame([("other",)], "status STRING")), "no rows")


def test_audio_lookup_priority(spark, tmp_path):
    for name in ("x.mp3", "x.wav", "y.ogg", "y.webm", "z.txt"):
        (tmp_path / name).write_bytes(b"1")
    files = audio.list_recordings(spark, str(tmp_path))
    first = {r["file_id"]: r["audio_path"].rsplit("/", 1)[1] for r in lookup.audio_lookup(files).collect()}
    assert first == {"x": "x.wav", "y": "y.webm"}
    second = lookup.audio_lookup(files, [".ogg", ".mp3"])
    assert {r["audio_path"].rsplit("/", 1)[1] for r in second.collect()} == {"x.mp3", "y.ogg"}


@pytest.mark.parametrize("path,stem,ext", [("/a/b.tar.gz", "b.tar", ".gz"), ("b", "b", ""), (".profile", ".profile", ""), ("a.", "a", "."), ("C:\\x\\y.WAV", "y", ".wav"), ("..a.b", "..a", ".b")])
def test_stem_and_extension(spark, path, stem, ext):
    assert tuple(spark.createDataFrame([(path,)], "p STRING").select(C.stem(F.col("p")), C.extension(F.col("p"))).first()) == (stem, ext)


@pytest.mark.parametrize("text,value", [("1", 1.0), (" 2.5e1 ", 25.0), ("1d", None), ("NaN", None), ("", None), ("-.5", -0.5), ("1,2", None), (None, None)])
def test_to_number(spark, text, value):
    assert spark.createDataFrame([(text,)], "p STRING").select(C.to_number(F.col("p"))).first()[0] == value


def test_factorize_by_first_appearance(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "i INT, s STRING")
    assert {r["i"]: r["code"] for r in clean.factorize(df, "s", "i").collect()} == {1: 0, 2: -1, 3: 1, 4: 0}


def test_median_of_empty_column_stays_null(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (4.0, None)], "a DOUBLE, b DOUBLE")
    assert sorted(map(tuple, clean.impute_median(df, ["a", "b"]).collect())) == [(1.0, None), (2.5, None), (4.0, None)]


def test_histogram_of_constant(spark):
    rows = profile.histogram(spark.createDataFrame([(2.0,), (2.0,)], "v DOUBLE"), "v", 4).orderBy("bin").collect()
    assert [r["n"] for r in rows] == [0, 0, 2, 0] and rows[0]["lower"] == 1.5 and rows[3]["upper"] == 2.5


def test_duplicates_of_nested_rows(spark):
    df = spark.createDataFrame([({"a": 1, "b": 2},), ({"b": 2, "a": 1},), (None,), (None,)], "m MAP<STRING, INT>")
    assert profile.duplicate_rows(df).first()[0] == 2


def test_cache_recomputes_only_for_new_inputs(spark):
    calls, folder = [], scratch_path(spark, "cache")

    def compute(df):
        calls.append(1)
        return df.selectExpr("id * 2 AS d")

    for n in (5, 5, 6):
        sinks.cached(spark.range(n), folder, compute).count()
    assert len(calls) == 2


def test_history_empty_then_append_then_purge(spark):
    path = scratch_path(spark, "history")
    assert sinks.read_history(spark, path).count() == 0
    rows = [(f"p{i % 3}", T0 + dt.timedelta(minutes=i), i, "Healthy", "low", 0.5) for i in range(201)]
    full = spark.createDataFrame(rows, H_SCHEMA).withColumn("age", F.lit(30.0)).withColumn("gender", F.lit("x")).withColumn("model", F.lit("m"))
    sinks.append_history(full, path)
    kept = sinks.retained(sinks.read_history(spark, path))
    assert kept.count() == 200 and kept.agg(F.min("id")).first()[0] == 1
    sinks.purge_history(spark, path)
    assert sinks.read_history(spark, path).count() == 0


def test_history_of_none_and_one(spark):
    none = spark.createDataFrame([], H_SCHEMA)
    assert history.kpis(none).first()["n_assessments"] == 0 and history.session_delta(none).count() == 0
    one = spark.createDataFrame([("p", T0, 1, "Disease", "HIGH", None)], H_SCHEMA)
    k = history.kpis(one).first()
    assert (k["avg_confidence"], k["n_high_risk"], k["n_flagged"]) == (0.8, 1, 1)
    assert history.session_delta(one).count() == 0 and history.session_delta(one, by=None).count() == 0
    assert history.latest(one).first()["confidence"] == 0.85
    assert history.timeline(one).first()["confidence"] == 0.0


def test_search_with_blank_needle(spark):
    df = spark.createDataFrame([("AB-1", T0, 1, "x", "low", 0.1), ("cd", T0, 2, "x", "low", 0.1)], H_SCHEMA)
    assert history.search(df, " ").count() == 2 and history.search(df, "ab").first()["id"] == 1


# The ten published accuracies.
PUBLISHED = {
    "random_forest": 0.7857142857142857, "extra_trees": 0.8571428571428571, "gradient_boosting": 0.8571428571428571, "adaboost": 0.8571428571428571,
    "bagging": 0.8571428571428571, "decision_tree": 0.7857142857142857, "knn": 0.8571428571428571, "svc": 0.8571428571428571,
    "logistic": 0.8571428571428571, "sgd": 0.8571428571428571,
}


def _published(spark):
    text = json.dumps({n: {"path": f"output/{n}.joblib", "accuracy": a} for n, a in PUBLISHED.items()} | {"broken": {"path": None, "error": "x"}})
    rows = sidecars.model_summary_rows(spark.createDataFrame([(text,)], "s STRING"), "s")
    return rows.withColumn("filename", F.concat("model", F.lit(".joblib")))


def test_published_leaderboard(spark):
    models = _published(spark)
    s = leaderboard.statistics(models).first()
    assert (s["trained"], s["failed"]) == (10, 1)
    assert s["mean_accuracy"] == pytest.approx(0.842857, abs=1e-6) and s["std_accuracy"] == pytest.approx(0.030117, abs=1e-6)
    assert s["median_accuracy"] == pytest.approx(0.857143, abs=1e-6) and s["accuracy_range"] == pytest.approx(0.071429, abs=1e-6)
    assert tuple(leaderboard.tiers(models).first()) == (8, 2, 0)
    assert leaderboard.choose_best(models).first()["filename"] == "adaboost.joblib"
    assert leaderboard.choose_by_priority(models).first()["model"] == "random_forest"
    assert [r["model"] for r in leaderboard.ranked(models.select("model", "accuracy")).orderBy("position").collect()][-1] == "broken"


def test_routing(spark):
    cases = {
        "What file formats can I upload?": "formats", "How does it work?": "usage", "Is this a diagnosis?": "diagnosis", "What does the confidence score mean?": "confidence",
        "Who made this project?": "author", "I cannot breathe": "emergency", "ನಿಖರತೆ?": "kannada:models", "दमा": "hindi:diseases", "hello": "general",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t STRING")
    assert {r["t"]: r["intent"] for r in chat.with_intent(df, "t").collect()} == cases


def test_route_names_are_arguments():
    topics = dict(chat.english_topics(product="Acme"))
    assert "what is acme" in topics["purpose"] and "what is acme" not in dict(chat.english_topics())["purpose"]


def test_context_drops_blank_messages(spark):
    rows = [(1, t, "assistant" if t % 2 else "system", "" if t == 5 else f" m{t} ") for t in range(20)]
    got = chat.context(spark.createDataFrame(rows, "c INT, t INT, r STRING, x STRING"), "c", "t", "r", "x").orderBy("t").collect()
    assert [g["t"] for g in got] == list(range(8, 20)) and got[0]["role"] == "user" and got[0]["x"] == "m8"


@pytest.mark.parametrize("content,expected", [('" hi "', "hi"), ('{"text": "", "content": "c"}', "c"), ('[{"type":"text","text":"a"},{"type":"file"},{"type":"text","text":"b"}]', "a\nb"), ("7", ""), (None, "")])
def test_message_text(spark, content, expected):
    assert spark.createDataFrame([(content,)], "c STRING").select(sidecars.message_text(F.col("c"))).first()[0] == expected


def test_text_helpers(spark):
    df = spark.createDataFrame([("<b>a</b>\u00a0 <i>b&c</i>", "person@example.com", "o'neil_2nd.joblib")], "h STRING, e STRING, f STRING")
    row = df.select(X.plain_text(F.col("h")), X.percent_encode(F.col("e")), X.display_name(F.col("f")), X.html_escape(F.col("f")), C.is_email(F.col("e"))).first()
    assert tuple(row) == ("a b&c", "person%40example.com", "O'Neil 2Nd", "o&#x27;neil_2nd.joblib", True)
