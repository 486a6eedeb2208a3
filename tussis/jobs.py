"""The three end-to-end jobs: explore a metadata table, train on a folder, screen a folder."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tussis.functions import rules, scoring, spectral as X
from tussis.functions.clean import DEFAULT_AGE, clamp_domain, extension, number_or, parse_bool, stem
from tussis.operators import bloom, bulk, clean, lookup, models, profile
from tussis.operators.prepare import categories_of
from tussis.session import durable
from tussis.sources import sidecars, sinks
from tussis.sources.audio import list_recordings

DECODED = [".wav"]
CLINICAL = ["age", "cough_detected", "respiratory_condition", "fever_muscle_pain"]
DEFAULT_COUGH_ENTERED = 0.5  # fixed value: what a form sends when nothing is entered


def analysed_recordings(spark: SparkSession, folder: str, spec: X.FrameSpec = X.FrameSpec(), only: DataFrame | None = None) -> DataFrame:
    """One analysed row per recording id.

    A recording with a file that can be decoded is decoded; one with other audio files only has a row with an error, by the
    published order of extensions. ``only`` (file_id) skips the other files before they are decoded, by a filter of
    bounded size, and the results are exactly of its ids; file contents are never shuffled.
    """
    order = [*DECODED, *[e for e in lookup.AUDIO_PRIORITY if e not in DECODED]]
    found = lookup.audio_lookup(list_recordings(spark, folder).select("path"), order)
    kind = extension(F.col("audio_path"))
    other = found.where(~kind.isin(DECODED)).select("file_id", F.concat(F.lit("no decoder for "), kind).alias("error"))
    if only is not None:
        other = other.join(only.select("file_id"), "file_id", "left_semi")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder)
    named = files.select(stem(F.col("path")).alias("file_id"), "content")
    if only is None:
        return bulk.analyse(named, ["file_id"], spec).unionByName(other, allowMissingColumns=True)
    analysed = bulk.analyse(bloom.might_be_in(named, only, "file_id"), ["file_id"], spec)
    return analysed.join(only.select("file_id"), "file_id", "left_semi").unionByName(other, allowMissingColumns=True)


USABLE = "error IS NULL AND NOT blocking"


def _unusable(analysed: DataFrame) -> DataFrame:
    """(file_id, reason) of recordings that can't be used."""
    return analysed.where(f"NOT coalesce({USABLE}, false)").select("file_id", F.coalesce("error", F.array_join("issues", "; ")).alias("reason"))


def training_table(spark: SparkSession, folder: str, spec: X.FrameSpec = X.FrameSpec(), limit: int | None = None) -> DataFrame:
    """The rows of ``training_parts`` that can be trained on."""
    return training_parts(spark, folder, spec, limit)[0]


def training_parts(spark: SparkSession, folder: str, spec: X.FrameSpec = X.FrameSpec(), limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Labelled metadata joined to the features of usable recordings, and (file_id, reason) of every sidecar left out.

    Reasons are an unreadable sidecar, no label, no audio file, a decoding error or the gate's issues. Both are
    written once. ``limit`` takes the first recordings by name, for a quick run.
    """
    metadata, unreadable = sidecars.read_sidecars(spark, folder)
    labelled = clean.label_metadata(metadata)
    unlabelled = metadata.select("file_id").join(labelled.select("file_id"), "file_id", "left_anti")
    if limit is not None:
        labelled = labelled.orderBy("file_id").limit(limit)
    labelled = durable(labelled)
    analysed = durable(analysed_recordings(spark, folder, spec, labelled))
    wide = lookup.with_features(labelled, analysed.where(USABLE).select("file_id", *X.feature_names(spec)))
    lost = lookup.having(_unusable(analysed), labelled)
    silent = lookup.lacking(labelled.select("file_id"), analysed).withColumn("reason", F.lit("no audio file"))
    dropped = lost.unionByName(silent).unionByName(unlabelled.withColumn("reason", F.lit("no label")))
    dropped = dropped.unionByName(unreadable.select("file_id", F.lit("unreadable sidecar").alias("reason")))
    return sidecars.require_rows(durable(wide), f"no labelled recordings in {folder}"), durable(dropped)


def model_vector(df: DataFrame, numeric: Sequence[str], genders: Sequence[str]) -> DataFrame:
    """Numbers in the given order followed by one flag per gender; absent columns get their default."""
    ready = clean.conform_columns(df, [*df.columns, *[c for c in [*numeric, "gender"] if c not in df.columns]], ["gender"])
    numbers = [F.col(c).cast("double") for c in numeric]
    flags = [F.when(F.col("gender") == g, 1.0).otherwise(0.0) for g in genders]
    return ready.withColumn("x", F.array(*numbers, *flags))


def train(
    spark: SparkSession,
    folder: str,
    model_folder: str,
    families: Mapping[str, Callable] | None = None,
    spec: X.FrameSpec = X.FrameSpec(),
    folds: int = 5,
    per_class: int = 120,
) -> DataFrame:
    """Leaderboard of all model families on a folder of sidecars and WAV files.

    Models, their scaling, the input layout, the summary and the recordings left out (``dropped``, with
    reasons) are stored in ``model_folder``.
    """
    table, dropped = training_parts(spark, folder, spec)
    dropped.write.mode("overwrite").parquet(f"{model_folder}/dropped")
    numeric, genders = [*CLINICAL, *X.feature_names(spec)], categories_of(table, "gender")
    rows = model_vector(table, numeric, genders).select("file_id", "target", "x")
    families = models.model_families() if families is None else families
    board = models.train_and_evaluate(
        rows, families, key="file_id", target="target", vector="x", folds=folds, per_class=per_class,
        unscaled=len(genders), model_folder=model_folder,
    )
    layout = {"numeric": numeric, "genders": genders, "spec": [spec.length, spec.hop, spec.n_mels, spec.n_mfcc]}
    spark.createDataFrame([(json.dumps(layout),)], "value STRING").coalesce(1).write.mode("overwrite").text(f"{model_folder}/layout")
    sinks.write_model_summary(board, f"{model_folder}/summary")
    return board


def usable_models(spark: SparkSession, model_folder: str, width: int | None = None) -> list[tuple[str, models.Fitted, models.Scaling, float | None]]:
    """Name, model, scaling and accuracy of the stored models, best first (by name among equals).

    A model that can't be read, or expects another width, is passed over.
    """
    summary = sidecars.model_summary_rows(spark.read.text(f"{model_folder}/summary"), "value").where("path IS NOT NULL")
    found = []
    for row in summary.orderBy(F.desc_nulls_last("accuracy"), "model").collect():  # a row per model family
        try:
            model, scaling = models.load_fitted(spark, row["path"])
        except Exception:  # noqa: S112  the next model may be readable
            continue
        if width is None or scaling is None or len(scaling.mean) == width:
            found.append((row["model"], model, scaling, row["accuracy"]))
    return found


def best_model(spark: SparkSession, model_folder: str, width: int | None = None) -> tuple[str, models.Fitted, models.Scaling]:
    """Name, model and scaling of the most accurate stored model that can be used."""
    found = usable_models(spark, model_folder, width)
    if not found:
        raise ValueError(f"no usable model in {model_folder}")
    return found[0][:3]


def _prepared(usable: DataFrame, intake: DataFrame, layout: dict) -> DataFrame:
    """Usable recordings with what was entered for them and the models' input vector."""
    entered = clean.ensure_columns(intake, {c: "string" for c in ["notes", "gender", *CLINICAL]})
    rows = usable.join(entered.select("file_id", "notes", "gender", *CLINICAL), "file_id", "left").withColumns(
        {
            "gender": clamp_domain(F.col("gender")),
            "age": number_or(F.col("age"), DEFAULT_AGE),
            "cough_detected": number_or(F.col("cough_detected"), DEFAULT_COUGH_ENTERED),
            "respiratory_condition": parse_bool(F.col("respiratory_condition")),
            "fever_muscle_pain": parse_bool(F.col("fever_muscle_pain")),
        }
    )
    return model_vector(rows, layout["numeric"], layout["genders"])


def read_layout(spark: SparkSession, model_folder: str) -> dict:
    return json.loads(spark.read.text(f"{model_folder}/layout").first()["value"])


def screen_models(spark: SparkSession, folder: str, intake: DataFrame, model_folder: str) -> DataFrame:
    """What every usable stored model says about every usable recording, in long form."""
    layout = read_layout(spark, model_folder)
    found = usable_models(spark, model_folder, len(layout["numeric"]) + len(layout["genders"]))
    if not found:
        raise ValueError(f"no usable model in {model_folder}")
    scaling = found[0][2]
    same = [(n, m, a) for n, m, s, a in found if s == scaling]  # one training run has one scaling
    rows = _prepared(analysed_recordings(spark, folder, X.FrameSpec(*layout["spec"])).where(USABLE), intake, layout)
    ready = models.as_features(scaling.apply(rows, "x"), "file_id", "x")
    return models.compare_fitted([replace(m, name=n) for n, m, _ in same], ready, ["file_id"], {n: a for n, _, a in same if a is not None})


def screen(spark: SparkSession, folder: str, intake: DataFrame, model_folder: str, now: Column | None = None) -> DataFrame:
    """Screening result of every recording of ``folder``.

    Recordings that the gate blocks or that can't be decoded have a row too, with the gate's status and issues or
    the error, and no assessment.

    ``intake`` has file_id and, where known, notes, gender, age, cough_detected,
    respiratory_condition and fever_muscle_pain as entered. Recordings without
    an intake row are screened on sound alone.
    """
    layout = read_layout(spark, model_folder)
    name, model, scaling = best_model(spark, model_folder, len(layout["numeric"]) + len(layout["genders"]))
    analysed = durable(analysed_recordings(spark, folder, X.FrameSpec(*layout["spec"])))
    vectors = scaling.apply(_prepared(analysed.where(USABLE), intake, layout), "x")
    scored = model.score(models.as_features(vectors, "file_id", "x"), "probability")
    scored = scored.withColumn("prediction", scoring.predicted(F.col("probability")))
    keep = ["file_id", "gender", "entered_age", "gate_status", "quality_issues", "probability", "acoustic_prediction"]
    named = scored.withColumns({"entered_age": F.col("age"), "gate_status": F.col("status"), "quality_issues": F.col("issues"), "acoustic_prediction": F.col("prediction")})
    fused = rules.fuse(named, keep=keep)
    urgent = F.col("status") == "urgent"
    assessed = fused.withColumns(
        {
            "label": rules.display_label(urgent, F.col("acoustic_prediction"), F.col("probability")),
            "display_confidence": rules.display_confidence(urgent, F.col("acoustic_prediction"), F.col("probability")),
            "model": F.lit(name),
            "ts": (F.current_timestamp() if now is None else now).cast("timestamp_ntz"),
        }
    )
    blocked = analysed.where(f"NOT coalesce({USABLE}, false)").select(
        "file_id", F.col("status").alias("gate_status"), F.col("issues").alias("quality_issues"), "error")
    return assessed.unionByName(blocked, allowMissingColumns=True)


def history_rows(results: DataFrame) -> DataFrame:
    """Assessed recordings in the history schema."""
    return results.where("label IS NOT NULL").select(
        F.col("file_id").alias("patient_id"), "ts", F.xxhash64("file_id", "ts").alias("id"), "label",
        F.col("risk_level").alias("risk"), F.col("display_confidence").alias("confidence"), F.col("entered_age").alias("age"), "gender", "model",
    )


def explore(df: DataFrame, status: str = "status", gender: str = "gender", numeric: Sequence[str] = ("age", "cough_detected"), bins: int = 30) -> dict[str, DataFrame]:
    """The exploratory tables of a cleaned metadata frame by name. Only the status values are read at once."""
    statuses = categories_of(df, status)
    return {
        "missingness": profile.missingness(df),
        "completeness": profile.completeness(df),
        "status_counts": profile.value_counts(df, status),
        "gender_counts": profile.value_counts(df, gender),
        "gender_by_status": profile.crosstab(df, gender, status, statuses),
        "numeric_statistics": profile.describe(df, numeric),
        "summary_by_status": profile.describe(df, numeric, [status]),
        "correlation": profile.correlation_matrix(df, numeric),
        "quality_report": profile.quality_report(df, [c for c in df.columns if c != "file_id"]),
        "distinct": profile.distinct_counts(df, [status, gender]),
        **{f"histogram_{c}": profile.histogram(df, c, bins) for c in numeric},
    }
