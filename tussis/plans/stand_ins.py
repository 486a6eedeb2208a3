"""How the given tables stand in for clinical inputs.

The tables hold no clinical notes. ``events`` rows get notes put together from parts by
``event_id``; ``documents`` are used whole, with a lexicon of words that do occur in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tussis.functions.clinical_terms import ClinicalTerms
from tussis.plans.registry import spread_table, sql_list

# Parts of made-up notes. A row's note is one of each, chosen by its number, so that the rules meet keywords alone and together,
# negated in the same clause, after a comma, after a longer word, and not at all.
OPENINGS = [
    "", "Seen at the walk-in desk. ", "Follow-up by phone; ", "Denies fever, ", "No cough or cold; ", "Worker on night shifts, smoker, ",
    "Never short of breath. ", "Reports a hot flat and gunshot noise nearby, ",
]
FINDINGS = [
    "nothing to report", "dry coughing since Monday", "gasping after two stairs", "high temperature and myalgia", "tired, weak and shivering", "not tired but runny nose",
    "severe chest pain when lying down", "wheezing at dawn", "green sputum, mucus in the morning", "free of chills", "blue lips earlier today", "without chest heaviness",
    "sore throat with joint pain", "nocough cough", "difficulty breathing denied", "known emphysema",
]
ENDINGS = [".", "; absence of fever.", ", flu in the family.", ". Clear of congestion, exhausted.", "; sudden confusion", ". Negative for covid. Body ache!", " and zero fatigue."]

# Words that occur in the documents, grouped like the clinical lexicon.
DOCUMENT_TERMS = ClinicalTerms(
    symptoms={
        "fever": ["with", "und"],
        "cough": ["this", "thatthe"],
        "breathing": ["from the", "sur"],
        "fatigue": ["être", "para"],
        "cold": ["there"],
        "chills": ["which is"],
    },
    emergencies={
        "breathing emergency": ["the the", "de de"],
        "sudden confusion": ["copyright", "license"],
    },
    plans={
        "fever": ["of the"],
        "respiratory": ["by"],
        "productive": ["sch"],
        "copd": ["in"],
    },
    negators=["no", "not", "was", "la", "in der", "free of"],
)


_PARTS = ((OPENINGS, 1), (FINDINGS, len(OPENINGS)), (ENDINGS, len(OPENINGS) * len(FINDINGS)))


def note_of(number: Column) -> Column:
    """One of 896 notes."""
    return F.concat(*[F.element_at(F.array(*map(F.lit, p)), (F.floor(number / step) % len(p) + 1).cast("int")) for p, step in _PARTS])


def note_sql(number: str) -> str:
    return " || ".join(f"{sql_list(p)}[({number} // {step}) % {len(p)} + 1]" for p, step in _PARTS)


def screenings(spark: SparkSession, folder: str) -> DataFrame:
    """One screening input per event."""
    e = spread_table(spark, folder, "events")
    i = F.col("event_id")
    return e.select(
        "event_id",
        (F.col("value") >= 60).cast("int").alias("prediction"),
        F.least(F.col("value") / 100.0, F.lit(1.0)).alias("probability"),
        note_of(i).alias("notes"),
        (i % 5 == 0).alias("respiratory_condition"),
        (i % 7 == 0).alias("fever_muscle_pain"),
        (F.col("user_id") % 90).cast("double").alias("age"),
    )


SCREENINGS_SQL = f"""
    SELECT event_id, CAST(value >= 60 AS INTEGER) AS prediction, least(value / 100.0::DOUBLE, 1.0::DOUBLE) AS probability,
        {note_sql("event_id")} AS notes,
        (event_id % 5 = 0) AS respiratory_condition, (event_id % 7 = 0) AS fever_muscle_pain,
        CAST(user_id % 90 AS DOUBLE) AS age
    FROM events"""


def document_screenings(spark: SparkSession, folder: str) -> DataFrame:
    """One screening input per document, the whole text as the note."""
    d = spread_table(spark, folder, "documents")
    i = F.col("doc_id")
    probability = (F.col("n_chars") % 1000) / 1000.0
    return d.select(
        "doc_id",
        (probability >= 0.6).cast("int").alias("prediction"),
        probability.alias("probability"),
        F.col("text").alias("notes"),
        (i % 5 == 0).alias("respiratory_condition"),
        (i % 7 == 0).alias("fever_muscle_pain"),
        (i % 90).cast("double").alias("age"),
    )


DOCUMENT_SCREENINGS_SQL = """
    SELECT doc_id, CAST((n_chars % 1000) / 1000.0::DOUBLE >= 0.6::DOUBLE AS INTEGER) AS prediction,
        (n_chars % 1000) / 1000.0::DOUBLE AS probability, text AS notes,
        (doc_id % 5 = 0) AS respiratory_condition, (doc_id % 7 = 0) AS fever_muscle_pain,
        CAST(doc_id % 90 AS DOUBLE) AS age
    FROM documents"""
