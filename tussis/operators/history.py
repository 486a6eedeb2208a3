"""Analytics over the assessment history (patient_id, ts, id, label, risk, confidence)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tussis.functions.clean import id_matches

# Defaults for a missing confidence, list lengths, healthy labels.
AVERAGE_CONFIDENCE = 0.8
ROW_CONFIDENCE = 0.0
LATEST_CONFIDENCE = 0.85
HEALTHY_LABELS = ["healthy", "normal"]
TIMELINE_ROWS, SEARCH_ROWS = 8, 10

NEWEST_FIRST = ("ts", "id")


def _newest() -> list[Column]:
    return [F.desc(c) for c in NEWEST_FIRST]


def within_days(history: DataFrame, days: int | None) -> DataFrame:
    """Rows of the last ``days`` days before the newest row; all rows when None."""
    if days is None:
        return history
    newest = history.agg(F.max("ts").alias("t")).scalar()
    return history.where(F.col("ts") > newest - F.make_dt_interval(F.lit(days)))


def is_high(risk: Column) -> Column:
    return F.lower(F.coalesce(risk, F.lit(""))) == "high"


def is_flagged(label: Column) -> Column:
    return ~F.lower(F.coalesce(label, F.lit(""))).isin(HEALTHY_LABELS)


def kpis(history: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts, mean confidence (missing counts as 0.8), high-risk and flagged rows."""
    return history.groupBy(*by).agg(
        F.count("*").alias("n_assessments"),
        F.avg(F.coalesce("confidence", F.lit(AVERAGE_CONFIDENCE))).alias("avg_confidence"),
        F.count_if(is_high(F.col("risk"))).alias("n_high_risk"),
        F.count_if(is_flagged(F.col("label"))).alias("n_flagged"),
    )


def timeline(history: DataFrame, n: int = TIMELINE_ROWS) -> DataFrame:
    return history.withColumn("confidence", F.coalesce("confidence", F.lit(ROW_CONFIDENCE))).orderBy(*_newest()).limit(n)


def search(history: DataFrame, needle: str, n: int | None = SEARCH_ROWS, identifier: str = "patient_id") -> DataFrame:
    found = history.where(id_matches(F.col(identifier).cast("string"), needle))
    return found if n is None else found.orderBy(*_newest()).limit(n)


def latest(history: DataFrame) -> DataFrame:
    return history.orderBy(*_newest()).limit(1).withColumn("confidence", F.coalesce("confidence", F.lit(LATEST_CONFIDENCE)))


def session_delta(history: DataFrame, by: str | None = "patient_id") -> DataFrame:
    """Latest against previous session in percentage points.

    Per patient, or over the whole log with ``by=None``. Two rows per patient
    survive in each task before the shuffle, so a patient with most of the log
    costs no more than any other.
    """
    rows = history.withColumn("confidence", F.coalesce("confidence", F.lit(ROW_CONFIDENCE)))
    if by is None:
        newest = rows.orderBy(*_newest()).limit(2).withColumn("__all", F.lit(0))
        key = "__all"
    else:
        newest, key = rows, by
    recent = newest.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*_newest()))).where("__n <= 2")
    pairs = recent.groupBy(key).agg(
        F.max(F.when(F.col("__n") == 1, F.col("confidence"))).alias("latest"),
        F.max(F.when(F.col("__n") == 2, F.col("confidence"))).alias("previous"),
    ).where("previous IS NOT NULL")
    points = (F.col("latest") - F.col("previous")) * 100
    out = pairs.select(key, "latest", "previous", points.alias("delta_points"), F.when(points >= 0, "+").otherwise("-").alias("direction"))
    return out if by else out.drop("__all")


def priority(risk: Column) -> Column:
    lowered = F.lower(risk)
    return F.when(lowered == "high", "P1").when(lowered == "medium", "P2").when(lowered == "low", "P3")


def triage_counts(history: DataFrame) -> DataFrame:
    return history.groupBy(priority(F.col("risk")).alias("priority")).agg(F.count("*").alias("n"))
