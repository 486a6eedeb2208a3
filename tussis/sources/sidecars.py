"""JSON metadata sidecars, model summaries and semi-structured messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tussis.functions.clean import first_non_empty, stem, strip

# Keys that hold the location inside an input object, first one first.
OBJECT_KEYS = ["path", "name", "file_name", "filepath", "tmp_path"]

SIDECAR_SCHEMA = """
    datetime STRING, cough_detected STRING, latitude STRING, longitude STRING, age STRING,
    gender STRING, status STRING, respiratory_condition STRING, fever_muscle_pain STRING,
    expert_labels_1 STRUCT<diagnosis: STRING>, expert_labels_2 STRUCT<diagnosis: STRING>,
    expert_labels_3 STRUCT<diagnosis: STRING>
"""

SUMMARY_SCHEMA = """
    MAP<STRING, STRUCT<path: STRING, accuracy: DOUBLE, test_accuracy: DOUBLE, cv_accuracy: DOUBLE,
    f1_score: DOUBLE, sensitivity_recall: DOUBLE, precision: DOUBLE, roc_auc: DOUBLE, error: STRING>>
"""


def read_sidecars(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined) sidecars of a folder, one JSON object per file.

    A missing folder raises at once; an unreadable file goes to the second
    frame with its raw text instead of being logged and lost.
    """
    files = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    named = files.select(stem(F.col("_metadata.file_path")).alias("file_id"), "value")
    parsed = parse_json(named, "value", SIDECAR_SCHEMA)
    good = parsed.where("_corrupt IS NULL").drop("_corrupt", "value")
    return good, parsed.where("_corrupt IS NOT NULL").select("file_id", "_corrupt")


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """``df`` unchanged, or an error when it is empty."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def parse_json(df: DataFrame, column: str, schema: str, corrupt: str = "_corrupt") -> DataFrame:
    """Parse a JSON text column; text that does not parse lands in ``corrupt``."""
    fields = f"{schema}, {corrupt} STRING"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}
    # A generator keeps later filters on the parsed fields above the parse, which
    # would otherwise be repeated inside the pushed-down filter.
    return df.select("*", F.inline_outer(F.array(F.from_json(column, fields, options))))


def model_summary_rows(df: DataFrame, summary: str) -> DataFrame:
    """One row per model of a summary map; trained means an accuracy is present."""
    parsed = df.select(F.explode(F.from_json(summary, SUMMARY_SCHEMA)).alias("model", "s"))
    return parsed.select(
        "model",
        "s.path",
        "s.accuracy",
        F.when(F.col("s.accuracy").isNotNull(), "Trained").otherwise("Error").alias("status"),
    )


def message_text(content: Column) -> Column:
    """Plain text of a message that is a string, an object or a list of parts (as JSON)."""
    as_object = F.from_json(content, "text STRING, content STRING")
    as_parts = F.from_json(content, "ARRAY<STRUCT<type: STRING, text: STRING>>")
    lead = F.substring(strip(content), 1, 1)
    texts = F.transform(
        F.filter(as_parts, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))
    )
    of_object = F.coalesce(F.nullif(as_object["text"], F.lit("")), as_object["content"])
    of_string = F.from_json(F.concat(F.lit('{"v":'), content, F.lit("}")), "v STRING")["v"]
    whole = F.when(lead == "{", of_object).when(lead == "[", F.array_join(texts, "\n")).when(lead == '"', of_string)
    return F.coalesce(strip(whole), F.lit(""))


def path_in(value: Column) -> Column:
    """The location in an input that is a path or a JSON object with one; the object's keys have an order."""
    inside = F.from_json(value, ", ".join(f"{k} STRING" for k in OBJECT_KEYS))
    return F.when(strip(value).startswith("{"), first_non_empty([inside[k] for k in OBJECT_KEYS])).otherwise(value)


def source_of(*candidates: Column) -> Column:
    """First usable input location in priority order; each may be a path or an object that holds one."""
    return first_non_empty([path_in(c) for c in candidates])
