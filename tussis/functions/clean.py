"""Column expressions that normalise, coerce and derive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Accepted spellings, label mapping and the e-mail shape.
MISSING_SPELLINGS = ["", "nan", "none"]
TRUE_SPELLINGS = ["true", "1", "yes", "y", "t", "on"]
FALSE_SPELLINGS = ["false", "0", "no", "n", "f", "off"]
GENDERS = ["female", "male", "other"]
EMAIL_PATTERN = r"[^\s@]+@[^\s@]+\.[^\s@]+"
STATUS_LABELS = [
    (["covid-19", "covid"], 1, "COVID-19"),
    (["symptomatic"], 1, "Symptomatic Respiratory Infection"),
    (["healthy"], 0, "Healthy Baseline"),
]
DIAGNOSIS_LABELS = [
    (["covid-19", "covid"], 1, "COVID-19"),
    (["lower_infection", "upper_infection"], 1, "Respiratory Tract Infection"),
    (["obstructive_disease"], 1, "Obstructive Lung Condition / Wheeze"),
    (["healthy_cough"], 0, "Healthy Baseline"),
]
BINARY_TARGET = {"healthy": 0, "covid-19": 1}
DEFAULT_AGE = 35.0
DEFAULT_COUGH = 0.85

NUMBER_PATTERN = r"\A[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z"
#: White space of any script, control characters that count as such included.
WHITE_SPACE = r"[\s\p{Z}\x1c-\x1f\x85]+"


def strip(value: Column) -> Column:
    """Text without white space at either end; tabs, line ends and no-break spaces included."""
    return F.regexp_replace(value.cast("string"), rf"\A{WHITE_SPACE}|{WHITE_SPACE}\z", "")


def normalised(value: Column) -> Column:
    return F.lower(strip(value))


def clean_category(value: Column, default: str = "unknown") -> Column:
    """Trimmed lower case; nulls and spellings of "missing" become ``default``."""
    text = normalised(value)
    return F.when(text.isNull() | text.isin(MISSING_SPELLINGS), default).otherwise(text)


def clamp_domain(value: Column, allowed: Sequence[str] = tuple(GENDERS), default: str = "unknown") -> Column:
    text = normalised(value)
    return F.when(text.isin(list(allowed)), text).otherwise(default)


def to_number(value: Column) -> Column:
    """Double, or null where the text is not a plain number (no ``1d``, no NaN)."""
    text = strip(value)
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def parse_bool(value: Column, mode: str = "lenient") -> Column:
    """True/false spellings; other text gives null in strict mode, false in lenient mode.

    A missing value is false in both modes.
    """
    text = normalised(value)
    unknown = F.lit(None).cast("boolean") if mode == "strict" else F.lit(False)
    return (
        F.when(text.isNull(), False)
        .when(text.isin(TRUE_SPELLINGS), True)
        .when(text.isin(FALSE_SPELLINGS), False)
        .otherwise(unknown)
    )


def number_or(value: Column, default: float) -> Column:
    return F.coalesce(to_number(value), F.lit(float(default)))


def first_non_empty(values: Sequence[Column]) -> Column:
    """First value that is neither null nor blank, trimmed."""
    return F.coalesce(*[F.nullif(strip(v), F.lit("")) for v in values])


def first_label(values: Sequence[Column]) -> Column:
    """First nested label that is not the empty string, trimmed, lower case."""
    return F.lower(strip(F.coalesce(*[F.nullif(v.cast("string"), F.lit("")) for v in values])))


def _label_case(status: Column, diagnosis: Column, position: int) -> Column:
    result = None
    for column, rules in ((status, STATUS_LABELS), (diagnosis, DIAGNOSIS_LABELS)):
        for rule in rules:
            test, value = column.isin(rule[0]), F.lit(rule[position])
            result = F.when(test, value) if result is None else result.when(test, value)
    return result


def target_of(status: Column, diagnosis: Column) -> Column:
    """1, 0, or null when neither status nor diagnosis decides."""
    return _label_case(status, diagnosis, 1)


def is_decided(status: Column, diagnosis: Column) -> Column:
    """Status or diagnosis gives a target."""
    def known(column: Column, rules) -> Column:
        return F.coalesce(column.isin([value for rule in rules for value in rule[0]]), F.lit(False))

    return known(status, STATUS_LABELS) | known(diagnosis, DIAGNOSIS_LABELS)


def subtype_of(status: Column, diagnosis: Column) -> Column:
    return _label_case(status, diagnosis, 2)


def binary_target(status: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in BINARY_TARGET.items() for x in kv])[status]


def is_email(value: Column) -> Column:
    return F.coalesce(value.rlike(rf"\A{EMAIL_PATTERN}\z"), F.lit(False))


def id_matches(identifier: Column, needle: str) -> Column:
    """Case-insensitive substring test; a blank needle matches everything."""
    wanted = (needle or "").strip().lower()
    return F.lower(F.coalesce(identifier, F.lit(""))).contains(wanted) if wanted else F.lit(True)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)\z", 1)


def extension(path: Column) -> Column:
    """Extension with its dot, lower case, or an empty string."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)\A\.*[^.].*?(\.[^.]*)\z", 1))


def stem(path: Column) -> Column:
    name = base_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(path)))
