"""Report and chat text: cleaning, escaping, keys, dates, scripts."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from tussis.functions.clean import WHITE_SPACE

# Escapes, scripts and formats.
HTML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]
SCRIPTS = [
    ("kannada", r"[ಀ-೿]"),
    ("telugu", r"[ఀ-౿]"),
    ("hindi", r"[ऀ-ॿ]"),
]
REPORT_DATE = "dd MMMM yyyy, hh:mm a"
SUMMARY_CHARS, REPORT_CHARS = 850, 1800


def plain_text(html: Column, limit: int | None = None) -> Column:
    """Tags to blanks, white space collapsed; ``limit`` is for one-page reports."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"<[^>]+>", " ")
    text = F.trim(F.regexp_replace(text, WHITE_SPACE, " "))
    return F.substring(text, 1, limit) if limit else text


def report_summary(result_html: Column, details_html: Column) -> Column:
    """The summary paragraph of a one-page report."""
    return plain_text(F.concat_ws(" ", result_html, details_html), SUMMARY_CHARS)


def report_message(key: Column, result_html: Column, details_html: Column, title: str = "Respiratory screening report") -> Column:
    """The plain-text body of a report message."""
    lead = F.concat(F.lit(f"{title} | Patient ID: "), key, F.lit("\n"))
    return plain_text(F.concat(lead, F.concat_ws(" ", result_html, details_html)), REPORT_CHARS)


def html_escape(text: Column) -> Column:
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), HTML_ESCAPES, text)


def percent_encode(text: Column) -> Column:
    """Percent encoding that keeps ``/`` and ``~`` and writes a blank as %20.

    ``url_encode`` is form encoding, so its blank, star, tilde and slash are put right.
    """
    encoded = F.url_encode(text)
    for form, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        encoded = F.replace(encoded, F.lit(form), F.lit(plain))
    return encoded


def digits_only(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^0-9]", "")


def title_case(text: Column) -> Column:
    """Capital after every non-letter, as in "2Nd" and "O'Neil"."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, F.lit(2), F.length(r))))), "")


def display_name(filename: Column, suffix: str = ".joblib") -> Column:
    bare = F.regexp_replace(filename, re.escape(suffix) + r"\z", "")
    return title_case(F.replace(bare, F.lit("_"), F.lit(" ")))


def script_of(text: Column, hint: Column | None = None, scripts: Sequence[tuple[str, str]] = tuple(SCRIPTS), default: str = "english") -> Column:
    """First script whose characters occur, or whose name the hint contains."""
    hinted = F.lower(F.coalesce(hint, F.lit(""))) if hint is not None else F.lit("")
    result = None
    for name, pattern in scripts:
        test = text.rlike(pattern) | hinted.contains(name)
        result = F.when(test, name) if result is None else result.when(test, name)
    return result.otherwise(default)


def report_key(identifier: Column, day: Column, prefix: str = "SCR") -> Column:
    """PREFIX-YYYYMMDD-HEX6, the same for the same assessment."""
    digest = F.upper(F.substring(F.sha2(identifier.cast("string"), 256), 1, 6))
    return F.concat_ws("-", F.lit(prefix), F.date_format(day, "yyyyMMdd"), digest)


def report_date(ts: Column) -> Column:
    return F.date_format(ts, REPORT_DATE)


def verification_line(patient: Column, label: Column, confidence: Column, ts: Column, issuer: str = "Screening") -> Column:
    return F.format_string("%s report|%s|%s|%.4f|%s", F.lit(issuer), patient, label, confidence, F.date_format(ts, "yyyy-MM-dd"))


def soap_note(patient: Column, ts: Column, age: Column, gender: Column, notes: Column, respiratory: Column, fever: Column,
              summary: Column, risk: Column, tier: Column, phenotype: Column, model: Column, confidence: Column) -> Column:
    """Subjective / objective / assessment / plan text of one screening.

    Only values of the row appear; no measured quantity is made up.
    """
    said = F.coalesce(F.nullif(notes, F.lit("")), F.lit("None specified"))
    return F.format_string(
        "PATIENT ID: %s | DATE: %s\n"
        "DEMOGRAPHICS: Age %d, %s\n"
        "RESPIRATORY CONDITION: %s | FEVER/MYALGIA: %s\n"
        "[S] Reported symptoms: \"%s\".\n"
        "[O] Model %s, confidence %.1f%%. Phenotype: %s.\n"
        "[A] %s. Risk: %s (%s).\n"
        "[P] %s",
        patient, report_date(ts), age, title_case(gender), respiratory.cast("string"), fever.cast("string"), said,
        model, confidence * 100, phenotype, summary, F.upper(risk), tier,
        F.when(F.lower(risk) == "high", "In-person clinical evaluation advised.").otherwise("Routine observation; re-screen if symptoms persist."),
    )
