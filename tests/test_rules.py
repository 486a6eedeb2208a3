"""Published rule assertions, preset notes, boundaries, and a scan-by-hand property test."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tussis.functions import clinical_terms as T, rules

SCHEMA = "prediction INT, probability DOUBLE, notes STRING, respiratory_condition BOOLEAN, fever_muscle_pain BOOLEAN, age DOUBLE"


def fuse(spark, *rows):
    return [r.asDict() for r in rules.fuse(spark.createDataFrame(list(rows), SCHEMA)).collect()]


def test_published_assertions(spark):
    healthy, viral, urgent = fuse(
        spark,
        (0, 0.10, "no symptoms", False, False, 35.0),
        (1, 0.72, "fever and body pain", True, True, 35.0),
        (0, 0.95, "gasping and blue lips with severe chest tightness", False, False, 35.0),
    )
    assert healthy["final_classification"] == "Healthy / normal"
    assert healthy["sound_classification"] == "Healthy / normal sound"
    assert healthy["symptoms_detected"] == ["No symptoms reported"]
    assert viral["final_classification"] == "Possible Disease"
    assert viral["symptom_classification"] == "Possible viral infection"
    assert viral["risk_level"] == "high"
    assert (urgent["status"], urgent["risk_level"], urgent["prediction"]) == ("urgent", "high", 1)
    assert urgent["symptoms_detected"] == ["blue/grey lips or skin", "breathing emergency", "severe chest tightness/heaviness", "breathing"]
    assert urgent["plan_id"] == "emergency"


SYMPTOM_CASES = [
    ("Patient asymptomatic, normal lung auscultation, clear breathing, no fever, no chills, no fatigue.", False, False, ["breathing"]),
    ("Dry persistent cough for 4 days, mild throat irritation, fatigue, low-grade temperature.", False, True, ["cough", "fatigue", "fever", "fever/body pain"]),
    ("Expiratory wheezing, tight chest sensation, nocturnal cough bouts with mild shortness of breath.", True, False, ["breathing", "cough", "respiratory condition"]),
    ("Deep chest cough, heavy phlegm production, high fever 101.5F, muscular myalgia, chills.", False, True, ["chills", "cough", "fever", "fever/body pain"]),
    ("Routine pediatric health checkup, clear lungs, normal respiration, active playful demeanor, no symptoms.", False, False, []),
    ("Senior routine wellness examination, clear breath sounds, normal vital signs, no acute symptoms.", False, False, ["breathing"]),
    ("Deep persistent cough bouts, high fever 101.8F, muscle soreness, fatigue, chest congestion.", False, True, ["cold", "cough", "fatigue", "fever", "fever/body pain"]),
    ("Persistent cough, high fever 102F, body pain and chills", False, True, ["body_pain", "chills", "cough", "fever", "fever/body pain"]),
    ("denies fever; gunshot noise", False, False, ["fever"]),
    ("no fever or cough, but cold", False, False, ["cold"]),
    ("nofever fever", False, False, ["fever"]),
    ("", False, False, []),
    (None, False, False, []),
]


def test_symptom_sets(spark):
    df = spark.createDataFrame([(i, n, r, f) for i, (n, r, f, _) in enumerate(SYMPTOM_CASES)], "i INT, notes STRING, r BOOLEAN, f BOOLEAN")
    got = rules.with_text_views(df, "notes").select("i", rules.symptoms(F.col("r"), F.col("f")).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in got] == [c[3] for c in SYMPTOM_CASES]


def test_probability_boundaries(spark):
    rows = [(p, v, "", False, False, 35.0) for p in (0, 1) for v in (0.39, 0.40, 0.50, 0.70, 0.75)]
    got = fuse(spark, *rows)
    assert [g["sound_classification"] for g in got[:5]] == [T.SOUND_HEALTHY] + [T.SOUND_MOSTLY_HEALTHY] * 4
    assert [g["sound_classification"] for g in got[5:]] == [T.SOUND_OTHER, T.SOUND_OTHER, T.SOUND_MODERATE, T.SOUND_MODERATE, T.SOUND_STRONG]
    assert [g["risk_level"] for g in got] == ["low", "low", "medium", "high", "high", "medium", "medium", "medium", "high", "high"]


def test_plan_order_and_age_boundary(spark):
    got = fuse(
        spark,
        (1, 0.6, "mucus and fever", True, False, 70.0),
        (1, 0.6, "mucus", True, False, 70.0),
        (1, 0.6, "mucus", False, False, 70.0),
        (1, 0.6, "smoker", False, False, 59.9),
        (1, 0.6, "smoker", False, False, 60.0),
        (0, 0.1, "fever", False, False, 35.0),
    )
    assert [g["plan_id"] for g in got] == ["fever", "respiratory", "productive", "generic", "copd", "healthy"]


def scan(text: str, keyword: str, negators) -> bool:
    """Walk the occurrences by hand and look for a negator between the clause start and each."""
    low, at = text.lower(), 0
    patterns = [re.compile(r"\b" + r"\s+".join(map(re.escape, n.split())) + r"\b") for n in negators]
    while (at := low.find(keyword, at)) >= 0:
        clause = re.split(r"[.;,]", low[:at])[-1]
        if not any(p.search(clause) for p in patterns):
            return True
        at += len(keyword)
    return False


def test_mentions_against_scan(spark):
    rng = random.Random(7)
    pieces = ["no", "not", "fever", "hot", "cough", "clear of", "clear  of", "of breath", "nofever", " ", " ", "  ", ". ", ",", ";", "\n", "é", "snow", "zero", "x", "_", "without", "breath", "-"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    words = ["fever", "hot", "of breath", "breath", "no"]
    df = rules.with_text_views(spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING"), "t")
    got = df.select("i", *[rules.mentions([w]).alias(w) for w in words]).orderBy("i").collect()
    wrong = [(texts[r["i"]], w) for r in got for w in words if r[w] != scan(texts[r["i"]], w, T.NEGATORS)]
    assert wrong == []


def test_whole_word_option(spark):
    df = rules.with_text_views(spark.createDataFrame([("gunshot",), ("hot day",)], "t STRING"), "t")
    cols = [rules.mentions(["hot"], whole_word=w).alias(str(w)) for w in (False, True)]
    assert [tuple(r) for r in df.select(*cols).collect()] == [(True, False), (True, True)]


def test_long_text_without_clause_marks(spark):
    """Tens of thousands of repeated words in one clause stay cheap and exact."""
    text = "fever " * 20000
    df = rules.with_text_views(spark.createDataFrame([("no " + text,), (text,), ("nofever " * 2000 + "fever",)], "t STRING"), "t")
    got = [r[0] for r in df.select(rules.mentions(["fever"])).collect()]
    assert got == [False, True, True]


def test_keyword_across_clauses_is_refused():
    with pytest.raises(ValueError):
        rules.mentions(["a, b"])


@pytest.mark.parametrize("plan", list(T.CARE_PLANS))
def test_every_plan_has_steps(spark, plan):
    steps = spark.range(1).select(rules.care_plan_steps(F.lit(plan)).alias("s")).first()["s"]
    assert [(s["title"], s["body"]) for s in steps] == T.CARE_PLANS[plan]
