"""Symptom rules, score fusion and care plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tussis.functions import clinical_terms as T, keywords, rules
from tussis.functions.clinical_terms import DEFAULT_TERMS
from tussis.plans import sql_rules as S
from tussis.plans.registry import query, spread_table, sql_text
from tussis.plans.stand_ins import (
    DOCUMENT_SCREENINGS_SQL,
    DOCUMENT_TERMS,
    SCREENINGS_SQL,
    document_screenings,
    screenings,
)


def _joined(column: str):
    return F.array_join(column, "; ").alias(column)


@query("fused_result", S.sql_fused(SCREENINGS_SQL, "event_id", DEFAULT_TERMS))
def fused_result(spark, folder):
    out = rules.fuse(screenings(spark, folder), keep=["event_id"])
    return out.withColumn("symptoms_detected", _joined("symptoms_detected"))


@query("fused_result_documents", S.sql_fused(DOCUMENT_SCREENINGS_SQL, "doc_id", DOCUMENT_TERMS))
def fused_result_documents(spark, folder):
    out = rules.fuse(document_screenings(spark, folder), keep=["doc_id"], terms=DOCUMENT_TERMS)
    return out.withColumn("symptoms_detected", _joined("symptoms_detected"))




_NEGATION_CASES = [
    ("articles", ["the", "and"], ["no"]),
    ("verbs", ["is", "was"], ["no", "on", "the"]),
    ("place", ["there"], ["the", "in the", "a"]),
]


@query(
    "negation_contains",
    f"""WITH cl AS (SELECT doc_id, regexp_split_to_array(lower(text), '[.;,]') AS clause_list FROM documents)
    SELECT doc_id, {', '.join(f"{S.sql_mentions('clause_list', words, negators)} AS {name}" for name, words, negators in _NEGATION_CASES)} FROM cl""",
)
def negation_contains(spark, folder):
    d = spread_table(spark, folder, "documents").select("doc_id", "text")
    for name, words, negators in _NEGATION_CASES:
        viewed = rules.with_text_views(d, "text", negators)
        d = viewed.withColumn(name, rules.mentions(words, negators)).drop(rules.FREE, rules.GUARDED)
    return d.drop("text")


_EVENT_CLAUSES = f"""WITH src AS ({SCREENINGS_SQL}),
    cl AS (SELECT *, regexp_split_to_array(lower(notes), '[.;,]') AS clause_list FROM src)"""


@query(
    "emergency_signs",
    f"""{_EVENT_CLAUSES} SELECT event_id, array_to_string({S.sql_signs('clause_list', DEFAULT_TERMS)}, '; ') AS signs FROM cl""",
)
def emergency_signs(spark, folder):
    d = rules.with_text_views(screenings(spark, folder), "notes")
    return d.select("event_id", F.array_join(rules.emergency_signs(), "; ").alias("signs"))


_SYMPTOMS_SQL = S.sql_symptoms("clause_list", "respiratory_condition", "fever_muscle_pain", DEFAULT_TERMS)


@query(
    "symptoms_detected",
    f"""{_EVENT_CLAUSES} SELECT event_id, array_to_string({_SYMPTOMS_SQL}, '; ') AS symptoms, CAST(len({_SYMPTOMS_SQL}) AS INTEGER) AS n_symptoms FROM cl""",
)
def symptoms_detected(spark, folder):
    d = rules.with_text_views(screenings(spark, folder), "notes")
    found = rules.symptoms(F.col("respiratory_condition"), F.col("fever_muscle_pain"))
    return d.select("event_id", found.alias("found")).select(
        "event_id", F.array_join("found", "; ").alias("symptoms"), F.size("found").alias("n_symptoms")
    )




@query(
    "symptom_lexicon_join",
    f"""{_EVENT_CLAUSES}, hits AS (SELECT event_id, unnest({S.sql_labels([(n, S.sql_mentions('clause_list', w, T.NEGATORS)) for n, w in T.SYMPTOM_TERMS.items()])}) AS symptom FROM cl)
    SELECT symptom, count(*) AS n_events, min(event_id) AS first_event FROM hits GROUP BY symptom""",
)
def symptom_lexicon_join(spark, folder):
    d = rules.with_text_views(screenings(spark, folder), "notes")
    no = F.lit(False)
    hits = d.select("event_id", F.explode(rules.symptoms(no, no)).alias("symptom"))
    return hits.groupBy("symptom").agg(F.count("*").alias("n_events"), F.min("event_id").alias("first_event"))


@query(
    "classify_sound",
    f"""WITH src AS ({SCREENINGS_SQL}) SELECT event_id, {S.sql_sound('prediction', 'probability')} AS sound FROM src""",
)
def classify_sound(spark, folder):
    s = screenings(spark, folder)
    return s.select("event_id", rules.sound_class(F.col("prediction"), F.col("probability")).alias("sound"))


@query(
    "classify_symptoms",
    f"""{_EVENT_CLAUSES}, f AS (SELECT event_id, {_SYMPTOMS_SQL} AS found FROM cl)
    SELECT event_id, {S.sql_symptom_class('found')} AS symptom_class FROM f""",
)
def classify_symptoms(spark, folder):
    d = rules.with_text_views(screenings(spark, folder), "notes")
    d = d.withColumn("found", rules.symptoms(F.col("respiratory_condition"), F.col("fever_muscle_pain")))
    return d.select("event_id", rules.symptom_class(F.col("found")).alias("symptom_class"))


_PLANNED_SQL = f"""{_EVENT_CLAUSES}, tag AS (SELECT *, len({S.sql_signs('clause_list', DEFAULT_TERMS)}) > 0 AS urgent,
        (prediction = 1 OR probability >= 0.5) AS acoustic FROM cl),
    planned AS (SELECT event_id, urgent, acoustic,
        {S.sql_plan('clause_list', 'urgent', 'acoustic', 'respiratory_condition', 'fever_muscle_pain', 'age', DEFAULT_TERMS)} AS plan_id FROM tag)"""


@query(
    "care_plan",
    f"""{_PLANNED_SQL} SELECT event_id, plan_id, CASE WHEN urgent THEN {sql_text(T.SEVERITY_URGENT)}
        WHEN acoustic THEN {sql_text(T.SEVERITY_DISEASE)} ELSE {sql_text(T.SEVERITY_HEALTHY)} END AS severity FROM planned""",
)
def care_plan(spark, folder):
    return rules.fuse(screenings(spark, folder), keep=["event_id"]).select("event_id", "plan_id", "severity")


_PLAN_VALUES = ", ".join(
    f"({sql_text(plan)}, {i}, {sql_text(title)}, {sql_text(body)})"
    for plan, steps in T.CARE_PLANS.items()
    for i, (title, body) in enumerate(steps, 1)
)


@query(
    "care_plan_rows",
    f"""{_PLANNED_SQL}, steps(plan_id, seq, title, body) AS (VALUES {_PLAN_VALUES})
    SELECT event_id, plan_id, CAST(seq AS INTEGER) AS seq, title, body FROM planned JOIN steps USING (plan_id)""",
)
def care_plan_rows(spark, folder):
    planned = rules.fuse(screenings(spark, folder), keep=["event_id"]).select("event_id", "plan_id")
    steps = planned.select("event_id", "plan_id", F.posexplode(rules.care_plan_steps(F.col("plan_id"))).alias("at", "step"))
    return steps.select("event_id", "plan_id", (F.col("at") + 1).alias("seq"), "step.title", "step.body")


@query(
    "display_label",
    f"""{_PLANNED_SQL}, p AS (SELECT event_id, urgent, acoustic, prediction, probability FROM planned JOIN src USING (event_id))
    SELECT event_id, CASE WHEN urgent THEN 'Urgent review' WHEN acoustic THEN 'Disease' ELSE 'Healthy' END AS label,
      round(CASE WHEN urgent THEN greatest(probability, 1 - probability) WHEN acoustic THEN probability ELSE 1 - probability END, 6) AS confidence
    FROM p""",
)
def display_label(spark, folder):
    d = rules.with_text_views(screenings(spark, folder), "notes").withColumn("urgent", F.size(rules.emergency_signs()) > 0)
    args = (F.col("urgent"), F.col("prediction"), F.col("probability"))
    return d.select(
        "event_id",
        rules.display_label(*args).alias("label"),
        F.round(rules.display_confidence(*args), 6).alias("confidence"),
    )


@query(
    "clinician_fields",
    f"""WITH src AS ({SCREENINGS_SQL}), r AS (SELECT *, CASE WHEN prediction = 1 THEN 'Possible Disease' ELSE 'Healthy' END AS label,
        CASE WHEN probability >= 0.7 THEN 'HIGH' ELSE 'low' END AS risk FROM src),
    f AS (SELECT event_id, notes, (contains(lower(label), 'disease') OR lower(risk) = 'high') AS sick FROM r)
    SELECT event_id, CASE WHEN sick THEN {sql_text(T.SUMMARY_DISEASE)} ELSE {sql_text(T.SUMMARY_HEALTHY)} END AS summary,
        CASE WHEN sick THEN {sql_text(T.TIER_DISEASE)} ELSE {sql_text(T.TIER_HEALTHY)} END AS priority_tier,
        CASE WHEN sick THEN {sql_text(T.PHENOTYPE_DISEASE)} ELSE {sql_text(T.PHENOTYPE_HEALTHY)} END AS phenotype,
        CASE WHEN sick OR contains(lower(notes), 'phlegm') OR contains(lower(notes), 'wet') THEN {sql_text(T.SECRETION_HIGH)}
             ELSE {sql_text(T.SECRETION_NORMAL)} END AS secretion FROM f""",
)
def clinician_fields(spark, folder):
    s = (
        screenings(spark, folder)
        .withColumn("label", F.when(F.col("prediction") == 1, "Possible Disease").otherwise("Healthy"))
        .withColumn("risk", F.when(F.col("probability") >= 0.7, "HIGH").otherwise("low"))
    )
    return rules.clinician_fields(s, label="label", risk="risk", notes="notes", keep=["event_id"])


_ALL_DOCUMENT_TERMS = {
    f"{kind}: {name}": words
    for kind, lexicon in (("symptom", DOCUMENT_TERMS.symptoms), ("sign", DOCUMENT_TERMS.emergencies), ("plan", DOCUMENT_TERMS.plans))
    for name, words in lexicon.items()
}
_ALL_TERMS = {f"symptom: {n}": w for n, w in T.SYMPTOM_TERMS.items()} | {f"sign: {n}": w for n, w in DEFAULT_TERMS.emergencies.items()}


@query(
    "lexicon_automaton",
    f"""{_EVENT_CLAUSES} SELECT event_id, array_to_string({S.sql_labels([(n, S.sql_mentions('clause_list', w, DEFAULT_TERMS.negators)) for n, w in _ALL_TERMS.items()])}, '; ') AS labels FROM cl""",
)
def lexicon_automaton(spark, folder):
    labels = keywords.lexicon_labels(F.col("notes"), _ALL_TERMS, DEFAULT_TERMS.negators)
    return screenings(spark, folder).select("event_id", F.array_join(labels, "; ").alias("labels"))


@query(
    "lexicon_automaton_documents",
    f"""WITH cl AS (SELECT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '[.;,]') AS clause_list FROM documents)
    SELECT doc_id, array_to_string({S.sql_labels([(n, S.sql_mentions('clause_list', w, DOCUMENT_TERMS.negators)) for n, w in _ALL_DOCUMENT_TERMS.items()])}, '; ') AS labels FROM cl""",
)
def lexicon_automaton_documents(spark, folder):
    labels = keywords.lexicon_labels(F.col("text"), _ALL_DOCUMENT_TERMS, DOCUMENT_TERMS.negators)
    return spread_table(spark, folder, "documents").select("doc_id", F.array_join(labels, "; ").alias("labels"))
