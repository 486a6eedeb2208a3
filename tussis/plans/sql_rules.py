"""SQL spellings of the text rules, used only by the SQL twins."""

from __future__ import annotations

from tussis.functions import clinical_terms as T
from tussis.functions.rules import negator_pattern
from tussis.plans.registry import sql_text


def sql_mentions(clauses: str, keywords, negators) -> str:
    """Boolean SQL: some keyword occurs in some clause without a negator before it."""
    tests = []
    for k in keywords:
        key, neg = sql_text(k.lower()), sql_text(negator_pattern(negators))
        tests.append(
            f"len(list_filter({clauses}, lambda c: contains(c, {key}) AND "
            f"len(list_filter(range(1, len(string_split(c, {key}))), lambda i: "
            f"NOT regexp_matches(array_to_string(string_split(c, {key})[1:i], {key}), {neg}))) > 0)) > 0"
        )
    return "(" + " OR ".join(tests) + ")"


def sql_labels(tests) -> str:
    """Sorted distinct labels whose test holds, as a list."""
    flags = ", ".join(f"CASE WHEN {test} THEN {sql_text(label)} END" for label, test in tests)
    return f"list_sort(list_distinct(list_filter([{flags}], lambda x: x IS NOT NULL)))"


def sql_signs(clauses: str, terms: T.ClinicalTerms) -> str:
    return sql_labels([(n, sql_mentions(clauses, w, terms.negators)) for n, w in terms.emergencies.items()])


def sql_symptoms(clauses: str, resp: str, fever: str, terms: T.ClinicalTerms) -> str:
    tests = [(T.FEVER_FLAG_LABEL, fever), (T.RESPIRATORY_FLAG_LABEL, resp)]
    tests += [(n, sql_mentions(clauses, w, terms.negators)) for n, w in terms.symptoms.items()]
    return sql_labels(tests)


def sql_sound(pred: str, prob: str) -> str:
    return f"""CASE WHEN {pred} = 0 AND {prob} < 0.40 THEN {sql_text(T.SOUND_HEALTHY)}
        WHEN {pred} = 0 THEN {sql_text(T.SOUND_MOSTLY_HEALTHY)}
        WHEN {prob} >= 0.75 THEN {sql_text(T.SOUND_STRONG)}
        WHEN {prob} >= 0.50 THEN {sql_text(T.SOUND_MODERATE)}
        ELSE {sql_text(T.SOUND_OTHER)} END"""


def sql_symptom_class(found: str) -> str:
    return f"""CASE WHEN len({found}) = 0 THEN {sql_text(T.SYMPTOMS_NONE)}
        WHEN list_has_any({found}, ['fever/body pain', 'cold', 'fatigue', 'chills']) THEN {sql_text(T.SYMPTOMS_VIRAL)}
        WHEN list_has_any({found}, ['breathing', 'respiratory condition', 'cough']) THEN {sql_text(T.SYMPTOMS_RESPIRATORY)}
        ELSE {sql_text(T.SYMPTOMS_OTHER)} END"""


def sql_plan(clauses: str, urgent: str, disease: str, resp: str, fever: str, age: str, terms: T.ClinicalTerms) -> str:
    said = {plan: sql_mentions(clauses, words, terms.negators) for plan, words in terms.plans.items()}
    return f"""CASE WHEN {urgent} THEN 'emergency' WHEN NOT ({disease}) THEN 'healthy'
        WHEN {fever} OR {said['fever']} THEN 'fever'
        WHEN {resp} OR {said['respiratory']} THEN 'respiratory'
        WHEN {said['productive']} THEN 'productive'
        WHEN {age} >= 60 AND ({resp} OR {said['copd']}) THEN 'copd'
        ELSE 'generic' END"""


def sql_fused(source: str, keep: str, terms: T.ClinicalTerms) -> str:
    """SELECT of the fused result over ``source`` with columns
    prediction, probability, notes, respiratory_condition, fever_muscle_pain, age."""
    t = sql_text
    return f"""
    WITH src AS ({source}),
    cl AS (SELECT *, regexp_split_to_array(lower(coalesce(notes, '')), '[.;,]') AS clause_list FROM src),
    tag AS (SELECT *, {sql_signs('clause_list', terms)} AS signs,
        {sql_symptoms('clause_list', 'respiratory_condition', 'fever_muscle_pain', terms)} AS found,
        (prediction = 1 OR probability >= 0.50) AS acoustic FROM cl),
    u AS (SELECT *, len(signs) > 0 AS urgent FROM tag)
    SELECT {keep},
        CAST(urgent OR acoustic AS INTEGER) AS prediction,
        CASE WHEN urgent THEN 'urgent' WHEN acoustic THEN 'covid-19' ELSE 'healthy' END AS status,
        (urgent OR acoustic) AS is_disease,
        CASE WHEN urgent OR acoustic THEN 'Disease' ELSE 'Healthy' END AS disease_name,
        {sql_sound('prediction', 'probability')} AS sound_classification,
        CASE WHEN urgent THEN {t(T.SYMPTOMS_EMERGENCY)} ELSE {sql_symptom_class('found')} END AS symptom_classification,
        CASE WHEN urgent THEN {t(T.FINAL_URGENT)} WHEN acoustic THEN {t(T.FINAL_DISEASE)} ELSE {t(T.FINAL_HEALTHY)} END AS final_classification,
        CASE WHEN urgent THEN 'high' WHEN acoustic THEN CASE WHEN probability >= 0.70 THEN 'high' ELSE 'medium' END ELSE 'low' END AS risk_level,
        probability AS confidence,
        array_to_string(CASE WHEN urgent THEN list_concat(signs, found) WHEN len(found) = 0 THEN [{t(T.NO_SYMPTOMS_LABEL)}] ELSE found END, '; ') AS symptoms_detected,
        CASE WHEN urgent THEN {t(T.ADVICE_URGENT)} WHEN acoustic THEN {t(T.ADVICE_DISEASE)} ELSE {t(T.ADVICE_HEALTHY)} END AS recommendation,
        {sql_plan('clause_list', 'urgent', 'acoustic', 'respiratory_condition', 'fever_muscle_pain', 'age', terms)} AS plan_id,
        CASE WHEN urgent THEN {t(T.SEVERITY_URGENT)} WHEN acoustic THEN {t(T.SEVERITY_DISEASE)} ELSE {t(T.SEVERITY_HEALTHY)} END AS severity
    FROM u"""
