"""Negation-aware text rules and the fusion of model score and symptom text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tussis.functions import clinical_terms as T

WORD = r"\p{L}\p{N}_"
CLAUSE_BREAK = "[.;,]"
FREE, GUARDED = "__free", "__guarded"  # the two views of a text


def negator_alternatives(negators: Iterable[str]) -> str:
    """Regex alternatives; inner blanks match any run of white space."""
    return "|".join(r"[\s\p{Z}]+".join(re.escape(w) for w in n.lower().split()) for n in negators)


def negator_pattern(negators: Iterable[str]) -> str:
    """Any negator as a whole word."""
    return rf"(?:^|[^{WORD}])(?:{negator_alternatives(negators)})(?:\z|[^{WORD}])"


def negator_start(negators: Iterable[str]) -> str:
    """Any negator at the start of a word; a text without it has no negator before any of its words."""
    return rf"(?:^|[^{WORD}])(?:{negator_alternatives(negators)})"


def clauses(lowered: Column) -> Column:
    """Lower-cased text cut at sentence and clause marks."""
    return F.split(lowered, CLAUSE_BREAK, -1)


def _keyword_pattern(keyword: str, whole_word: bool) -> str:
    quoted = rf"\Q{keyword}\E"
    return rf"(?<![{WORD}]){quoted}(?![{WORD}])" if whole_word else quoted


def _quoted(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _affirmed(keyword: str, negators: Sequence[str], whole_word: bool) -> Column:
    """Some occurrence of ``keyword`` in a guarded clause has no negator before it.

    Written as one SQL expression: a lexicon has dozens of keywords, and nested
    lambdas are slow to assemble call by call.
    """
    word = _quoted(keyword)
    # Whatever starts after a complete negator is negated, so only the head counts.
    complete = _quoted(rf"(?s)^.*?(?<![{WORD}])(?:{negator_alternatives(negators)})(?![{WORD}])")
    reach = f"length(regexp_extract(c, {complete}, 0))"
    head = f"if({reach} > 0, substring(c, 1, {reach} + {len(keyword) - 1}), c)"
    parts = f"split({head}, {_quoted(_keyword_pattern(keyword, whole_word))}, -1)"
    return F.expr(
        f"""exists({GUARDED}, c -> contains(c, {word}) AND exists(transform(array({parts}), p ->
            exists(filter(sequence(0, size(p) - 1), i -> i > 0),
                   i -> NOT rlike(array_join(slice(p, 1, i), {word}), {_quoted(negator_pattern(negators))}))), x -> x))"""
    )


def with_text_views(df: DataFrame, text: str, negators: Sequence[str] = tuple(T.NEGATORS)) -> DataFrame:
    """Add the two views of a text that the keyword tests read, computed once per row.

    ``__free`` joins the clauses in which no negator occurs, where any keyword
    counts; ``__guarded`` lists the others, which need a look at what precedes it.
    """
    start = negator_start(negators)
    cut = df.withColumn("__clauses", clauses(F.lower(F.coalesce(F.col(text), F.lit("")))))
    viewed = cut.withColumn(GUARDED, F.filter("__clauses", lambda c: c.rlike(start)))
    return viewed.withColumn(FREE, F.array_join(F.array_except("__clauses", GUARDED), ".")).drop("__clauses")


def mentions(keywords: Sequence[str], negators: Sequence[str] = tuple(T.NEGATORS), whole_word: bool = False) -> Column:
    """True when any keyword occurs un-negated, read from the text views.

    The views must have been made with the same negators. Keywords match as
    substrings unless ``whole_word``.
    """

    def in_free(keyword: str) -> Column:
        return F.col(FREE).rlike(_keyword_pattern(keyword, True)) if whole_word else F.col(FREE).contains(F.lit(keyword))

    def one(keyword: str) -> Column:
        if re.search(CLAUSE_BREAK, keyword):
            raise ValueError(f"a keyword must lie within a clause: {keyword!r}")
        return in_free(keyword) | _affirmed(keyword, negators, whole_word)

    return reduce(lambda a, b: a | b, [one(k.lower()) for k in keywords])


def _labels(tests: Sequence[tuple[str, Column]]) -> Column:
    """Sorted labels whose test holds."""
    flags = F.array(*[F.when(test, F.lit(label)) for label, test in tests])
    return F.array_sort(F.array_distinct(F.filter(flags, lambda x: x.isNotNull())))


def emergency_signs(terms: T.ClinicalTerms = T.DEFAULT_TERMS) -> Column:
    return _labels([(label, mentions(words, terms.negators)) for label, words in terms.emergencies.items()])


def symptoms(respiratory: Column, fever: Column, terms: T.ClinicalTerms = T.DEFAULT_TERMS) -> Column:
    tests = [(T.FEVER_FLAG_LABEL, fever), (T.RESPIRATORY_FLAG_LABEL, respiratory)]
    tests += [(name, mentions(words, terms.negators)) for name, words in terms.symptoms.items()]
    return _labels(tests)


def sound_class(prediction: Column, probability: Column) -> Column:
    return (
        F.when((prediction == 0) & (probability < T.CLEAN_SOUND_PROBABILITY), T.SOUND_HEALTHY)
        .when(prediction == 0, T.SOUND_MOSTLY_HEALTHY)
        .when(probability >= T.STRONG_SOUND_PROBABILITY, T.SOUND_STRONG)
        .when(probability >= T.DISEASE_PROBABILITY, T.SOUND_MODERATE)
        .otherwise(T.SOUND_OTHER)
    )


def symptom_class(found: Column) -> Column:
    def has(*labels: str) -> Column:
        return F.arrays_overlap(found, F.array(*[F.lit(x) for x in labels]))

    return (
        F.when(F.size(found) == 0, T.SYMPTOMS_NONE)
        .when(has(T.FEVER_FLAG_LABEL, "cold", "fatigue", "chills"), T.SYMPTOMS_VIRAL)
        .when(has("breathing", T.RESPIRATORY_FLAG_LABEL, "cough"), T.SYMPTOMS_RESPIRATORY)
        .otherwise(T.SYMPTOMS_OTHER)
    )


def acoustic_disease(prediction: Column, probability: Column) -> Column:
    return (prediction == 1) | (probability >= T.DISEASE_PROBABILITY)


def care_plan_id(emergency: Column, disease: Column, respiratory: Column, fever: Column, age: Column,
                 terms: T.ClinicalTerms = T.DEFAULT_TERMS) -> Column:
    def said(plan: str) -> Column:
        return mentions(terms.plans[plan], terms.negators)

    return (
        F.when(emergency, "emergency")
        .when(~disease, "healthy")
        .when(fever | said("fever"), "fever")
        .when(respiratory | said("respiratory"), "respiratory")
        .when(said("productive"), "productive")
        .when((age >= T.COPD_AGE) & (respiratory | said("copd")), "copd")
        .otherwise("generic")
    )


def fuse(
    df: DataFrame,
    *,
    prediction: str = "prediction",
    probability: str = "probability",
    notes: str = "notes",
    respiratory: str = "respiratory_condition",
    fever: str = "fever_muscle_pain",
    age: str = "age",
    keep: Sequence[str] = (),
    terms: T.ClinicalTerms = T.DEFAULT_TERMS,
) -> DataFrame:
    """Screening result per row: emergency text, then acoustics, then healthy.

    A chain of projections: no shuffle and no Python worker. ``probability`` is
    always the disease probability.
    """
    pred, prob = F.col(prediction), F.col(probability).cast("double")
    resp, fev = F.coalesce(F.col(respiratory), F.lit(False)), F.coalesce(F.col(fever), F.lit(False))
    years = F.coalesce(F.col(age).cast("double"), F.lit(35.0))

    tagged = (
        with_text_views(df, notes, terms.negators)
        .withColumn("__signs", emergency_signs(terms))
        .withColumn("__symptoms", symptoms(resp, fev, terms))
        .withColumn("__urgent", F.size("__signs") > 0)
        .withColumn("__disease", acoustic_disease(pred, prob))
    )
    urgent, disease, found = F.col("__urgent"), F.col("__disease"), F.col("__symptoms")

    def pick(if_urgent, if_disease, if_healthy) -> Column:
        return F.when(urgent, if_urgent).when(disease, if_disease).otherwise(if_healthy)

    return tagged.select(
        *keep,
        (urgent | disease).cast("int").alias("prediction"),
        pick(F.lit("urgent"), F.lit("covid-19"), F.lit("healthy")).alias("status"),
        (urgent | disease).alias("is_disease"),
        F.when(urgent | disease, "Disease").otherwise("Healthy").alias("disease_name"),
        sound_class(pred, prob).alias("sound_classification"),
        F.when(urgent, T.SYMPTOMS_EMERGENCY).otherwise(symptom_class(found)).alias("symptom_classification"),
        pick(F.lit(T.FINAL_URGENT), F.lit(T.FINAL_DISEASE), F.lit(T.FINAL_HEALTHY)).alias("final_classification"),
        pick(
            F.lit("high"),
            F.when(prob >= T.HIGH_RISK_PROBABILITY, "high").otherwise("medium"),
            F.lit("low"),
        ).alias("risk_level"),
        prob.alias("confidence"),
        F.when(urgent, F.concat("__signs", found))
        .when(F.size(found) == 0, F.array(F.lit(T.NO_SYMPTOMS_LABEL)))
        .otherwise(found)
        .alias("symptoms_detected"),
        pick(F.lit(T.ADVICE_URGENT), F.lit(T.ADVICE_DISEASE), F.lit(T.ADVICE_HEALTHY)).alias("recommendation"),
        care_plan_id(urgent, disease, resp, fev, years, terms).alias("plan_id"),
        pick(F.lit(T.SEVERITY_URGENT), F.lit(T.SEVERITY_DISEASE), F.lit(T.SEVERITY_HEALTHY)).alias("severity"),
    )


def care_plan_steps(plan_id: Column) -> Column:
    """Array of (title, body) for a plan id."""
    plans = F.create_map(
        *[
            item
            for name, steps in T.CARE_PLANS.items()
            for item in (
                F.lit(name),
                F.array(*[F.struct(F.lit(t).alias("title"), F.lit(b).alias("body")) for t, b in steps]),
            )
        ]
    )
    return F.element_at(plans, plan_id)


def display_label(urgent: Column, prediction: Column, disease_probability: Column) -> Column:
    return (
        F.when(urgent, "Urgent review")
        .when(acoustic_disease(prediction, disease_probability), "Disease")
        .otherwise("Healthy")
    )


def display_confidence(urgent: Column, prediction: Column, disease_probability: Column) -> Column:
    """Class confidence when urgent, else the probability of the shown class."""
    return (
        F.when(urgent, F.greatest(disease_probability, 1 - disease_probability))
        .when(acoustic_disease(prediction, disease_probability), disease_probability)
        .otherwise(1 - disease_probability)
    )


def clinician_fields(df: DataFrame, *, label: str, risk: str, notes: str, keep: Sequence[str] = ()) -> DataFrame:
    """Summary, tier, phenotype and secretion score for the clinician view."""
    disease = F.lower(F.col(label)).contains("disease") | (F.lower(F.col(risk)) == "high")
    disease = F.coalesce(disease, F.lit(False))
    wet = reduce(lambda a, b: a | b, [F.lower(F.coalesce(F.col(notes), F.lit(""))).contains(t) for t in T.SECRETION_TERMS])

    def either(yes: str, no: str) -> Column:
        return F.when(disease, yes).otherwise(no)

    return df.select(
        *keep,
        either(T.SUMMARY_DISEASE, T.SUMMARY_HEALTHY).alias("summary"),
        either(T.TIER_DISEASE, T.TIER_HEALTHY).alias("priority_tier"),
        either(T.PHENOTYPE_DISEASE, T.PHENOTYPE_HEALTHY).alias("phenotype"),
        F.when(disease | wet, T.SECRETION_HIGH).otherwise(T.SECRETION_NORMAL).alias("secretion"),
    )
