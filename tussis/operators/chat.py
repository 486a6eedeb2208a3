"""Routing and context of chat messages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tussis.functions.clean import strip
from tussis.functions.text import SCRIPTS, script_of

# How many messages form a context, and the ordered routing terms.
CONTEXT_MESSAGES = 12
EMERGENCY_PHRASES = ["emergency", "can't breathe", "cannot breathe", "blue lips", "chest pain", "severe dyspnea"]
LOCAL_TOPICS = {
    "kannada": [
        ("precautions", ["ಮುನ್ನೆಚ್ಚರಿಕೆ", "ಜಾಗರೂಕತೆ", "ಕಡಿಮೆ", "ಮನೆಮದ್ದು", "ಪರಿಹಾರ", "precaution", "remedy", "cure"]),
        ("diseases", ["ರೋಗ", "ಖಾಯಿಲೆ", "ಕೋವಿಡ್", "ಆಸ್ತಮಾ", "ನ್ಯುಮೋನಿಯಾ", "disease", "covid", "asthma"]),
        ("models", ["ನಿಖರತೆ", "ಮಾದರಿ", "ಅಕ್ಯುರೆಸಿ", "accuracy", "model", "algorithm"]),
        ("recording", ["ರೆಕಾರ್ಡ್", "ಮೈಕ್", "ಧ್ವನಿ", "record", "audio", "mic"]),
    ],
    "telugu": [
        ("precautions", ["జాగ్రత్త", "నివారణ", "తగ్గడం", "మందులు", "చిట్కాలు", "precaution", "remedy", "cure"]),
        ("diseases", ["వ్యాధి", "కోవిడ్", "ఆస్తమా", "న్యుమోనియా", "లక్షణాలు", "disease", "covid", "asthma"]),
        ("models", ["ఖచ్చితత్వం", "మోడల్", "accuracy", "model", "algorithm"]),
        ("recording", ["రికార్డ్", "మైక్", "record", "audio", "mic"]),
    ],
    "hindi": [
        ("precautions", ["सावधानी", "उपाय", "इलाज", "घरेलू", "परहेज", "precaution", "remedy", "cure"]),
        ("diseases", ["बीमारी", "कोविड", "अस्थमा", "दमा", "निमोनिया", "लक्षण", "disease", "covid", "asthma"]),
        ("models", ["सटीकता", "मॉडल", "accuracy", "model", "algorithm"]),
        ("recording", ["रिकॉर्ड", "माइक", "record", "audio", "mic"]),
    ],
}
ENGLISH_TOPICS = [
    ("confidence", ["confidence score", "confidence mean", "what does the confidence"]),
    ("precautions", ["precaution", "remedy", "what to do", "treatment", "care plan", "how to cure", "steps"]),
    ("purpose", ["what is {product}", "what is this", "about this project", "purpose", "goal"]),
    ("usage", ["how do i use", "how to use", "how does it work", "how does {product} work", "workflow", "steps", "process", "guide"]),
    ("formats", ["file type", "format", "supported audio", "wav", "webm", "mp3", "ogg", "flac"]),
    ("recording", ["record", "cough clearly", "background noise", "microphone", "tips", "how to record"]),
    ("features", ["feature", "mfcc", "mel", "extract", "sound feature", "frequency", "rms"]),
    ("models", ["which model", "models", "algorithm", "machine learning", "random forest", "extra trees", "logistic", "knn", "svc", "accuracy"]),
    ("explain_result", ["explain my result", "explain my latest result", "explain my screening", "explain result", "my result"]),
    ("compare_sessions", ["compare my history", "compare my last two", "what changed", "delta", "compare recordings"]),
    ("air_quality", ["air quality", "explain my aqi", "pm2.5", "pm25", "environment", "smog", "aqi"]),
    ("better_recording", ["record better", "improve recording", "improve my recording", "better audio", "quality gate"]),
    ("report", ["report", "pdf", "email", "download", "eml", "share", "qr"]),
    ("history", ["patient id", "history", "assessment", "dashboard", "{key_prefix}"]),
    ("diagnosis", ["diagnosis", "doctor", "medical advice", "treatment", "medicine", "cure"]),
    ("symptoms", ["symptom", "fever", "fatigue", "sore throat", "shortness of breath", "dyspnea"]),
    ("privacy", ["privacy", "secure", "stored", "personal data", "secret", "api key", "{assistant} key"]),
    ("technology", ["technology", "built with", "programming", "python", "gradio", "github", "render", "deploy"]),
    ("author", ["who made", "developer", "author", "created", "creator", "{developer}"]),
    ("dataset", ["dataset", "data", "{dataset}", "samples", "training data"]),
    ("portal", ["doctor", "patient", "portal", "website", "two websites", "switch"]),
    ("scenarios", ["how to get healthy", "how to get disease", "which gives disease", "which gives healthy", "negative", "positive", "scenario", "test scenario", "scenarios"]),
    ("asthma", ["asthma", "wheez", "bronchospasm"]),
    ("covid", ["covid", "corona", "sars-cov-2"]),
    ("pneumonia", ["pneumonia", "phlegm", "productive cough"]),
    ("cough_type", ["dry cough", "wet cough", "difference between"]),
    ("oxygen", ["spo2", "pulse oximeter", "oxygen level"]),
]
FALLBACK_TOPICS = [
    ("results", ["healthy", "disease", "result", "prediction"]),
    ("audio", ["audio", "recording", "upload", "microphone"]),
    ("algorithms", ["model", "algorithm", "machine learning"]),
]

Topics = Sequence[tuple[str, Sequence[str]]]


def english_topics(**names: str) -> list[tuple[str, list[str]]]:
    """The ordered topics with deployment names filled in; terms without a name are left out."""
    filled = []
    for topic, terms in [*ENGLISH_TOPICS, *FALLBACK_TOPICS]:
        kept = []
        for term in terms:
            wanted = term[term.index("{") + 1 : term.index("}")] if "{" in term else None
            if wanted is None:
                kept.append(term)
            elif wanted in names:
                kept.append(term.format(**names).lower())
        filled.append((topic, kept))
    return filled


def _any_term(lowered: Column, terms: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [lowered.contains(F.lit(t)) for t in terms])


def first_topic(lowered: Column, topics: Topics, default: str) -> Column:
    """First topic in order with a term in the text."""
    result = None
    for name, terms in topics:
        test = _any_term(lowered, terms)
        result = F.when(test, name) if result is None else result.when(test, name)
    return result.otherwise(default)


def with_intent(
    messages: DataFrame,
    text: str,
    language: Column | None = None,
    topics: Topics | None = None,
    emergencies: Sequence[str] = tuple(EMERGENCY_PHRASES),
    local_topics: dict[str, Topics] | None = None,
    scripts=tuple(SCRIPTS),
    default: str = "general",
) -> DataFrame:
    """Add ``intent``: emergency first, then the topics of the message's script, then the default.

    The lower-cased text and its script are columns of their own, so that they
    are computed once and not in every branch.
    """
    local_topics = LOCAL_TOPICS if local_topics is None else local_topics
    viewed = messages.withColumn("__lower", F.lower(F.coalesce(F.col(text), F.lit(""))))
    viewed = viewed.withColumn("__script", script_of(F.col("__lower"), language, scripts))
    lowered, script = F.col("__lower"), F.col("__script")
    routed = F.when(_any_term(lowered, emergencies), "emergency")
    for name, own in local_topics.items():
        routed = routed.when(script == name, F.concat(F.lit(f"{name}:"), first_topic(lowered, own, default)))
    routed = routed.otherwise(first_topic(lowered, english_topics() if topics is None else topics, default))
    return viewed.withColumn("intent", routed).drop("__lower", "__script")


def context(messages: DataFrame, conversation: str, turn: str, role: str, text: str, n: int = CONTEXT_MESSAGES) -> DataFrame:
    """The last ``n`` non-empty messages per conversation with model/user roles.

    The row-number limit is applied in each task before the shuffle.
    """
    said = messages.withColumn(text, strip(F.col(text))).where(F.col(text) != "")
    newest = Window.partitionBy(conversation).orderBy(F.desc(turn))
    kept = said.withColumn("recency", F.row_number().over(newest)).where(F.col("recency") <= n)
    return kept.select(conversation, turn, F.when(F.col(role) == "assistant", "model").otherwise("user").alias("role"), text, "recency")
