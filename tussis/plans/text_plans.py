"""Report text, chat routing and history analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tussis.functions import clinical_terms as T, rules, text as X
from tussis.functions.clean import id_matches
from tussis.operators import chat, history as H, search
from tussis.plans.registry import query, spread_table, sql_strip, sql_text, table
from tussis.plans.stand_ins import SCREENINGS_SQL, note_of
from tussis.session import scratch_path
from tussis.sources import sinks

_SPACE = sql_text(r"[\s\p{Z}\x1c-\x1f\x85]+")


@query("html_to_text", f"""WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), {_SPACE}, ' ', 'g')) AS text FROM pages)
    SELECT page_id, text, CAST(length(text) AS INTEGER) AS n_chars FROM t""")
def html_to_text(spark, folder):
    p = spread_table(spark, folder, "pages").select("page_id", X.plain_text(F.col("html")).alias("text"))
    return p.withColumn("n_chars", F.length("text"))


@query("html_escape", """SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM documents""")
def html_escape(spark, folder):
    return spread_table(spark, folder, "documents").select("doc_id", X.html_escape(F.col("text")).alias("escaped"))


@query("percent_encode", "SELECT conv_id, turn, replace(url_encode(role || '/~ *' || text), '%2F', '/') AS encoded FROM conversations")
def percent_encode(spark, folder):
    raw = F.concat(F.col("role"), F.lit("/~ *"), F.col("text"))
    return spread_table(spark, folder, "conversations").select("conv_id", "turn", X.percent_encode(raw).alias("encoded"))


@query("digits_only", "SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits FROM customer")
def digits_only(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", X.digits_only(F.col("c_name")).alias("digits"))


@query("display_name", r"""WITH n AS (SELECT p_partkey, replace(regexp_replace(lower(replace(p_name, ' ', '_') || '_2nd_o''b_' || p_type || '.joblib'), '\.joblib$', ''), '_', ' ') AS raw FROM part)
    SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(raw, '(\p{L}+|\P{L}+)', 1), lambda r: upper(r[1]) || lower(r[2:])), '') AS name FROM n""")
def display_name(spark, folder):
    file = F.lower(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_2nd_o'b_"), F.col("p_type"), F.lit(".joblib")))
    return table(spark, folder, "part").select("p_partkey", X.display_name(file).alias("name"))


_LATIN_SCRIPTS = [("french", "[éèêçà]"), ("german", "[äöüß]"), ("spanish", "[ñáíóú]")]


@query("script_detect", """SELECT doc_id, CASE WHEN regexp_matches(text, '[éèêçà]') OR contains(lang, 'french') THEN 'french' WHEN regexp_matches(text, '[äöüß]') THEN 'german'
    WHEN regexp_matches(text, '[ñáíóú]') THEN 'spanish' ELSE 'english' END AS script,
    CASE WHEN lang = 'es' THEN 'telugu' ELSE 'english' END AS hinted FROM documents""")
def script_detect(spark, folder):
    d, t = spread_table(spark, folder, "documents"), F.col("text")
    hint = F.when(F.col("lang") == "es", "Telugu (UI)")
    return d.select("doc_id", X.script_of(t, F.col("lang"), _LATIN_SCRIPTS).alias("script"), X.script_of(t, hint).alias("hinted"))


_TOPICS = [("wish", ["would", "und"]), ("place", ["there", "dans"]), ("people", ["they", "leurs"]), ("thing", ["this", "that"])]


def _topic_sql(text: str, topics, default: str) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'contains({text}, {sql_text(t)})' for t in terms)} THEN {sql_text(n)}" for n, terms in topics)
    return f"CASE {cases} ELSE {sql_text(default)} END"


@query("intent_route", f"""WITH m AS (SELECT conv_id, turn, lower(text) AS t FROM conversations)
    SELECT conv_id, turn, CASE WHEN contains(t, 'the the') OR contains(t, 'de de') THEN 'emergency'
      WHEN regexp_matches(t, '[ñáíóú]') THEN 'spanish:' || {_topic_sql('t', [('question', ['que'])], 'general')}
      ELSE {_topic_sql('t', _TOPICS, 'general')} END AS intent FROM m""")
def intent_route(spark, folder):
    messages = spread_table(spark, folder, "conversations").select("conv_id", "turn", "text")
    routed = chat.with_intent(messages, "text", topics=_TOPICS, emergencies=["the the", "de de"],
                              local_topics={"spanish": [("question", ["que"])]}, scripts=[("spanish", "[ñáíóú]")])
    return routed.drop("text")


@query("intent_route_default", f"""WITH m AS (SELECT doc_id, lower(text) AS t FROM documents)
    SELECT doc_id, CASE WHEN {' OR '.join(f'contains(t, {sql_text(p)})' for p in chat.EMERGENCY_PHRASES)} THEN 'emergency'
      ELSE {_topic_sql('t', chat.english_topics(), 'general')} END AS intent FROM m""")
def intent_route_default(spark, folder):
    return chat.with_intent(spread_table(spark, folder, "documents").select("doc_id", "text"), "text").drop("text")


@query("chat_context", f"""WITH r AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'model' ELSE 'user' END AS role, {sql_strip("text")} AS text,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS recency FROM conversations WHERE turn % 3 <> 1 AND {sql_strip("text")} <> '')
    SELECT conv_id, turn, role, text, CAST(recency AS INTEGER) AS recency FROM r WHERE recency <= 4""")
def chat_context(spark, folder):
    blank = F.when(F.col("turn") % 3 == 1, "\n\t\u00a0").otherwise(F.concat(F.lit("\t"), F.col("text"), F.lit("\u00a0")))
    said = spread_table(spark, folder, "conversations").withColumn("text", blank)
    return chat.context(said, "conv_id", "turn", "role", "text", 4)


# Events stand in for assessments.
def assessments(events):
    v = F.col("value")
    return events.select(
        F.col("user_id").cast("string").alias("patient_id"), "ts", F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "click", "Healthy").when(F.col("event_type") == "view", "NORMAL").otherwise("Disease").alias("label"),
        F.when(v >= 100, "High").when(v >= 50, "medium").otherwise("low").alias("risk"),
        F.when(F.col("event_id") % 11 != 0, F.least(v / 100.0, F.lit(1.0))).alias("confidence"),
        (F.col("user_id") % 90).cast("double").alias("age"),
        F.when(F.col("user_id") % 2 == 0, "female").otherwise("male").alias("gender"),
        F.lit("extra_trees").alias("model"),
    )


def history(spark, folder):
    return assessments(table(spark, folder, "events"))


HISTORY_SQL = """WITH history AS (SELECT CAST(user_id AS VARCHAR) AS patient_id, ts, event_id AS id,
    CASE event_type WHEN 'click' THEN 'Healthy' WHEN 'view' THEN 'NORMAL' ELSE 'Disease' END AS label,
    CASE WHEN value >= 100 THEN 'High' WHEN value >= 50 THEN 'medium' ELSE 'low' END AS risk,
    CASE WHEN event_id % 11 <> 0 THEN least(value / 100.0::DOUBLE, 1.0::DOUBLE) END AS confidence,
    CAST(user_id % 90 AS DOUBLE) AS age, CASE WHEN user_id % 2 = 0 THEN 'female' ELSE 'male' END AS gender, 'extra_trees' AS model FROM events)"""

KPI_SQL = """count(*) AS n_assessments, round(avg(coalesce(confidence, 0.8::DOUBLE)), 9) AS avg_confidence,
    count(*) FILTER (lower(risk) = 'high') AS n_high_risk, count(*) FILTER (lower(label) NOT IN ('healthy', 'normal')) AS n_flagged"""


def rounded_kpis(df):
    return df.withColumn("avg_confidence", F.round("avg_confidence", 9))


@query("history_kpis", f"{HISTORY_SQL} SELECT {KPI_SQL} FROM history")
def history_kpis(spark, folder):
    return rounded_kpis(H.kpis(history(spark, folder)))


@query("history_kpis_recent", f"{HISTORY_SQL} SELECT patient_id, {KPI_SQL} FROM history WHERE ts > (SELECT max(ts) FROM history) - INTERVAL 7 DAY GROUP BY patient_id")
def history_kpis_recent(spark, folder):
    return rounded_kpis(H.kpis(H.within_days(history(spark, folder), 7), ["patient_id"]))


@query("history_timeline", f"""{HISTORY_SQL} SELECT patient_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, id, label, risk, coalesce(confidence, 0.0::DOUBLE) AS confidence
    FROM history ORDER BY ts DESC, id DESC LIMIT 8""")
def history_timeline(spark, folder):
    return H.timeline(history(spark, folder)).select("patient_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "id", "label", "risk", "confidence")


@query("history_search", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'omer#00000012')")
def history_search(spark, folder):
    return table(spark, folder, "customer").where(id_matches(F.col("c_name"), " OMER#00000012 ")).select("c_custkey", "c_name")


@query("history_search_indexed", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'omer#00000012')")
def history_search_indexed(spark, folder):
    index = scratch_path(spark, "search-index")
    search.write_index(table(spark, folder, "customer").select("c_custkey", "c_name"), "c_name", index)
    return search.search(spark, index, "c_name", " OMER#00000012 ")


@query("history_delta", f"""{HISTORY_SQL}, r AS (SELECT patient_id, coalesce(confidence, 0.0::DOUBLE) AS c, row_number() OVER (PARTITION BY patient_id ORDER BY ts DESC, id DESC) AS n FROM history),
    p AS (SELECT a.patient_id, a.c AS latest, b.c AS previous FROM r a JOIN r b ON a.patient_id = b.patient_id AND a.n = 1 AND b.n = 2)
    SELECT patient_id, latest, previous, round((latest - previous) * 100, 6) AS delta_points, CASE WHEN latest - previous >= 0 THEN '+' ELSE '-' END AS direction FROM p""")
def history_delta(spark, folder):
    return H.session_delta(history(spark, folder)).withColumn("delta_points", F.round("delta_points", 6))


@query("history_delta_overall", f"""{HISTORY_SQL}, r AS (SELECT coalesce(confidence, 0.0::DOUBLE) AS c, row_number() OVER (ORDER BY ts DESC, id DESC) AS n FROM history)
    SELECT a.c AS latest, b.c AS previous, round((a.c - b.c) * 100, 6) AS delta_points, CASE WHEN a.c - b.c >= 0 THEN '+' ELSE '-' END AS direction FROM r a, r b WHERE a.n = 1 AND b.n = 2""")
def history_delta_overall(spark, folder):
    return H.session_delta(history(spark, folder), by=None).withColumn("delta_points", F.round("delta_points", 6))


@query("latest_result", f"{HISTORY_SQL} SELECT patient_id, id, label, risk, coalesce(confidence, 0.85::DOUBLE) AS confidence FROM history ORDER BY ts DESC, id DESC LIMIT 1")
def latest_result(spark, folder):
    return H.latest(history(spark, folder)).select("patient_id", "id", "label", "risk", "confidence")


@query("triage_counts", f"{HISTORY_SQL} SELECT CASE lower(risk) WHEN 'high' THEN 'P1' WHEN 'medium' THEN 'P2' ELSE 'P3' END AS priority, count(*) AS n FROM history GROUP BY 1")
def triage_counts(spark, folder):
    return H.triage_counts(history(spark, folder))


@query("history_retention", f"{HISTORY_SQL} SELECT patient_id, id, label, confidence FROM history ORDER BY ts DESC, id DESC LIMIT 200")
def history_retention(spark, folder):
    """Appended in two writes, read back, newest 200 kept."""
    path = scratch_path(spark, "history")
    h = history(spark, folder)
    sinks.append_history(h.where("id % 2 = 0"), path)
    sinks.append_history(h.where("id % 2 = 1"), path)
    return sinks.retained(sinks.read_history(spark, path)).select("patient_id", "id", "label", "confidence")


@query("history_purge", "SELECT count(*) AS n_before, CAST(0 AS BIGINT) AS n_after FROM events")
def history_purge(spark, folder):
    path = scratch_path(spark, "history")
    h = history(spark, folder)
    sinks.append_history(h, path)
    before = sinks.read_history(spark, path).count()
    sinks.purge_history(spark, path)
    return sinks.read_history(spark, path).agg(F.lit(before).cast("bigint").alias("n_before"), F.count("*").alias("n_after"))


@query("report_key", "SELECT event_id, 'SCR-' || strftime(ts, '%Y%m%d') || '-' || upper(substr(sha256(CAST(event_id AS VARCHAR)), 1, 6)) AS report_key FROM events")
def report_key(spark, folder):
    return table(spark, folder, "events").select("event_id", X.report_key(F.col("event_id"), F.col("ts")).alias("report_key"))


@query("report_date", "SELECT event_id, strftime(ts, '%d %B %Y, %I:%M %p') AS report_date FROM events")
def report_date(spark, folder):
    return table(spark, folder, "events").select("event_id", X.report_date(F.col("ts")).alias("report_date"))


_LINE_SQL = f"""{HISTORY_SQL} SELECT id, 'Screening report|' || patient_id || '|' || label || '|' || printf('%.4f', coalesce(confidence, 0.0)) || '|' || strftime(ts, '%Y-%m-%d') AS line FROM history"""


def _lines(spark, folder):
    shown = F.coalesce("confidence", F.lit(H.ROW_CONFIDENCE))
    return history(spark, folder).select("id", X.verification_line(F.col("patient_id"), F.col("label"), shown, F.col("ts")).alias("line"))


@query("verification_line", _LINE_SQL)
def verification_line(spark, folder):
    return _lines(spark, folder)


@query("sink_text_roundtrip", f"SELECT line FROM ({_LINE_SQL})")
def sink_text_roundtrip(spark, folder):
    path = scratch_path(spark, "report")
    sinks.write_text(_lines(spark, folder), path, "line")
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("report_text", f"""WITH src AS ({SCREENINGS_SQL}), r AS (SELECT s.*, e.ts, e.user_id, CASE WHEN probability >= 0.7 THEN 'high' ELSE 'low' END AS risk,
      (prediction = 1 OR probability >= 0.7) AS sick FROM src s JOIN events e USING (event_id))
    SELECT event_id, 'PATIENT ID: ' || user_id || ' | DATE: ' || strftime(ts, '%d %B %Y, %I:%M %p') || chr(10)
      || 'DEMOGRAPHICS: Age ' || CAST(age AS INTEGER) || ', ' || CASE WHEN user_id % 2 = 0 THEN 'Female' ELSE 'Male' END || chr(10)
      || 'RESPIRATORY CONDITION: ' || respiratory_condition || ' | FEVER/MYALGIA: ' || fever_muscle_pain || chr(10)
      || '[S] Reported symptoms: "' || coalesce(nullif(notes, ''), 'None specified') || '".' || chr(10)
      || '[O] Model extra_trees, confidence ' || printf('%.1f', floor(probability * 100 + 1e-9)) || '%. Phenotype: '
      || CASE WHEN sick THEN {sql_text(T.PHENOTYPE_DISEASE)} ELSE {sql_text(T.PHENOTYPE_HEALTHY)} END || '.' || chr(10)
      || '[A] ' || CASE WHEN sick THEN {sql_text(T.SUMMARY_DISEASE)} ELSE {sql_text(T.SUMMARY_HEALTHY)} END || '. Risk: ' || upper(risk)
      || ' (' || CASE WHEN sick THEN {sql_text(T.TIER_DISEASE)} ELSE {sql_text(T.TIER_HEALTHY)} END || ').' || chr(10)
      || '[P] ' || CASE WHEN risk = 'high' THEN 'In-person clinical evaluation advised.' ELSE 'Routine observation; re-screen if symptoms persist.' END AS report FROM r""")
def report_text(spark, folder):
    e = table(spark, folder, "events")
    p = F.least(F.col("value") / 100.0, F.lit(1.0))
    s = e.select(
        "event_id", "ts", F.col("user_id"), p.alias("probability"), note_of(F.col("event_id")).alias("notes"),
        F.when(F.col("value") >= 60, "Possible Disease").otherwise("Healthy").alias("label"),
        F.when(p >= 0.7, "high").otherwise("low").alias("risk"),
        (F.col("user_id") % 90).cast("int").alias("age"), F.when(F.col("user_id") % 2 == 0, "female").otherwise("male").alias("gender"),
        (F.col("event_id") % 5 == 0).alias("resp"), (F.col("event_id") % 7 == 0).alias("fever"),
    )
    keep = ["event_id", "ts", "user_id", "probability", "notes", "risk", "age", "gender", "resp", "fever"]
    c = rules.clinician_fields(s, label="label", risk="risk", notes="notes", keep=keep)
    col = F.col
    note = X.soap_note(col("user_id"), col("ts"), col("age"), col("gender"), col("notes"), col("resp"), col("fever"), col("summary"),
                       col("risk"), col("priority_tier"), col("phenotype"), F.lit("extra_trees"), F.floor(col("probability") * 100 + 1e-9) / 100)
    return c.select("event_id", note.alias("report"))
