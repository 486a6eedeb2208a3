"""The registered queries of the training-data operators and, where SQL can express one, its twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tussis.llm import collocations, decontamination, hard_negatives, lm_scoring, mixing, quality, secret_scans, sharding, simhash, substring_dedup, token_counts, toxicity, warc
from tussis.plans.registry import query, table
from tussis.session import scratch_path

_MIX_SQL = f"""
WITH sized AS (
    SELECT doc_id, source, CAST(length(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest,
        row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) AS number FROM documents),
ranked AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source),
capped AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap FROM ranked),
levels AS (
    SELECT *, cap / weight AS ratio,
        CAST(sum(source_size) OVER () - (sum(cap) OVER w - cap) AS DOUBLE) / CAST(sum(weight) OVER () - (sum(weight) OVER w - weight) AS DOUBLE) AS level
    FROM capped WINDOW w AS (ORDER BY cap / weight, rank ROWS UNBOUNDED PRECEDING)),
level AS (SELECT min_by(level, (ratio, rank)) AS level FROM levels WHERE level <= ratio),
targets AS (
    SELECT source, source_size, least(weight * level.level, CAST(cap AS DOUBLE)) AS target,
        CASE WHEN source_size > 0 THEN least(weight * level.level, CAST(cap AS DOUBLE)) / source_size ELSE 0.0 END AS rate FROM levels, level)
SELECT doc_id, size, source_size, target,
    size * (CAST(floor(rate) AS BIGINT) + CASE WHEN CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || digest || ':' || number), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
"""

_LEAK_SQL = """
WITH doc AS (
    SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
item AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
cut AS (
    SELECT item_id, least(10, len(w)) AS n, unnest(generate_series(1, greatest(1, len(w) - 9))) AS first, w FROM item WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, first, first + n - 1), ' ') AS win FROM cut),
spots AS (
    SELECT r, n, unnest(generate_series(1, len(w) - n + 1)) AS first, w FROM doc, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n),
places AS (SELECT r, n, first, array_to_string(list_slice(w, first, first + n - 1), ' ') AS win FROM spots),
found AS (SELECT r, n, first, item_id FROM places JOIN wins USING (n, win)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(first, first + n - 1)) AS p FROM (SELECT DISTINCT r, n, first FROM found)) GROUP BY r),
named AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""


@query("op5_byte_shards")
def byte_shards(spark, folder):
    placed = sharding.assign_shards(table(spark, folder, "documents"), n_shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op6_source_mix", _MIX_SQL)
def source_mix(spark, folder):
    return mixing.mix_plan(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op7_decontamination", _LEAK_SQL)
def benchmark_leaks(spark, folder):
    found = decontamination.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


@query("op9_simhash")
def simhash_classes(spark, folder):
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def _tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_token_counts")
def count_tokens(spark, folder):
    counts = token_counts.token_counts(table(spark, folder, "documents"), _tokenizer_path())
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


@query("op2_secret_scans")
def secrets(spark, folder):
    versions = table(spark, folder, "documents").select(F.col("doc_id").alias("path"), "text")
    found = secret_scans.scan_versions(versions, scratch_path(spark, "secret-ledger"))
    base = F.filter("findings", lambda f: f["kind"].isin(*secret_scans.BASE_KINDS))

    def number(kind):
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        F.col("path").alias("doc_id"), *[number(k) for k in secret_scans.BASE_KINDS],
        F.sha2(secret_scans.span_text(base), 256).alias("base_sha256"), secret_scans.span_text(F.col("findings")).alias("spans"),
    )


_RULES = quality.Rules()
_BLANK = "\\x20\\x09-\\x0D"
_QUALITY_SQL = rf"""
WITH doc AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
words AS (
    SELECT *, regexp_extract_all(t, '[^{_BLANK}]+') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^{_BLANK}]')) AS ls FROM doc),
places AS (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5),
windows AS (SELECT r, i, array_to_string(list_slice(w, i, i + 4), ' ') AS k FROM places),
often AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM often) GROUP BY r),
lines AS (SELECT r, unnest(ls) AS l FROM words),
told AS (
    SELECT r, l, len(regexp_extract_all(l, '[^{_BLANK}]+')) AS n, length(regexp_replace(l, '[{_BLANK}]', '', 'g')) AS chars,
        length(l) - length(regexp_replace(l, '[#*$%&|<>]', '', 'g')) AS symbols, length(l) - length(regexp_replace(l, '{quality.SEPARATOR.pattern}', '', 'g')) AS seps FROM lines),
passed AS (
    SELECT r, sum(chars) AS chars FROM told
    WHERE symbols * {_RULES.words_per_symbol} <= n AND regexp_matches(l, '{quality.SENTENCE_MARK.pattern}')
        AND NOT (seps >= {_RULES.min_separators} AND n <= seps * {_RULES.words_per_separator}) AND NOT regexp_matches(l, '(?i){quality.BOILERPLATE.pattern}')
    GROUP BY r),
figures AS (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[{_BLANK}]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(passed.chars, 0) AS BIGINT) AS kept_chars
    FROM words LEFT JOIN repeated USING (r) LEFT JOIN passed USING (r))
SELECT *, n_words < {_RULES.min_words} OR 100 * n_repeat_words > {_RULES.max_repeat_percent} * n_words AS base_failed,
    NOT (n_words < {_RULES.min_words} OR 100 * n_repeat_words > {_RULES.max_repeat_percent} * n_words) AND 100 * kept_chars >= {_RULES.min_kept_percent} * word_chars AS kept
FROM figures
"""


@query("op3_quality_rules", _QUALITY_SQL)
def quality_rules(spark, folder):
    return quality.quality_report(table(spark, folder, "documents"))


@query("op8_substring_dedup")
def repeated_passages(spark, folder):
    return substring_dedup.repeats(table(spark, folder, "documents"))


_WARC_SQL = """
WITH page AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
known AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM page),
marked AS (SELECT *, payload_bytes >= 100 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id AS again FROM known)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_id END AS refers_to FROM marked
"""


@query("op10_warc", _WARC_SQL)
def warc_round_trip(spark, folder):
    manifest = warc.write_archives(table(spark, folder, "pages"), scratch_path(spark, "archives"))
    return warc.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_lm_scoring")
def language_model_scores(spark, folder):
    return lm_scoring.score_texts(table(spark, folder, "documents"), lm_scoring.every_seventh(F.col("doc_id")))


_PHRASE_SQL = """
WITH piece AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p
    FROM documents),
words AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM piece),
size AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
spots AS (SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase FROM starts, (VALUES (1), (2), (3), (4), (5)) AS t(m) WHERE i + m - 1 <= len(w)),
often AS (SELECT lang, m, phrase, count(*) AS f FROM spots GROUP BY lang, m, phrase HAVING count(*) >= 100),
cuts AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM often WHERE m > 1),
parts AS (SELECT lang, m, phrase, a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:m], ' ') AS rest FROM cuts),
told AS (
    SELECT parts.lang, parts.m, parts.phrase, a, k, x.f AS l, y.f AS r, n, CAST(1000::HUGEINT * a * n // (x.f::HUGEINT * y.f) AS BIGINT) AS score
    FROM parts JOIN often x ON x.lang = parts.lang AND x.phrase = first JOIN often y ON y.lang = parts.lang AND y.phrase = rest JOIN size ON size.lang = parts.lang),
lowest AS (SELECT * FROM told QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
free AS (
    SELECT * FROM lowest c WHERE NOT EXISTS (
        SELECT 1 FROM often o WHERE o.lang = c.lang AND o.m > c.m AND 100 * o.f >= 100 * c.a AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM free QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


@query("op11_collocations", _PHRASE_SQL)
def phrase_collocations(spark, folder):
    return collocations.collocations(table(spark, folder, "documents"))


_NEGATIVE_SQL = """
WITH ok AS (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256.0::DOUBLE * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
    SELECT a.r, a.vec_id AS anchor_id, b.r AS other, b.vec_id AS other_id, a.label = b.label AS alike, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM ok a JOIN ok b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
positives AS (SELECT * FROM pairs WHERE alike QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.r = p.r AND NOT n.alike AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.r, p.other ORDER BY n.score DESC, n.other_id) QUALIFY row_number() OVER w <= 3
"""


@query("op12_hard_negatives", _NEGATIVE_SQL)
def mined_negatives(spark, folder):
    return hard_negatives.hard_negatives(table(spark, folder, "embeddings"))


@query("op13_toxicity")
def toxicity_scores(spark, folder):
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, folder, "labels")))
