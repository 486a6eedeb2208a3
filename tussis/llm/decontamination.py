"""Benchmark passages inside training texts, by a positional inverted index.

The index stores postings (term, document, position) of the training tokens. A benchmark window is looked up from
its rarest terms: the postings of the rarest give places where the window could start, the offset-adjusted postings of
the second rarest are intersected with them, and the few places left are intersected with the
positions of all other terms, which gives exact phrase matches. Only terms that a window is looked up by
are stored; every join of postings is keyed by document and position, so no frequent term and
no long document lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tussis.llm.common import ascii_lower, fresh, if_small, same, whole_text, written

#: What parts words, once A to Z are lower-case: ASCII other than letters and digits.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in a text of either case, for counting.
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

DOC = ("doc_id", "text_key")


def word_list(text: Column) -> Column:
    """Words of a text in order; none where it is null."""
    return F.array_remove(F.split(ascii_lower(whole_text(text)), GAPS), "")


def windows_of(items: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """``(wid, terms, n)`` of all distinct windows and ``(wid, item_id)`` of the items that hold them.

    A window is ``width`` consecutive words; an item with fewer words, but not none, is one window.
    """
    cut = (
        items.select("item_id", word_list(F.col("text")).alias("w")).filter(F.size("w") > 0)
        .select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - width + 1))).alias("at"))
        .select("item_id", F.slice("w", F.col("at"), width).alias("terms")).distinct()
    )
    cut = written(cut, "item-windows")
    windows = written(cut.select("terms").distinct().select(F.monotonically_increasing_id().alias("wid"), "terms", F.size("terms").alias("n")), "windows")
    holders = written(cut.join(windows, "terms").select("wid", "item_id").distinct(), "window-items")
    return windows, holders


def tokens_of(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, pos, term`` of every word; rows of the same id and text share their key."""
    return docs.select("doc_id", F.xxhash64(whole_text(F.col("text"))).alias("text_key"), F.posexplode(word_list(F.col("text"))).alias("pos", "term"))


def term_counts(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """How often each term of the windows occurs in all documents."""
    vocabulary = written(windows.select(F.explode("terms").alias("term")).distinct(), "vocabulary")
    tokens = docs.select(F.explode(word_list(F.col("text"))).alias("term"))
    return written(tokens.join(if_small(vocabulary), "term").groupBy("term").agg(F.count(F.lit(1)).alias("freq")), "term-counts")


def lookups_of(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Per window that can occur: its rarest term and the next rarest, with their offsets.

    A window with a term that no document holds is left out.
    """
    ranked = (
        windows.select("wid", "n", F.posexplode("terms").alias("offset", "term")).join(counts, "term")
        .groupBy("wid", "n").agg(F.sort_array(F.collect_list(F.struct("freq", "offset", "term"))).alias("r"))  # at most width terms
        .filter(F.size("r") == F.col("n"))
    )
    second = F.when(F.col("n") > 1, F.col("r")[1])
    return written(
        ranked.select(
            "wid", "n", F.col("r")[0]["term"].alias("term1"), F.col("r")[0]["offset"].alias("offset1"),
            second["term"].alias("term2"), second["offset"].alias("offset2"),
        ),
        "lookups",
    )


def build_index(docs: DataFrame, lookups: DataFrame) -> DataFrame:
    """Postings ``term, doc_id, text_key, pos`` of the terms that windows are looked up by, as a written table."""
    terms = written(lookups.select(F.explode(F.array("term1", "term2")).alias("term")).filter("term is not null").distinct(), "lookup-terms")
    return written(tokens_of(docs).join(if_small(terms), "term").select("term", *DOC, "pos"), "postings")


def phrase_matches(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """``doc_id, text_key, wid, start, n`` of every exact occurrence of a window in a document."""
    lookups = lookups_of(windows, term_counts(docs, windows))
    postings = build_index(docs, lookups)

    starts = (
        postings.join(if_small(lookups), F.col("term") == F.col("term1"))
        .select(*DOC, "wid", "n", (F.col("pos") - F.col("offset1")).alias("start"), "term2", "offset2", "offset1")
        .filter("start >= 0")
    )
    two = starts.filter("n > 1").withColumn("pos2", F.col("start") + F.col("offset2"))
    lists = postings.select(*DOC, F.col("term").alias("term2"), F.col("pos").alias("pos2"))
    near = two.join(lists, same(two, lists, *DOC) & (two["term2"] == lists["term2"]) & (two["pos2"] == lists["pos2"]), "left_semi")
    near = written(near.unionByName(starts.filter("n = 1").withColumn("pos2", F.col("start"))).select(*DOC, "wid", "n", "start", "offset1", "offset2").distinct(), "near-matches")

    # The other terms, at the documents and positions still in question.
    asked = near.join(if_small(windows.select("wid", "terms")), "wid").select(*DOC, "wid", "n", "start", "offset1", "offset2", F.posexplode("terms").alias("offset", "term"))
    asked = asked.filter("not (offset <=> offset1) and not (offset <=> offset2)").withColumn("pos", F.col("start") + F.col("offset"))
    open_docs = written(near.select(*DOC).distinct(), "open-documents")
    keyed = docs.select("doc_id", "text", F.xxhash64(whole_text(F.col("text"))).alias("text_key"))
    tokens = tokens_of(keyed.join(if_small(open_docs), same(keyed, open_docs, *DOC), "left_semi"))
    found = asked.join(tokens, same(asked, tokens, *DOC) & (asked["pos"] == tokens["pos"]) & (asked["term"] == tokens["term"]), "left_semi")
    rest = found.groupBy(*DOC, "wid", "n", "start").agg(F.count(F.lit(1)).alias("held")).filter("held = n - 2")
    return written(rest.drop("held").unionByName(near.filter("n <= 2").select(*DOC, "wid", "n", "start")), "phrase-matches")


def proximity_matches(docs: DataFrame, windows: DataFrame, slack: int = 5) -> DataFrame:
    """``doc_id, text_key, wid, pos1, pos2``: the two rarest terms of a window within ``slack`` words of the
    distance they have in the window. Places are compared by stretches of positions, each with its neighbours, never all with all.
    """
    lookups = lookups_of(windows, term_counts(docs, windows))
    postings = build_index(docs, lookups)
    reach = 2 * slack + 1
    first = postings.join(if_small(lookups), F.col("term") == F.col("term1")).filter("term2 is not null").select(
        *DOC, "wid", "term2", F.col("pos").alias("pos1"), (F.col("pos") - F.col("offset1") + F.col("offset2")).alias("due"))
    first = first.withColumn("cell", F.explode(F.expr(f"sequence(cast(floor((due - {slack}) / {reach}) as bigint), cast(floor((due + {slack}) / {reach}) as bigint))")))
    second = postings.select(*DOC, F.col("term").alias("term2"), F.col("pos").alias("pos2"), F.expr(f"cast(floor(pos / {reach}) as bigint)").alias("cell"))
    met = first.join(second, same(first, second, *DOC) & (first["term2"] == second["term2"]) & (first["cell"] == second["cell"]))
    return met.filter(F.abs(F.col("pos2") - F.col("due")) <= slack).select(first["doc_id"], first["text_key"], "wid", "pos1", "pos2")


def hits(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """Per document with a match: ``doc_id, text_key, n_hit, items`` (words inside matches; sorted ids as strings)."""
    windows, holders = windows_of(items.select("item_id", "text"), width)
    matches = phrase_matches(docs, windows)
    stretches = matches.groupBy(*DOC, "start").agg(F.max(F.col("start") + F.col("n")).alias("end"))
    before = Window.partitionBy(*DOC).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(before), F.lit(0))
    covered = stretches.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), reached))).groupBy(*DOC).agg(F.sum("new").alias("n_hit"))
    named = (
        matches.select(*DOC, "wid").distinct().join(if_small(holders), "wid").filter("item_id is not null")
        .groupBy(*DOC).agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    renamed = named.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "items")
    both = covered.join(renamed, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left")
    return both.select(*DOC, "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def report(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, items, contaminated``.

    Null texts have no words. Repeated rows each get their row. Documents without words and an empty benchmark give
    no hits; an item without words is never found; null item ids hit, but are not listed. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    found = written(hits(docs, items, width), "hits")
    counted = docs.select("doc_id", F.xxhash64(whole_text(F.col("text"))).alias("text_key"), F.regexp_count(whole_text(F.col("text")), F.lit(ANY_CASE_WORD)).cast("bigint").alias("n_words"))
    joined = counted.join(if_small(found), same(counted, found, *DOC), "left")
    return joined.select(
        counted["doc_id"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """The documents that hold no window of the benchmark, with all their columns."""
    found = written(hits(docs.select("doc_id", "text"), items, width).select(*DOC), "hits")
    doc, key, own = fresh(docs, "__hit_doc", "__hit_key", "__text_key")
    found = found.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key))
    keyed = docs.withColumn(own, F.xxhash64(whole_text(docs["text"])))
    return keyed.join(if_small(found), F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(key)), "left_anti").drop(own)
