"""Phrase collocation mining by best-first growth of phrases under admissible score bounds.

A phrase of 2 to ``max_words`` words is a candidate if it occurs ``min_count`` times in its language. Cut after its first
k words it scores ``floor(1000 * a * n / (l * r))`` (a, l, r: occurrences of the phrase and of both parts, n: words of the
language); its lowest cut counts. As ``a <= r``, no phrase that starts with a word of count c scores more than
``1000 * n / c``: the count of a prefix bounds everything that grows out of it. So growth starts from the rarest first
words and stops, language by language, as soon as ``top`` surviving phrases score more than any phrase not grown yet can.

A **wave** grows the next first words in the order of their bound:

1. one scan of the texts counts their pairs, and pairs below ``min_count`` are dropped with all that would start so;
2. a second scan takes the windows (word before, up to ``max_words`` words) at the remaining pairs and counts equal ones;
   from these come all longer prefixes and the neighbours that decide whether a longer candidate has the same count;
3. phrases whose bound (first and last word) reaches the current ``top``-th score have their suffixes counted by a third
   scan, best bounds first, which settles their exact score.

What a scan looks up is broadcast and holds at most ``lookup`` phrases; a larger set is scanned for in parts. Partial
counts leave a task as soon as it holds ``FLUSH`` of them. Growth, joins and ranks are DataFrame operations.

Texts: null counts as empty, a null language as ``und``. Repeated rows count as often as they occur, other columns are
ignored, an empty table gives no row. A text of any length is read stretch by stretch.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tussis.llm.common import UPPER, whole_text, written

#: Marks the end of a piece among the tokens; no word can hold it.
END = b"."
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(UPPER.encode() + b"\t" + _BREAKS, UPPER.lower().encode() + b" " + END * len(_BREAKS))
#: Bytes of a text taken at a time; a stretch ends with a piece.
STRETCH = 1 << 20
#: Partial counts a task holds before it hands them on.
FLUSH = 300_000
#: Shares of a language's occurrences of frequent words whose first words the waves grow, rarest words first.
SHARES = (0.05, 0.3, 1.0)
COUNTS = "lang string, phrase string, n long"


def stretches(text: str) -> Iterator[list[bytes]]:
    """The words of a text in order, with ``END`` between pieces, in lists that end where a piece ends."""
    folded, start = text.encode().translate(_FOLD), 0
    while start < len(folded):
        end = folded.find(END, start + STRETCH)
        end = len(folded) if end < 0 else end
        yield folded[start:end].replace(END, b" . ").split()
        start = end + 1


def _counted(docs: DataFrame, count: Callable[[str, list[bytes], Counter], None]) -> DataFrame:
    """Sums over all texts of what ``count(lang, tokens, counts)`` adds to the counts of its language."""

    def scan(batches):
        found: dict[str, Counter] = {}

        def rows():
            flat = [(lang, key, n) for lang, counts in found.items() for key, n in counts.items()]
            columns = list(zip(*flat)) or [(), (), ()]
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary()).cast(pa.string()), pa.array(columns[2], pa.int64())],
                names=["lang", "phrase", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = found.setdefault(lang, Counter())
                for tokens in stretches(text.as_py()):
                    count(lang, tokens, counts)
                if len(counts) > FLUSH or len(found) > 64:
                    yield rows()
                    found = {}
        yield rows()

    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), whole_text(F.col("text")).alias("text"))
    partial = texts.filter(F.col("text") != "").mapInArrow(scan, COUNTS)
    return partial.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _words(lang: str, tokens: list[bytes], counts: Counter) -> None:
    """Occurrences of each word; those of all words together stand under null."""
    words = [t for t in tokens if t != END]
    counts.update(words)
    counts[None] += len(words)


def _lookups(spark, phrases: DataFrame, lookup: int) -> Iterator:
    """The (lang, phrase) rows of a written table as broadcast sets of at most some ``lookup`` phrases each."""
    parts = math.ceil(phrases.count() / lookup)
    for part in range(parts):
        sets: dict[str, set[bytes]] = {}
        chosen = phrases.filter(F.pmod(F.xxhash64("phrase", F.lit(7)), F.lit(parts)) == part)
        for row in chosen.select("lang", "phrase").collect():
            sets.setdefault(row.lang, set()).add(row.phrase.encode())
        yield spark.sparkContext.broadcast(sets)


def _pairs(docs: DataFrame, firsts) -> DataFrame:
    """Counts of all pairs of words in a piece whose first word is looked up."""

    def count(lang, tokens, counts):
        grown = firsts.value.get(lang, ())
        counts.update([a + b" " + b for a, b in zip(tokens, tokens[1:]) if a in grown and b != END])

    return _counted(docs.filter(_of_langs(firsts)), count)


def _windows(docs: DataFrame, pairs, max_words: int) -> DataFrame:
    """Counts of (word before, words from a looked-up pair on), cut at the end of the piece."""

    firsts: dict[str, set[bytes]] = {}

    def count(lang, tokens, counts):
        grown = pairs.value.get(lang, ())
        if lang not in firsts:
            firsts[lang] = {p[: p.index(b" ")] for p in grown}
        starts, windows = firsts[lang], []
        for i, (a, b) in enumerate(zip(tokens, tokens[1:])):
            if a in starts and a + b" " + b in grown:
                window = tokens[i : i + max_words]
                if END in window:
                    window = window[: window.index(END)]
                windows.append(b" ".join([tokens[i - 1] if i else END, *window]))
        counts.update(windows)

    return _counted(docs.filter(_of_langs(pairs)), count)


def _occurrences(docs: DataFrame, wanted, longest: int) -> DataFrame:
    """Counts of the looked-up phrases of 2 to ``longest`` words."""
    heads: dict[str, set[bytes]] = {}

    def count(lang, tokens, counts):
        phrases, found = wanted.value.get(lang, ()), []
        if lang not in heads:
            heads[lang] = {b" ".join(p.split(b" ", 2)[:2]) for p in phrases}
        first_two = heads[lang]
        for i, (a, b) in enumerate(zip(tokens, tokens[1:])):
            phrase = a + b" " + b
            if phrase in first_two:
                if phrase in phrases:
                    found.append(phrase)
                for word in tokens[i + 2 : i + longest]:
                    phrase += b" " + word
                    if phrase in phrases:
                        found.append(phrase)
        counts.update(found)

    return _counted(docs.filter(_of_langs(wanted)), count)


def _of_langs(sets) -> Column:
    """Rows of the languages looked up; languages are few, and a long list falls back to all rows."""
    langs = list(sets.value)
    return F.coalesce("lang", F.lit("und")).isin(langs) if len(langs) <= 200 else F.lit(True)


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def _score(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 * a * n / (left * right)) in whole numbers of 38 digits."""
    return F.expr(f"(1000BD * cast({a} AS decimal(16,0)) * cast({n} AS decimal(16,0))) div (cast({left} AS decimal(16,0)) * cast({right} AS decimal(16,0)))")


def _top(scored: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language with their rank: first within 64 shares of a language, then among their winners."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))
    near = scored.withColumn("share", share)
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= top)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top).drop("share")


def _bars(scored: DataFrame, top: int) -> DataFrame:
    """Per language the score to reach: its ``top``-th so far, zero while there are fewer."""
    return _top(scored, top).groupBy("lang").agg(F.when(F.count("*") >= top, F.min("score")).otherwise(F.lit(0)).cast("long").alias("bar"))


def _prefixes(windows: DataFrame, min_count: int, max_words: int) -> DataFrame:
    """All frequent prefixes of the windows with their count and whether a neighbour always comes with them."""
    words = F.split("phrase", " ")
    spans = windows.select("lang", "n", F.get(words, F.lit(0)).alias("before"), F.slice(words, 2, max_words).alias("words"))
    cut = spans.select("*", F.explode(F.sequence(F.lit(2), F.size("words"))).alias("m"))
    cut = cut.select("lang", "n", "before", "m", F.array_join(F.slice("words", F.lit(1), F.col("m")), " ").alias("phrase"), F.coalesce(F.get("words", F.col("m")), F.lit(".")).alias("after"))
    found = cut.groupBy("lang", "phrase", "m").agg(
        F.sum("n").alias("a"), F.min("before").alias("b0"), F.max("before").alias("b1"), F.min("after").alias("a0"), F.max("after").alias("a1")
    ).filter(F.col("a") >= min_count)

    def always(low, high):
        return (F.col(low) == F.col(high)) & (F.col(low) != ".")

    inside = (F.col("m") < max_words) & (always("b0", "b1") | always("a0", "a1"))
    return found.select("lang", "phrase", "m", "a", inside.alias("inside"))


def _lowest_cut(phrases: DataFrame, known: DataFrame, sizes: DataFrame) -> DataFrame:
    """The lowest-scoring cut of each phrase; ``known`` has the count of every part."""
    words = F.split("phrase", " ")
    cuts = phrases.select("lang", "phrase", "a", words.alias("words"), F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("right"))
    left = known.select(F.col("lang").alias("l_lang"), F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = known.select(F.col("lang").alias("r_lang"), F.col("phrase").alias("right"), F.col("n").alias("r"))
    cuts = cuts.join(left, (cuts["lang"] == left["l_lang"]) & (cuts["left"] == left["left"])).drop("l_lang").drop(left["left"])
    cuts = cuts.join(right, (cuts["lang"] == right["r_lang"]) & (cuts["right"] == right["right"])).drop("r_lang").drop(right["right"])
    scored = cuts.join(sizes, "lang").withColumn("score", _score("a", "n", "l", "r"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("cut"))
    return lowest.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")


def _cut_points(words: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """Per language the count up to which each wave takes first words. A language has at most sqrt(2 n) different counts."""
    levels = words.groupBy("lang", "n").agg(F.sum("n").alias("occurrences"))
    order = Window.partitionBy("lang").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    levels = levels.withColumn("below", F.sum("occurrences").over(order)).withColumn("all", F.sum("occurrences").over(Window.partitionBy("lang")))
    return levels.groupBy("lang").agg(*[
        F.min(F.when(F.col("below") >= F.lit(share) * F.col("all"), F.col("n"))).alias(f"cut{i}") if share < 1 else F.max("n").alias(f"cut{i}")
        for i, share in enumerate(shares)])


def collocations(
    docs: DataFrame, min_count: int = 100, max_words: int = 5, top: int = 2000, lookup: int = 200_000, shares: tuple[float, ...] = SHARES
) -> DataFrame:
    """The first ``top`` phrases of each language by score: ``lang, rank, phrase, a, l, r, n, score``.

    Ties go by ``a`` descending, then by the phrase in byte order. A candidate inside a longer one of equal count is left
    out. ``shares`` and ``lookup`` change how often the texts are read, never the result.
    """
    spark = docs.sparkSession
    counted = written(_counted(docs, _words).filter(F.col("phrase").isNull() | (F.col("n") >= min_count)), "phrase-words")
    sizes = counted.filter(F.col("phrase").isNull()).select("lang", "n")
    words = counted.filter(F.col("phrase").isNotNull())
    cuts = written(_cut_points(words, shares), "phrase-waves")
    scored: list[DataFrame] = []
    waiting = cuts.select("lang")
    for wave in range(len(shares)):
        above = F.col(f"cut{wave - 1}") if wave else F.lit(0)
        firsts = words.join(cuts, "lang").join(waiting, "lang", "left_semi").filter((F.col("n") > above) & (F.col("n") <= F.col(f"cut{wave}")))
        firsts = written(firsts.select("lang", "phrase"), "phrase-firsts")
        found = [_pairs(docs, chosen) for chosen in _lookups(spark, firsts, lookup)]
        if not found:
            continue
        pairs = written(_all(found).filter(F.col("n") >= min_count), "phrase-pairs")
        found = [_windows(docs, chosen, max_words) for chosen in _lookups(spark, pairs, lookup)]
        if found:
            grown = written(_prefixes(_all(found), min_count, max_words), "phrase-prefixes")
            scored += _settle(docs, grown, words, sizes, scored, top, lookup, max_words)
        waiting = written(_unsettled(cuts, sizes, scored, wave, top), "phrase-waiting")
    if not scored:
        schema = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
        return spark.createDataFrame([], schema)
    ranked = _top(_all(scored), top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def _settle(docs, grown: DataFrame, words: DataFrame, sizes: DataFrame, scored: list[DataFrame], top: int, lookup: int, max_words: int) -> list[DataFrame]:
    """Exact scores of a wave's surviving phrases, best bounds first, until no open one can reach the bar."""
    spark = docs.sparkSession
    free = grown.filter(~F.col("inside")).select("lang", "phrase", "m", "a")
    out = [written(_lowest_cut(free.filter("m = 2"), words, sizes), "phrase-scores")]
    ends = F.split("phrase", " ")
    first = words.select(F.col("lang").alias("f_lang"), F.col("phrase").alias("first"), F.col("n").alias("n_first"))
    last = words.select(F.col("lang").alias("t_lang"), F.col("phrase").alias("last"), F.col("n").alias("n_last"))
    long = free.filter("m > 2").withColumns({"w0": F.get(ends, F.lit(0)), "w9": F.element_at(ends, -1)})
    long = long.join(first, (F.col("lang") == F.col("f_lang")) & (F.col("w0") == F.col("first"))).join(last, (F.col("lang") == F.col("t_lang")) & (F.col("w9") == F.col("last")))
    long = long.join(sizes, "lang").withColumn("bound", F.expr("(1000BD * cast(n AS decimal(16,0))) div cast(greatest(n_first, n_last) AS decimal(16,0))"))
    waiting = written(long.select("lang", "phrase", "a", "bound"), "phrase-open")
    known = words.unionByName(grown.select("lang", "phrase", F.col("a").alias("n")))
    while True:
        bars = _bars(_all([*scored, *out]), top)
        waiting = waiting.join(bars, "lang", "left").filter(F.col("bound") >= F.coalesce("bar", F.lit(0))).drop("bar")
        batch = written(waiting.orderBy(F.desc("bound"), "lang", "phrase").limit(lookup), "phrase-batch")
        if batch.isEmpty():
            return out
        parts = F.split("phrase", " ")
        ends = batch.select("lang", F.explode(F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), " "))).alias("phrase"))
        ends = written(ends.distinct(), "phrase-suffixes")
        suffixes = _all([_occurrences(docs, chosen, max_words - 1) for chosen in _lookups(spark, ends, lookup)])
        new = known.join(ends, ["lang", "phrase"], "left_anti").unionByName(suffixes)
        out.append(written(_lowest_cut(batch.select("lang", "phrase", "a"), new, sizes), "phrase-scores"))
        waiting = written(waiting.join(batch, ["lang", "phrase"], "left_anti"), "phrase-open")


def _unsettled(cuts: DataFrame, sizes: DataFrame, scored: list[DataFrame], wave: int, top: int) -> DataFrame:
    """Languages where a phrase not grown yet may still be among the first ``top``."""
    after = cuts.join(sizes, "lang").select("lang", F.expr(f"(1000BD * cast(n AS decimal(16,0))) div cast(cut{wave} + 1 AS decimal(16,0))").alias("ahead"))
    if not scored:
        return after.select("lang")
    above = _all(scored).select("lang", "score").join(after, "lang").filter(F.col("score") > F.col("ahead")).groupBy("lang").count()
    return after.select("lang").join(above.filter(F.col("count") >= top), "lang", "left_anti")
