"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton over folded texts.

**Folding** maps every character to one character: letters of other scripts and widths that look like a Latin letter,
accented letters, and digits or signs that stand for a letter all become the plain letter, and ``l`` becomes ``i``, since
``1``, ``l`` and ``i`` stand for each other. Positions stay those of the text.

**Learning** (``learn``) reads labelled rows only, at most ``max_rows`` a class, those with the least hash of their id;
equal texts count once.

1. Words and word stems (of 4 to 8 characters) found in enough toxic texts, and there oftener than in clean ones, are
   looked at again with their neighbours.
2. A phrase of such a term and a neighbour that clean texts use and toxic ones hardly do becomes an **exception phrase**;
   a match inside one counts for nothing.
3. Without these, the distinct surroundings of a term are counted in both classes, so that copies of one text count
   once. Terms that pass a likelihood-ratio test at the number of terms tested enter the lexicon with their log ratio as
   **weight**; of nested terms the longest with the same evidence stays.
4. A logistic curve over ``log(1 + weights / sqrt(words + 25))`` turns the sum of a text's weights, normalised by its
   length, into a probability. Its intercept is learned with the classes in their true proportions.

**Scoring** sends the lexicon (at most ``max_terms`` terms) to all tasks and reads whole texts once, in Arrow batches.

Defined cases: a null text counts as empty and gets the score of a text without matches; a null id counts as the empty
text for the held-out rule; an id with several labels is toxic if one of them says so, null labels are ignored. Repeated
rows give repeated results, other columns are ignored. Without toxic or without clean training rows, or where no term
passes, all texts get the share of toxic rows (add-one). An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from tussis.llm.common import whole_text, written

# Characters that are read as a Latin letter.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s",
    "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ё": "e", "ї": "i", "А": "a", "В": "b", "С": "c", "Е": "e", "Н": "h", "І": "i", "Ј": "j",
    "К": "k", "М": "m", "О": "o", "Р": "p", "Ѕ": "s", "Т": "t", "У": "y", "Х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "Α": "a", "Β": "b", "Ε": "e", "Ζ": "z", "Η": "h", "Ι": "i", "Κ": "k",
    "Μ": "m", "Ν": "n", "Ο": "o", "Ρ": "p", "Τ": "t", "Υ": "y", "Χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ɑ": "a", "ɡ": "g", "ѡ": "w",
}
STANDS_FOR = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e"}

MIN_STEM, MAX_STEM = 4, 8
#: A whole word is written with this behind it, to tell it from a stem.
WHOLE = " "


def _folding() -> dict[int, str]:
    table = {}
    for point in [*range(0x41, 0x250), *range(0x1E00, 0x1F00), *range(0x2070, 0x2190), *range(0xFF10, 0xFF5B), *range(0x1D400, 0x1D800)]:
        plain = unicodedata.normalize("NFKD", chr(point))[:1].lower()
        if plain.isascii() and plain.isalnum():
            table[point] = plain
    table |= {ord(c): plain for c, plain in LOOKALIKES.items()}
    table |= {ord(c): plain for c, plain in STANDS_FOR.items()}
    table = {point: STANDS_FOR.get(plain, plain) for point, plain in table.items()}
    return {point: "i" if plain == "l" else plain for point, plain in table.items()} | {ord("l"): "i", ord("L"): "i"}


FOLDING = _folding()
WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """The folded text, character for character."""
    return text.translate(FOLDING)


def words(text: str) -> list[str]:
    """Folded words of a text; numbers without any letter are left as they are."""
    folded = fold(text)
    return [folded[m.start() : m.end()] if any(map(str.isalpha, text[m.start() : m.end()])) else text[m.start() : m.end()] for m in WORD.finditer(folded)]


def terms(word: str) -> list[str]:
    """The word as a whole and its stems."""
    return [word + WHOLE, *(word[:n] for n in range(MIN_STEM, min(MAX_STEM, len(word) - 1) + 1))]


@dataclass(frozen=True)
class Lexicon:
    weights: dict[str, float]
    exceptions: frozenset[tuple[str, str, str]]  # (term, "<" or ">", neighbour)
    slope: float
    intercept: float


def held_out(doc_id: Column) -> Column:
    """Rows whose id, as text, has a CRC-32 divisible by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


class Matcher:
    """Finds lexicon terms at word starts, the heaviest per word, outside exception phrases."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.around = {term for term, _, _ in lexicon.exceptions}
        self.automaton = ahocorasick.Automaton()
        for term, weight in lexicon.weights.items():
            bare = term.removesuffix(WHOLE)
            self.automaton.add_word(bare, [*self.automaton.get(bare, []), (term, len(bare), weight)])
        if lexicon.weights:
            self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, term, weight) of the counted matches."""
        if not self.lexicon.weights:
            return []
        folded = fold(text)
        best: dict[int, tuple[int, str, float]] = {}
        for last, entries in self.automaton.iter(folded):
            for term, length, weight in entries:
                start = last - length + 1
                if start and _in_word(folded[start - 1]):
                    continue
                whole = last + 1 == len(folded) or not _in_word(folded[last + 1])
                if term.endswith(WHOLE) and not whole:
                    continue
                if best.get(start, (0, "", -1.0))[2] < weight:
                    best[start] = (last + 1, term, weight)
        found = []
        for start, (end, term, weight) in sorted(best.items()):
            while end < len(folded) and _in_word(folded[end]):
                end += 1
            if any(map(str.isalpha, text[start:end])) and not (term in self.around and self._excused(text, folded, start, end, term)):
                found.append((start, end, term, weight))
        return found

    def _excused(self, text: str, folded: str, start: int, end: int, term: str) -> bool:
        before, after = start, end
        while before and not _in_word(folded[before - 1]):
            before -= 1
        first = before
        while first and _in_word(folded[first - 1]):
            first -= 1
        while after < len(folded) and not _in_word(folded[after]):
            after += 1
        last = after
        while last < len(folded) and _in_word(folded[last]):
            last += 1
        left, right = words(text[first:before]), words(text[after:last])
        known = self.lexicon.exceptions
        return bool(left and (term, "<", left[0]) in known) or bool(right and (term, ">", right[0]) in known)

    def evidence(self, text: str) -> float:
        """Weights of the matches over the square root of the length; chance matches grow like that root."""
        total = sum(weight for *_, weight in self.spans(text))
        return math.log1p(total / math.sqrt(len(text.split()) + 25)) if total else 0.0


def _in_word(char: str) -> bool:
    return char.isalnum()


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> tuple[DataFrame, float, float]:
    """(text, toxic) of labelled rows that aren't held out, equal texts once, and each class's rows per sampled row."""
    marks = labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marks = marks.filter(F.col("id").isNotNull())
    sizes = {r.toxic: r["count"] for r in marks.filter(F.col("toxic").isin(0, 1)).groupBy("toxic").count().collect()}
    order = [F.xxhash64(F.col("id").cast("string"), F.lit(13)), "id"]
    sample = [marks.filter(F.col("toxic") == value).orderBy(*order).limit(max_rows) for value in (0, 1)]
    chosen = F.broadcast(written(sample[0].unionByName(sample[1]), "toxicity-labels"))  # at most 2 * max_rows ids
    rows = docs.join(chosen, docs["doc_id"] == chosen["id"]).select(whole_text(docs["text"]).alias("text"), chosen["toxic"])
    rows = rows.groupBy("text").agg(F.max("toxic").alias("toxic"))
    scale = [max(1.0, sizes.get(value, 0) / max_rows) for value in (0, 1)]
    return written(rows, "toxicity-texts"), *scale


def _term_counts(rows: DataFrame, only: frozenset[str] | None = None) -> DataFrame:
    """(term, clean, toxic): texts that have the term; partial counts leave a task before they grow large."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter(), Counter()]

        def out():
            names = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in counts)], names=["term", "clean", "toxic"])
            for c in counts:
                c.clear()

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                found = {t for word in set(words(text.as_py())) for t in terms(word)}
                counts[toxic].update(found if only is None else found & only)
                if len(counts[0]) + len(counts[1]) > 200_000:
                    yield from out()
        yield from out()

    partial = rows.mapInArrow(scan, "term string, clean long, toxic long")
    return partial.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _surroundings(rows: DataFrame, wanted: frozenset[str]) -> DataFrame:
    """Distinct (term, before, after, toxic), with the texts that have it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                row = ["", *words(text.as_py()), ""]
                found = {(term, row[i - 1], row[i + 1]) for i in range(1, len(row) - 1) for term in terms(row[i]) if term in wanted}
                cells = list(zip(*found)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.string()) for c in cells), pa.array([toxic] * len(found), pa.int32())], names=["term", "before", "after", "toxic"])

    each = rows.mapInArrow(scan, "term string, before string, after string, toxic int")
    return each.groupBy("term", "before", "after", "toxic").agg(F.count("*").alias("texts"))


def _ratio(a: float, b: float, total_a: float, total_b: float) -> float:
    """Log-likelihood ratio of a in total_a against b in total_b occurrences."""
    share = (a + b) / (total_a + total_b)
    return 2 * sum(x * math.log(x / (total * share)) for x, total in ((a, total_a), (b, total_b)) if x)


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 10_000, max_terms: int = 2_000) -> Lexicon:
    """The lexicon and curve of the labelled training rows."""
    rows, clean_scale, toxic_scale = training_rows(docs, labels, max_rows)
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    share = (toxic * toxic_scale + 1) / (toxic * toxic_scale + clean * clean_scale + 2)
    nothing = Lexicon({}, frozenset(), 0.0, math.log(share / (1 - share)))
    if not clean or not toxic:
        return nothing

    in_toxic = written(_term_counts(rows.filter("toxic = 1")).filter(F.col("toxic") >= 3), "toxicity-terms")
    seen = frozenset(r.term for r in in_toxic.select("term").collect())  # of at most max_rows texts
    counts = _term_counts(rows.filter("toxic = 0"), seen).select("term", F.col("clean").alias("b"))
    oftener = in_toxic.join(counts, "term", "left").filter(F.col("toxic") / toxic >= 3 * F.coalesce("b", F.lit(0)) / clean)
    wanted = frozenset(r.term for r in oftener.select("term").collect())
    places = written(_surroundings(rows, wanted), "toxicity-surroundings")

    sides = places.select("term", "toxic", "texts", F.explode(F.array(F.struct(F.lit("<").alias("side"), F.col("before").alias("other")), F.struct(F.lit(">").alias("side"), F.col("after").alias("other")))).alias("s"))
    phrases = sides.filter(F.col("s.other") != "").groupBy("term", "s.side", "s.other").agg(
        F.sum(F.when(F.col("toxic") == 0, F.col("texts")).otherwise(0)).alias("clean"), F.sum(F.when(F.col("toxic") == 1, F.col("texts")).otherwise(0)).alias("bad"))
    excused = written(phrases.filter((F.col("clean") >= 3) & (F.col("bad") * clean * 10 <= F.col("clean") * toxic)), "toxicity-exceptions")
    left = excused.filter("side = '<'").select("term", F.col("other").alias("before"))
    right = excused.filter("side = '>'").select("term", F.col("other").alias("after"))
    kept = places.join(left, ["term", "before"], "left_anti").join(right, ["term", "after"], "left_anti")
    weighed = kept.groupBy("term").agg(F.sum((F.col("toxic") == 0).cast("long")).alias("b"), F.sum((F.col("toxic") == 1).cast("long")).alias("a"))

    tested = max(2, len(wanted))
    found = {r.term: (r.a, r.b) for r in weighed.filter("a >= 3").collect()}
    strong = {t: (_ratio(a, b, toxic, clean), a, b) for t, (a, b) in found.items() if a / toxic >= 3 * b / clean}
    strong = {t: x for t, x in strong.items() if x[0] >= 2 * math.log(tested) + 10}
    chosen = _longest(strong)
    chosen = dict(sorted(chosen.items(), key=lambda x: (-x[1][0], x[0]))[:max_terms])
    if not chosen:
        return nothing
    weights = {t: math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1)) for t, (_, a, b) in chosen.items()}
    exceptions = frozenset((r.term, r.side, r.other) for r in excused.filter(F.col("term").isin(list(weights))).collect())
    lexicon = Lexicon({t: w for t, w in weights.items() if w > 0}, exceptions, 0.0, nothing.intercept)

    features = _evidence(rows, lexicon).withColumn("weight", F.when(F.col("toxic") == 1, toxic_scale).otherwise(clean_scale))
    ready = features.select(array_to_vector(F.array("evidence")).alias("features"), F.col("toxic").cast("double").alias("label"), "weight")
    curve = LogisticRegression(regParam=1e-4, standardization=False, weightCol="weight", maxIter=100).fit(ready)
    return Lexicon(lexicon.weights, exceptions, float(curve.coefficients[0]), float(curve.intercept))


def _longest(strong: dict[str, tuple[float, int, int]]) -> dict[str, tuple[float, int, int]]:
    """Without stems that a longer term explains (95 % of their evidence), then without terms inside a stem that is no less telling."""
    longer: Counter = Counter()
    for term, (_, a, _) in strong.items():
        bare = term.removesuffix(WHOLE)
        for n in range(MIN_STEM, len(bare) + (term != bare)):
            longer[bare[:n]] = max(longer[bare[:n]], a)
    closed = {t: x for t, x in strong.items() if t.endswith(WHOLE) or longer[t] < 0.95 * x[1]}

    def covered(term):
        bare, (_, a, b) = term.removesuffix(WHOLE), closed[term]
        stems = [bare[:n] for n in range(MIN_STEM, len(bare) + (term != bare)) if bare[:n] in closed]
        return any(closed[s][2] * a <= b * closed[s][1] for s in stems)

    return {t: x for t, x in closed.items() if not covered(t)}


def _evidence(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows with their evidence, in place of the text."""
    sent = rows.sparkSession.sparkContext.broadcast(lexicon)
    others = [c for c in rows.columns if c != "text"]
    schema = rows.select(*others).schema.add("evidence", "double")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value)
        for batch in batches:
            values = np.fromiter((matcher.evidence(t.as_py()) for t in batch.column("text")), np.float64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(values)], names=[*others, "evidence"])

    return rows.mapInArrow(scan, schema)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    rows = docs.select("doc_id", whole_text(F.col("text")).alias("text"))
    found = _evidence(rows, lexicon)
    probability = 1 / (1 + F.exp(-(F.lit(lexicon.intercept) + F.lit(lexicon.slope) * F.col("evidence"))))
    scored = found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), probability.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
