"""Line-first quality rules.

Each line is judged first: by its punctuation, as navigation, as boilerplate. Failing lines are removed, and a
document that loses more than half of its text that way is rejected. Documents of very few words or with much
repetition are rejected before that.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tussis.llm.common import fresh, whole_text

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\v\f\r"
REPEAT_WORDS = 5


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    #: Largest share of words inside repeated windows, in percent.
    max_repeat_percent: int = 20
    #: A line fails with more than one symbol per so many words.
    words_per_symbol: int = 5
    #: A line is navigation with so many separators, and at most so many words to each.
    min_separators: int = 2
    words_per_separator: int = 4
    #: A document is rejected if its lines that stay hold less than so many percent of its word characters.
    min_kept_percent: int = 50


#: Marks that show a sentence: of Latin, Greek, CJK, Arabic, Devanagari, Armenian, Ethiopic, Khmer, Burmese and Tibetan
#: scripts. Thai and Lao use none: there, a stretch of letters that is longer than a label shows it.
SENTENCE_MARK = re.compile("[.!?…。！？．؟۔।॥։።፧\u17d4\u17d5\u104a\u104b\u0f0d\u0f0e]|[\u0e01-\u0e5b\u0e81-\u0edf]{10}")
SEPARATOR = re.compile("[|»›·•→]")
PHRASES = (
    r"all rights reserved|cookie policy|accept (?:all )?cookies|uses? cookies|privacy policy|terms (?:of|and) (?:use|service|conditions)"
    r"|enable javascript|javascript is (?:disabled|required)|lorem ipsum|(?:sign|log) in (?:or|to)|subscribe to (?:our|the) newsletter"
    r"|skip to (?:main )?content|click here to|back to top"
)
#: Most words before, between and after the phrases of a line that is boilerplate. Longer lines are prose that mentions one.
PHRASE_GAP = 15
ANY_PHRASE = re.compile(PHRASES, re.IGNORECASE)
#: Each phrase, also those that begin inside another.
PHRASE = re.compile(f"(?=({PHRASES}))", re.IGNORECASE)
_GAP = rf"[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){{0,{PHRASE_GAP - 1}}}[^\x20\x09-\x0D]*[\x20\x09-\x0D]*"
#: The rule of ``is_boilerplate`` as one pattern, for engines that don't backtrack.
BOILERPLATE = re.compile(f"^{_GAP}(?:(?:{PHRASES}){_GAP})+$", re.IGNORECASE)


def is_boilerplate(line: str) -> bool:
    """The line holds a phrase, and nowhere more than ``PHRASE_GAP`` words on end without one."""

    def fits(gap: str) -> bool:
        return len(gap.encode("utf-8", "replace").split()) <= PHRASE_GAP

    if not ANY_PHRASE.search(line):
        return False
    ends = [0]
    for phrase in PHRASE.finditer(line):
        begin, end = phrase.span(1)
        if fits(line[next(e for e in reversed(ends) if e <= begin) : begin]):
            ends.append(end)
        elif ends[-1] <= begin:
            return False
    return len(ends) > 1 and fits(line[ends[-1] :])


def line_passes(line: str, n_words: int, rules: Rules) -> bool:
    """A line with words passes all three kinds of rules."""
    symbols = sum(line.count(c) for c in SYMBOLS.decode())
    if symbols * rules.words_per_symbol > n_words or not SENTENCE_MARK.search(line):
        return False
    separators = len(SEPARATOR.findall(line))
    if separators >= rules.min_separators and n_words <= separators * rules.words_per_separator:
        return False
    return not is_boilerplate(line)


def repeat_words(words: list[bytes]) -> int:
    """Words inside windows of five that occur twice or more in the text, the first occurrence included."""
    k = REPEAT_WORDS
    if len(words) <= k:
        return 0

    def windows():
        return zip(*(words[i:] for i in range(k)))

    hashes = list(map(hash, windows()))  # equal windows have equal hashes, so without equal hashes nothing repeats
    if len(set(hashes)) == len(hashes):
        return 0
    often = {h for h, n in Counter(hashes).items() if n > 1}
    counts = Counter(w for h, w in zip(hashes, windows()) if h in often)
    total, reached = 0, 0
    for i, (h, w) in enumerate(zip(hashes, windows())):
        if h in often and counts[w] > 1:
            total += i + k - max(i, reached)
            reached = i + k
    return total


def judge(raw: bytes, rules: Rules) -> tuple[tuple, str | None]:
    """Figures and verdict of one text, and the text without failing lines (None: every line stays)."""
    words = raw.split()  # at ASCII white space, which is what parts words
    text = raw.decode("utf-8", "replace")
    word_chars = len(text) - sum(raw.count(c) for c in BLANKS)
    symbols = sum(raw.count(c) for c in SYMBOLS)
    lines = text.split("\n")
    filled = [line for line in raw.split(b"\n") if line.strip()]
    repeated = repeat_words(words)
    failed = len(words) < rules.min_words or 100 * repeated > rules.max_repeat_percent * len(words)

    stays, lost = [], 0
    for line in lines:
        n = len(line.encode("utf-8", "replace").split())
        if n and not line_passes(line, n, rules):
            lost += len(line) - sum(line.count(chr(c)) for c in BLANKS)
        else:
            stays.append(line)
    kept = not failed and 100 * (word_chars - lost) >= rules.min_kept_percent * word_chars
    figures = (len(words), word_chars, symbols, len(filled) - len(set(filled)), repeated, failed, kept, word_chars - lost)
    return figures, None if len(stays) == len(lines) else "\n".join(stays)


FIGURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, kept_chars bigint"
_ARROW = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()]
_NAMES = [c.split()[0] for c in FIGURES.split(", ")]


def quality_report(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per document: ``doc_id``, the figures, ``base_failed``, ``kept`` and ``kept_chars``.

    Null and empty texts have no words and fail. A line without words is never removed. Each row is judged alone, so
    repeated rows get equal rows; an empty table gives none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(t.as_buffer().to_pybytes(), rules)[0] for t in batch.column(1)]
            columns = zip(*rows) if rows else [[]] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, _ARROW))], ["doc_id", *_NAMES])

    narrow = docs.select("doc_id", whole_text(F.col("text")).cast("binary").alias("b"))
    return narrow.mapInArrow(run, f"doc_id {dict(narrow.dtypes)['doc_id']}, {FIGURES}")


def clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, without their failing lines; all columns stay, ``n_chars`` is counted again where present.

    A text of which every line passes comes back byte for byte.
    """

    @F.arrow_udf("struct<kept boolean, text string>")
    def verdict(texts: pa.Array) -> pa.Array:
        kept, cleaned = [], []
        for t in texts:
            figures, text = judge(t.as_buffer().to_pybytes(), rules)
            kept.append(figures[6])
            cleaned.append(text if figures[6] else None)
        return pa.StructArray.from_arrays([pa.array(kept, pa.bool_()), pa.array(cleaned, pa.string())], ["kept", "text"])

    (name,) = fresh(docs, "__verdict")
    judged = docs.withColumn(name, verdict.asNondeterministic()(whole_text(docs["text"]).cast("binary"))).filter(F.col(f"{name}.kept"))
    changed = F.col(f"{name}.text")
    values = {"text": F.coalesce(changed, F.col("text"))}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(changed.isNull(), F.col("n_chars")).otherwise(F.char_length(changed).cast(docs.schema["n_chars"].dataType))
    return judged.withColumns(values).drop(name)
