"""All keywords of all lexicons in one walk over a text, with regard to negators before them.

The rules of ``rules.mentions``, which asks for one keyword after the other; here an Aho-Corasick automaton holds all of
them, so the time of a text doesn't grow with their number. Texts are lower-cased by Spark before.
"""

from __future__ import annotations

import functools
from bisect import bisect_left, bisect_right
from collections.abc import Mapping, Sequence

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, functions as F

from tussis.functions.rules import CLAUSE_BREAK, WORD

_BLANKS = r"[ \t\n\x0B\f\r\p{Z}]+"
_BREAKS = regex.compile(CLAUSE_BREAK)
_IN_WORD = regex.compile(f"[{WORD}]")


@functools.lru_cache(maxsize=8)
def _automaton(lexicon: tuple[tuple[str, tuple[str, ...]], ...]) -> ahocorasick.Automaton:
    labels: dict[str, set[str]] = {}
    for label, words in lexicon:
        for word in words:
            labels.setdefault(word, set()).add(label)
    automaton = ahocorasick.Automaton()
    for word, names in labels.items():
        automaton.add_word(word, (len(word), tuple(sorted(names))))
    automaton.make_automaton()
    return automaton


@functools.lru_cache(maxsize=8)
def _negators(negators: tuple[str, ...]) -> tuple[regex.Pattern, tuple[regex.Pattern, ...]] | None:
    """A pattern for places where any negator starts, and one for each negator there."""
    each = [_BLANKS.join(regex.escape(w) for w in n.lower().split()) for n in negators]
    if not each:
        return None
    return regex.compile(rf"(?<![{WORD}])(?={'|'.join(each)})"), tuple(regex.compile(p) for p in each)


def negator_ends(lowered: str, negators: tuple[str, ...]) -> tuple[list[int], set[int]]:
    """Ends of negators: in order where no letter or digit follows, and all of them."""
    patterns = _negators(negators)
    if patterns is None:
        return [], set()
    starts, each = patterns
    ends = {m.end() for at in starts.finditer(lowered) for p in each if (m := p.match(lowered, at.start()))}
    return sorted(e for e in ends if e < len(lowered) and not _IN_WORD.match(lowered[e])), ends


def labels_in(lowered: str, lexicon: tuple[tuple[str, tuple[str, ...]], ...], negators: tuple[str, ...]) -> list[str]:
    """Sorted labels of which a keyword occurs without a negator before it in its clause."""
    hits = [(end + 1 - size, names) for end, (size, names) in _automaton(lexicon).iter(lowered)] if lexicon else []
    if not hits:
        return []
    complete, ends = negator_ends(lowered, negators)
    breaks = [m.end() for m in _BREAKS.finditer(lowered)] if ends else []
    found: set[str] = set()
    for start, names in hits:
        if found.issuperset(names):
            continue
        if ends:
            at = bisect_right(breaks, start)
            begin = breaks[at - 1] if at else 0
            first = bisect_right(complete, begin)  # a negator ends after its clause's first place
            if first < bisect_left(complete, start) or start in ends and start > begin:
                continue
        found.update(names)
    return sorted(found)


def lexicon_labels(text: Column, lexicon: Mapping[str, Sequence[str]], negators: Sequence[str]) -> Column:
    """``array<string>``: sorted labels of ``lexicon`` (label to keywords) mentioned un-negated in ``text``.

    Keywords match as substrings in any case and must lie within a clause; blank ones aren't allowed. A null or empty text has no
    labels, an empty lexicon gives none.
    """
    fixed = tuple((label, tuple(w.lower() for w in words)) for label, words in lexicon.items())
    for _, words in fixed:
        for word in words:
            if not word or _BREAKS.search(word):
                raise ValueError(f"a keyword must lie within a clause: {word!r}")
    before = tuple(negators)

    @F.pandas_udf("array<string>")
    def labels(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: labels_in(t, fixed, before))

    return labels(F.lower(F.coalesce(text, F.lit(""))))
