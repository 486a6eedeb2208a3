"""Phrases compared with counting everything, and their defined cases."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tussis.llm import collocations as c

SCHEMA = "doc_id long, text string, lang string, n long, phrase string"


def brute(rows, min_count, max_words, top):
    """(lang, rank, phrase, a, l, r, n, score) by counting every phrase."""
    counts, sizes = {}, Counter()
    for text, lang in rows:
        lang = lang or "und"
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower):
            words = re.findall(r"[^ \t]+", piece)
            sizes[lang] += len(words)
            for i in range(len(words)):
                for m in range(1, max_words + 1):
                    if i + m <= len(words):
                        counts.setdefault(lang, Counter())[tuple(words[i : i + m])] += 1
    out = set()
    for lang, found in counts.items():
        often = {p: a for p, a in found.items() if a >= min_count and len(p) > 1}
        left = []
        for p, a in often.items():
            inside = any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in often.items())
            if not inside:
                cuts = [(1000 * a * sizes[lang] // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                left.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(left)[:top], 1):
            out.add((lang, rank, p.decode(), -a, l, r, sizes[lang], -score))
    return out


def corpus(seed=3, docs=120):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["É", "ärger", "日本", "the", "THE", "x"]
    rows = []
    for i in range(docs):
        lang = rnd.choice(["en", "en", "de", None, "und"])
        text = " ".join(rnd.choice(words[: rnd.choice([4, 12, len(words)])]) + rnd.choice(["", "", "", ".", ",", "\n", "\t", "!"]) for _ in range(rnd.randint(0, 60)))
        rows.append((i, text, lang, 1, "p"))
    passage = "salt of the old sea road"
    rows += [(500 + i, f"{passage} w{i % 3}", "en", 1, "q") for i in range(9)]
    rows += [(600, "a a a a a a a a", "de", 1, None), (601, None, "de", 1, None), (602, "", None, 1, None), (None, "\x00 \x00 \x00 \x00 \x00", "de", 1, None)]
    return rows + rows[:10]


@pytest.mark.parametrize("shares,lookup,top", [((0.05, 0.3, 1.0), 7, 4), ((1.0,), 1000, 2000), ((0.2, 0.5, 0.9, 1.0), 1000, 12)])
def test_equal_to_counting_everything(spark, shares, lookup, top):
    rows = corpus()
    found = c.collocations(spark.createDataFrame(rows, SCHEMA), min_count=4, top=top, lookup=lookup, shares=shares)
    expected = brute([(r[1], r[2]) for r in rows], 4, 5, top)
    assert {tuple(r) for r in found.collect()} == expected and len(expected) > 5


def test_growth_stops_when_settled(spark, monkeypatch):
    rows = [(i, f"rare{i % 40} pair{i % 40}. " + "the of the of and " * 5, "en", 1, "") for i in range(400)]
    scans = []
    plain = c._pairs
    monkeypatch.setattr(c, "_pairs", lambda *a: scans.append(1) or plain(*a))
    found = c.collocations(spark.createDataFrame(rows, SCHEMA), min_count=5, top=10, shares=(0.2, 1.0))
    assert found.count() == 10 and len(scans) == 1


def test_ties_fill_the_last_rank_by_count_and_phrase(spark):
    rows = [(i, "b c. a d. z y", "en", 1, "") for i in range(5)] + [(9, "z y", "en", 1, "")]
    found = c.collocations(spark.createDataFrame(rows, SCHEMA), min_count=5, top=2).orderBy("rank").collect()
    assert [r.phrase for r in found] == ["a d", "b c"]


def test_products_pass_64_bits(spark):
    row = spark.range(1).select(F.lit(3_000_000_000_000).alias("a"), F.lit(9_000_000_000_001).alias("n"), F.lit(4_000_000_000_000).alias("l"), F.lit(3_100_000_000_000).alias("r"))
    assert row.select(c._score("a", "n", "l", "r").alias("s")).first().s == 1000 * 3_000_000_000_000 * 9_000_000_000_001 // (4_000_000_000_000 * 3_100_000_000_000)


def test_empty_table_and_long_text(spark, monkeypatch):
    assert c.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert c.collocations(spark.createDataFrame([(1, None, None, 0, "")], SCHEMA)).collect() == []
    text = "alpha beta gamma, " * 60_000  # more than one stretch
    tokens = list(c.stretches(text))
    assert len(tokens) > 1 and sum(len(t) - t.count(c.END) for t in tokens) == 180_000
    found = c.collocations(spark.createDataFrame([(1, text, "en", 0, "")], SCHEMA)).collect()
    assert [(r.phrase, r.a) for r in found] == [("alpha beta gamma", 60_000)]
