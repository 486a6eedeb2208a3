"""Folding, matching against a plain search, what is learned from planted rows, and held-out accuracy on the given tables."""

import random
import zlib

import pytest

from tussis.llm import toxicity as t

DOCS, LABELS = "doc_id long, text string, toxic int, id string", "doc_id long, quality int, toxic int, text string"


def test_folding_keeps_positions_and_joins_lookalikes():
    for text in ("1D10T", "іdiоt", "ídïót", "ｉｄｉｏｔ", "ldiot"):
        assert t.fold(text) == "idiot" and len(t.fold(text)) == len(text)
    assert t.words("In 1990, 5tup1d naïve") == ["in", "1990", "stupid", "naive"]
    assert t.fold("𝐢diot") == "idiot" and t.fold("日本 İ")[:2] == "日本"


def naive(lexicon, text):
    folded, found, at = t.fold(text), [], 0
    for word in t.WORD.finditer(folded):
        fits = [(w, term) for term, w in lexicon.weights.items() if (word[0] == term[:-1] if term.endswith(" ") else word[0].startswith(term))]
        if fits and any(map(str.isalpha, text[word.start() : word.end()])):
            found.append((word.start(), word.end(), max(w for w, _ in fits)))
    return found


def test_matches_equal_a_plain_search():
    rnd = random.Random(5)
    lexicon = t.Lexicon({"idiot ": 3.0, "troi": 2.0, "troii ": 4.0, "bad ": 1.0, "abab": 1.5}, frozenset(), 1.0, -1.0)
    matcher = t.Matcher(lexicon)
    for _ in range(300):
        text = "".join(rnd.choice(["idiot", "1d10t", "troll", "trolling", "bad", "badly", "ababab", "8ad", "8", "1", " ", " ", "-", "_", "é", "."]) for _ in range(12))
        assert [(a, b, w) for a, b, _, w in matcher.spans(text)] == naive(lexicon, text)


def test_exception_phrases_count_for_nothing():
    lexicon = t.Lexicon({"ciown ": 3.0}, frozenset({("ciown ", "<", "ciass"), ("ciown ", ">", "fish")}), 1.0, -1.0)
    matcher = t.Matcher(lexicon)
    assert [s[:2] for s in matcher.spans("Class clown, clown - fish; a C10WN")] == [(29, 34)]
    assert matcher.evidence("the class  clown") == 0.0 and matcher.evidence("") == 0.0


def made(n=1500, seed=2):
    rnd = random.Random(seed)
    plain = [f"{a}{b}" for a in ("ka", "mo", "ri", "tu", "ze") for b in ("lan", "dor", "vim", "pes", "sol", "gat")]
    docs, labels = [], []
    for i in range(n):
        words, toxic = [rnd.choice(plain) for _ in range(rnd.randint(6, 80))], rnd.random() < 0.15
        if toxic:
            for _ in range(rnd.randint(2, 4)):
                words.insert(rnd.randrange(len(words)), rnd.choice(["vermin", "v3rm1n", "grubby" + rnd.choice(plain)]))
        elif rnd.random() < 0.2:
            at = rnd.randrange(len(words))
            words[at:at] = ["garden", "vermin", "control"]
        docs.append((i, " ".join(words) + ".", 1 - int(toxic), "x"))
        labels.append((i, 1, int(toxic), "vermin"))
    return docs, labels


def test_learns_stems_words_and_exceptions(spark):
    docs, labels = made()
    rows, marks = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    lexicon = t.learn(rows, marks)
    assert {"vermin ", "grubby"} <= set(lexicon.weights) and ("vermin ", "<", "garden") in lexicon.exceptions
    scored = {r.doc_id: r for r in t.score(rows, lexicon).collect()}
    held = [(scored[i].predicted, toxic) for i, _, toxic, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(scored[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in labels)
    assert sum(a == b for a, b in held) >= 0.98 * len(held)


def test_held_out_labels_have_no_influence(spark):
    docs, labels = made(600)
    turned = [(i, q, 1 - toxic if zlib.crc32(str(i).encode()) % 5 == 0 else toxic, s) for i, q, toxic, s in labels]
    rows = spark.createDataFrame(docs, DOCS)
    a, b = (t.learn(rows, spark.createDataFrame(x, LABELS)) for x in (labels, turned))
    assert a.weights == b.weights and a.exceptions == b.exceptions and a.slope == pytest.approx(b.slope)


def test_defined_cases(spark):
    docs, labels = made(400)
    rows = [*docs, (1, None, 0, ""), (None, "vermin", 0, ""), (7, "", 0, ""), (9, "vermin " * 40_000, 0, ""), docs[3], docs[3]]
    marks = [*labels, (None, 1, 1, ""), (2, 1, None, ""), labels[3]]
    df = spark.createDataFrame(rows, DOCS)
    found = t.score(df, t.learn(df, spark.createDataFrame(marks, LABELS)))
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    got = found.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert next(r for r in got if r.doc_id is None).held_out is True
    empty = spark.createDataFrame([], DOCS)
    assert t.score(empty, t.learn(empty, spark.createDataFrame([], LABELS))).collect() == []
    clean = t.learn(df, spark.createDataFrame([(i, 1, 0, "") for i in range(50)], LABELS))
    assert clean.weights == {} and 0 < t.score(df, clean).first().score < 0.1


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    scored = t.score(docs, t.learn(docs, labels)).filter("held_out").join(labels.select("doc_id", "toxic"), "doc_id").collect()
    toxic, clean = ([r.predicted for r in scored if r.toxic == v] for v in (1, 0))
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.01 * len(clean)
