import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tussis.llm import lm_scoring as lm


def lowered(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


class Brute:
    """The same model, symbol by symbol: longest context in the trie, method D escapes, exclusion."""

    def __init__(self, texts, keep=None):
        self.counts = defaultdict(Counter)
        for t in texts:
            s = [256] * lm.ORDER + list(t) + [256]
            for i in range(lm.ORDER, len(s)):
                for k in range(lm.ORDER + 1):
                    self.counts[tuple(s[i - k : i])][s[i]] += 1
        if keep is not None:
            self.counts = {c: v for c, v in self.counts.items() if c in keep}

    def score(self, text):
        s, total = [256] * lm.ORDER + list(text) + [256], 0.0
        for i in range(lm.ORDER, len(s)):
            excluded = set()
            for k in range(lm.ORDER, -1, -1):
                seen = self.counts.get(tuple(s[i - k : i]))
                if not seen:
                    continue
                left = {x: n for x, n in seen.items() if x not in excluded}
                if not left:
                    continue
                mass = sum(left.values())
                if s[i] in left:
                    total += math.log10((left[s[i]] - 0.5) / mass)
                    break
                total += math.log10(0.5 * len(left) / mass)
                excluded |= set(left)
            else:
                total -= math.log10(257 - len(excluded))
        return total


def trie(texts, nodes=None):
    """Contexts and entries as the job gathers them, without Spark."""
    brute = Brute(texts)
    size = {c: sum(v.values()) for c, v in brute.counts.items()}
    kept = sorted(size, key=lambda c: (-size[c], len(c), c))[:nodes]
    if nodes:
        level = lambda c: math.floor(math.log2(size[c]) * lm.CLASSES)
        worst = level(kept[-1])
        kept = [c for c in kept if level(c) > worst] or [()]
    name = lambda c: sum(x << (lm.SYMBOL_BITS * j) for j, x in enumerate(reversed(c))) << lm.ORDER_BITS | len(c)
    entries = [(name(c), s, n) for c in kept for s, n in brute.counts[c].items()]
    arrays = [np.array(x, np.int64) for x in zip(*entries)] or [np.zeros(0, np.int64)] * 3
    return lm.Automaton(np.array([name(c) for c in kept], np.int64), *arrays), Brute(texts, set(kept)) if texts else brute


def test_automaton_equals_brute_force(monkeypatch):
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abcd  \n\xc3\xa9") for _ in range(rng.randint(0, 90))) for _ in range(40)]
    probes = texts[:5] + [b"", b"z", b"abz abcd", bytes(range(256)), b"ab" * 700, "naïve é".encode()]
    for nodes in (None, 40, 3):
        automaton, brute = trie(texts, nodes)
        for lane in (lm.LANE, 7):
            monkeypatch.setattr(lm, "LANE", lane)
            assert np.allclose(automaton.scores(probes), [brute.score(p) for p in probes], rtol=1e-9)


def test_probabilities_add_up():
    automaton, _ = trie([b"abracadabra", b"banana", b""])
    seen = automaton.width - 1
    p = 10 ** automaton.score.reshape(-1, automaton.width)
    assert np.allclose(p[:, :seen].sum(axis=1) + (257 - seen) * p[:, seen], 1)


def test_gram_keys():
    keys = lm.gram_keys([b"ab", b""])
    assert len(keys) == 4 and sorted(keys & 511) == [97, 98, 256, 256]
    assert (keys[1] >> 9 & 511, keys[1] >> 18 & 511) == (97, 256)


ROWS = [(i, f"The cat {i % 7} sat on Mat number{i}.", "x") for i in range(60)] + [(1, "The cat 1 sat on Mat number1.", "x"), (None, None, "x"), (70, None, "x"), (71, "", "x"), (72, "Ünseen \x1c wörds " * 4000, "x")]


@pytest.mark.parametrize("frequent", [lm.FREQUENT_WORDS, 3])
def test_scores_equal_brute_force(spark, frequent):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, score string").repartition(3)
    got = lm.score_texts(df, lm.every_seventh(F.col("doc_id")), frequent_words=frequent).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    training = [lowered(t) for i, t, _ in ROWS if not held(i)]
    tokens = lambda raw: [*re.findall(rb"[^\x20\x09-\x0D]+", raw), None]
    c = Counter(w for raw in training for w in tokens(raw))
    n, v, model = sum(c.values()), len(c), Brute(training)
    want = {}
    for i, t, _ in ROWS:
        raw = lowered(t)
        w = tokens(raw)
        want[i] = (held(i), len(w), sum(x in c for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), model.score(raw))
    assert len(got) == len(ROWS)
    for r in got:
        a = want[r.doc_id]
        assert tuple(r)[1:5] == a[:4]
        assert math.isclose(r.base_score, a[4], rel_tol=1e-9) and math.isclose(r.score, a[5], rel_tol=1e-9)


def test_held_out_texts_take_less_than_half_of_plain_bytes(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    score = lm.score_texts(docs, lm.every_seventh(F.col("doc_id"))).filter("held_out").agg(F.sum("score")).first()[0]
    size = docs.filter(lm.every_seventh(F.col("doc_id"))).agg(F.sum(F.octet_length("text") + 1)).first()[0]
    assert -score / math.log10(256) < 0.5 * size


def test_no_training_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in lm.score_texts(df, F.lit(True)).collect()}
    assert rows[1].train_tokens == rows[1].n_known == 0 and rows[1].n_tokens == 2 and rows[1].base_score == 0
    assert math.isclose(rows[1].score, -4 * math.log10(257))
    assert lm.score_texts(df.limit(0), F.lit(False)).count() == 0


def test_every_context_counts_whatever_the_automaton_holds(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcd  \né") for _ in range(rng.randint(0, 300))) for _ in range(60)] + [None, "", "abc " * 900]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    model = Brute([lowered(t) for i, t in enumerate(texts) if i % 4])
    for nodes in (0, 40, 1000):
        got = {r.doc_id: r.score for r in lm.score_texts(df, F.col("doc_id") % 4 == 0, nodes=nodes).collect()}
        assert len(got) == len(texts)
        assert all(math.isclose(got[i], model.score(lowered(t)), rel_tol=1e-9) for i, t in enumerate(texts))


def test_batches_are_cut_by_bytes(spark, monkeypatch):
    texts = [b"x" * n for n in (3, 50, 0, 7, 7, 7, 200, 1)] + [b"y"] * 1200
    whole = pa.RecordBatch.from_arrays([pa.array(texts)], ["b"])
    monkeypatch.setattr(lm, "BATCH_BYTES", 20)
    cut = [[len(x) for x in b.column(0).to_pylist()] for b in lm._batches(whole, 0)]
    assert sum(cut, []) == [len(t) for t in texts] and cut[:5] == [[3], [50], [0, 7, 7], [7], [200]] and all(len(c) <= lm.TEXTS for c in cut)
    assert list(lm._batches(whole.slice(0, 0), 0)) == []


def test_counts_are_dealt_once_but_to_crowded_buckets(spark, monkeypatch):
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 200))) for _ in range(80)] + ["xyz" * rng.randint(1, 40) for _ in range(40)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    model = Brute([lowered(t) for i, t in enumerate(texts) if i % 4])
    monkeypatch.setattr(lm, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(lm, "LEAST_BUCKETS", 3)
    monkeypatch.setattr(lm, "GATHERED", 300)
    for crowd in (50, 1 << 22):
        monkeypatch.setattr(lm, "SLICE_PLACES", crowd)
        got = {r.doc_id: r.score for r in lm.score_texts(df, F.col("doc_id") % 4 == 0, nodes=5).collect()}
        assert len(got) == len(texts)
        assert all(math.isclose(got[i], model.score(lowered(t)), rel_tol=1e-9) for i, t in enumerate(texts))
    grams = spark.createDataFrame([(k, 1) for k in range(600)], "gram bigint, n bigint").repartition(1)
    monkeypatch.setattr(lm, "GATHERED", 1 << 19)
    nothing = spark.createDataFrame([], "cell int, slices int")
    pieces = lm.dealt_counts(grams, nothing, 7).collect()
    crowded = spark.createDataFrame([(pieces[0].cell, 5)], "cell int, slices int")
    again = lm.dealt_counts(grams, crowded, 7).collect()
    assert sorted(p.slice for p in again if p.cell == pieces[0].cell) == [0, 1, 2, 3, 4]
    assert len(again) == len(pieces) + 4 and len({p.cell for p in pieces}) == len(pieces)
    places = spark.createDataFrame([(c, r, b"", n) for c, r, n in ((0, 1, 40), (0, 2, 30), (1, 1, 50))], "cell int, row bigint, piece binary, n bigint")
    monkeypatch.setattr(lm, "SLICE_PLACES", 50)
    assert [tuple(r) for r in lm.bucket_slices(places).collect()] == [(0, 2)]
