import random
import re

from tussis.llm import decontamination

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return PATTERN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, held = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i : i + n]))
                if found:
                    hit.update(range(i, i + n))
                    held |= found
        out.append((doc, len(w), len(hit), sorted(str(i) for i in held if i is not None), bool(hit)))
    return sorted(map(str, out))


def tables(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "É", "x1", "word", "naïve", "zz"]  # few words: many chance beginnings
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice((1, 2, 3, 9, 10, 11, 25)))) for i in range(25)] + [(None, text(12)), (90, None), (91, "..."), (92, "")]
    items.append((93, items[6][1]))
    docs = [(i, text(rng.choice((0, 1, 5, 12, 60)))) for i in range(60)]
    for i in range(60, 100):
        docs.append((i, text(7) + ", " + (rng.choice(items)[1] or "").upper() + "! " + text(7)))
    docs += [(99, docs[99][1])] * 20 + [(None, docs[70][1]), (None, None), (5, None), (101, text(20_000) + " " + items[4][1])]
    return docs, items


def test_equal_to_brute_force(spark):
    for seed, width in ((1, 10), (2, 4)):
        docs, items = tables(seed)
        d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "text as n", "doc_id as pos")
        i = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as doc_id")
        got = decontamination.report(d, i, width).collect()
        assert sorted(str((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated)) for r in got) == brute(docs, items, width)
        kept = decontamination.decontaminate(d, i, width)
        assert kept.columns == d.columns and kept.count() == sum(not r.contaminated for r in got)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha one two three beta"), (2, "alpha one beta"), (3, "beta alpha"), (4, "alpha " + "x " * 30 + "beta")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "alpha beta")], "item_id bigint, text string")
    windows, _ = decontamination.windows_of(items, 10)
    assert {r.doc_id for r in decontamination.proximity_matches(docs, windows, 3).collect()} == {1, 2, 3}
    assert {r.doc_id for r in decontamination.proximity_matches(docs, windows, 1).collect()} == {2}
    assert decontamination.phrase_matches(docs, windows).count() == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "some words")], "item_id bigint, text string")
    assert decontamination.report(docs.limit(0), items).count() == 0
    assert [r.contaminated for r in decontamination.report(docs, items.limit(0)).collect()] == [False, False]
    assert decontamination.decontaminate(docs, items.limit(0)).count() == 2
