import random

import numpy as np

from tussis.llm import substring_dedup as sd


def prose(rng, n):
    syllables = ["the", "of", "an", "ti", "on", "er", "ea", "sh", "ble", "ndr", "é", "ou", "st", "ing"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def brute_cuts(raw, reach):
    h = []
    for i in range(len(raw)):
        value = sum(int(sd.GEAR[raw[i - j]]) << j for j in range(min(sd.ROLL, i + 1))) % (1 << 32) + 1
        h.append(0 if raw[i] & 0xC0 == 0x80 else value)
    at = lambda i: h[i] if 0 <= i < len(h) else 0
    return [i for i in range(1, len(h)) if h[i] > max(at(j) for j in range(i - reach, i)) and h[i] >= max(at(j) for j in range(i + 1, i + reach + 1)) and h[i]]


def test_cuts_equal_brute_force(monkeypatch):
    rng = random.Random(1)
    for n in (0, 1, 5, 60, 400):
        raw = prose(rng, n).encode() + bytes(10)
        for reach in (24, 16, 5):
            assert sd.cuts(np.frombuffer(raw, np.uint8), reach).tolist() == brute_cuts(raw, reach)
    monkeypatch.setattr(sd, "PIECE", 100)  # piece by piece gives the same
    raw = prose(rng, 300).encode()
    assert sd.cuts(np.frombuffer(raw, np.uint8)).tolist() == brute_cuts(raw, sd.REACH)


def test_chunks_cover_the_text_and_resist_insertions():
    rng = random.Random(2)
    raw = prose(rng, 3000).encode()
    start, end, words = sd.chunk_spans(raw)
    assert start[0] == 0 and end[-1] == len(raw) and (start[1:] == end[:-1]).all() and words.sum() == len(raw.split())
    assert all(raw[a:b].decode() for a, b in zip(start, end)) and (end - start)[1:-1].min() > sd.REACH
    changed = raw[:5000] + b" inserted words " + raw[5000:]
    pieces = {raw[a:b] for a, b in zip(start, end)}
    other = {changed[a:b] for a, b, _ in zip(*sd.chunk_spans(changed))}
    assert len(pieces - other) <= 5


def test_passages_of_over_fifty_words_are_found(spark):
    rng = random.Random(3)
    passages = [prose(rng, 52) for _ in range(40)]
    rows = [(i, prose(rng, 150)) for i in range(200)]
    planted = {}
    for k, p in enumerate(passages):
        for _ in range(2 + k % 3):
            doc = 1000 + len(planted)
            planted[doc] = k
            rows.append((doc, prose(rng, rng.randint(5, 90)) + " " + p + " " + prose(rng, rng.randint(5, 90))))
    short = prose(rng, 12)
    rows += [(5000 + i, prose(rng, 40) + "\n" + short + "\n" + prose(rng, 40)) for i in range(30)]
    rows += [(6000, rows[0][1]), (None, rows[1][1]), (7000, None), (7001, ""), (7002, ""), (8000, prose(rng, 200)), (8000, rows[2][1]), (8001, "x" * 300_000), (8002, "x" * 300_000)]
    rows += [rows[3], rows[3]]
    rows.append((9000, (lambda p: p + " " + p)(prose(rng, 80))))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as row", "2 as spans").repartition(5)
    got = sd.repeats(df).collect()
    ids = [r.doc_id for r in got]
    assert sorted(map(str, ids)) == sorted(map(str, [*planted, 0, 6000, 1, None, 2, 8000, 8001, 8002]))
    groups = {}
    for r in got:
        if r.doc_id in planted:
            groups.setdefault(r.first_id, set()).add(planted[r.doc_id])
            assert r.n_words >= sd.MIN_RUN_WORDS
    assert all(len(g) == 1 for g in groups.values())
    firsts = {r.doc_id: r.first_id for r in got}
    assert firsts[6000] == 0 and firsts[8000] == 2 and firsts[8002] == 8001 and firsts[None] == 1

    cut = sd.remove_repeats(df)
    assert cut.columns == df.columns and cut.count() == len(rows)
    text = {r.doc_id: r.text for r in cut.collect()}
    assert text[0] == rows[0][1] and text[6000] == "" and text[5000] == rows[[i for i, _ in rows].index(5000)][1]
    first = min(d for d, k in planted.items() if k == 0)
    assert len(text[first + 1]) < len(dict(rows)[first + 1]) - 100


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert sd.repeats(df).count() == 0 and sd.remove_repeats(df).count() == 0


def test_a_common_chunk_inside_a_passage_does_not_hide_it_from_its_first_holder(spark):
    rng, rows = random.Random(5), []
    for k in range(12):
        p = prose(rng, 52)
        start, end, words = sd.chunk_spans(p.encode())
        middle = len(start) // 2
        common = p.encode()[start[middle] - 40 : end[middle] + 40].decode("utf-8", "ignore")
        rows.append((k, prose(rng, 60) + " " + common + " " + prose(rng, 60)))
        rows += [(100 * i + k, prose(rng, 60) + " " + p + " " + prose(rng, 60)) for i in (1, 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in sd.repeats(df).collect()}
    assert {i for i in got if 100 <= i < 200} == {i - 100 for i in got if i >= 200} == set(range(100, 112))
    assert all(got[i].n_runs == 1 and got[i].n_words == got[i + 100].n_words for i in got if 100 <= i < 200)
    text = {r.doc_id: r.text for r in sd.remove_repeats(df).collect()}
    assert all(text[k] == dict(rows)[k] for k in range(12))  # the common chunk stays where it is first
    assert all(0 < len(dict(rows)[100 + k]) - len(text[100 + k]) < len(dict(rows)[200 + k]) - len(text[200 + k]) for k in range(12))
