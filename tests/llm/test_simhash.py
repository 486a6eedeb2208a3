import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tussis.llm import simhash


def brute_classes(fps):
    """Smallest position reachable for every fingerprint, by comparing all."""
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 3:
                p, q = find(i), find(j)
                label[max(p, q)] = min(p, q)
    return [find(i) for i in range(len(fps))]


def brute_print(text):
    words = [w for w in _split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _split(text):
    word = ""
    for c in text + " ":
        if c in " \t\n\v\f\r":
            if word:
                yield word
            word = ""
        else:
            word += c


def clustered(n, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)]
    out = [0, 1, (1 << 64) - 1, 1 << 63]
    while len(out) < n:
        x = rng.choice(centres)
        for _ in range(rng.choice((0, 1, 2, 3, 5, 8))):
            x ^= 1 << rng.randrange(64)
        out.append(x if rng.random() < 0.8 else rng.getrandbits(64))
    return out


def test_classes_equal_brute_force(spark):
    fps = clustered(900, 1)
    brute = brute_classes(fps)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    want = {}
    for f, c in zip(signed, brute):
        want.setdefault(c, set()).add(f)
    want = {frozenset(v) for v in want.values() if len(v) > 1}
    df = spark.createDataFrame([(f,) for f in set(signed)], "fp bigint")
    for block in (simhash.BLOCK, 50):
        got = {}
        for node, root in simhash.components(simhash.links(df, block)).collect():
            got.setdefault(root, {root}).add(node)
        assert {frozenset(v) for v in got.values()} == want


def test_masks_cover_three_differences():
    rng = random.Random(2)
    for n in (10, 1 << 30, 1 << 40):
        masks = simhash.masks_for(n)
        for _ in range(300):
            d = 0
            for _ in range(3):
                d |= 1 << rng.randrange(64)
            assert any(d & m == 0 for m in masks)


def test_gray_rank_inverts_the_gray_code():
    i = np.arange(1000, dtype=np.uint64)
    assert (simhash.gray_rank(i ^ (i >> np.uint64(1))) == i).all()


ROWS = [
    (5, "The quick brown fox jumps", "x"), (3, "the QUICK brown fox jumps", "y"), (3, "the QUICK brown fox jumps", "y"),
    (9, None, "z"), (8, "", None), (7, " \n\t ", "q"), (None, "nobody knows this one at all", "n"),
    (None, "the quick brown fox jumps", "n"), (1, "É é à wide space", "u"), (2, "one", "s"), (4, "One two", "s"),
]


def test_rows_nulls_and_repeats(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, fp string").withColumnRenamed("fp", "component_id")
    got = simhash.near_duplicates(df)
    assert got.count() == len(ROWS)
    prints = {(r.doc_id, r.fp & (1 << 64) - 1) for r in got.collect()}
    assert prints == {(i, brute_print(t)) for i, t, _ in ROWS}
    by_id = {r.doc_id: r.component_id for r in got.collect() if r.doc_id}
    assert by_id[5] == by_id[3] == 3 and by_id[7] == by_id[8] == by_id[9] == 7 and by_id[1] == 1


def test_one_of_each_class_stays(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, root string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id or 0), r.text) for r in kept.collect() if r.text) == sorted(
        [(3, "the QUICK brown fox jumps"), (7, " \n\t "), (0, "nobody knows this one at all"), (1, ROWS[8][1]), (2, "one"), (4, "One two")])
    assert kept.count() == 6


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_duplicates(df).count() == 0 and simhash.keep_one(df).count() == 0


def test_dense_group_is_one_class(spark):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    fps = {centre} | {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(3000)}
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp bigint")
    edges = simhash.links(df)
    assert edges.count() <= 4 * len(fps)
    assert simhash.components(edges).select("root").distinct().count() == 1


def shingles(text):
    words = list(_split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return not a and not b or len(a & b) >= 0.8 * len(a | b)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_copies_are_found_without_the_fingerprint_rule(spark):
    rng = random.Random(11)
    texts, pairs = [], []
    for _ in range(150):
        words = [f"v{rng.randrange(4000)}" for _ in range(rng.randint(40, 400))]
        texts += [" ".join(words), edited(rng, words, rng.randint(1, max(1, len(words) // 45)))]
        pairs.append((len(texts) - 2, len(texts) - 1))
    sets = [shingles(t) for t in texts]
    close = [(a, b) for a, b in pairs if similar(sets[a], sets[b])]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.first_id: r.root for r in simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[a] == got[b] for a, b in close)
    assert len(close) > 60 and found >= 0.95 * len(close)
    assert all(got[a] != got[b] for a, b in pairs if not similar(sets[a], sets[b]))


def test_recall_on_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: shingles(r.text) for r in docs.collect()}
    got = {}
    keys = {r.doc_id: r.k for r in docs.select("doc_id", simhash._text_key(docs["text"]).alias("k")).collect()}
    root = {r.text_key: r.root for r in simhash.similar_texts(docs).collect()}
    got = {i: root[k] for i, k in keys.items()}
    owners = {}
    for i, s in rows.items():
        for x in s:
            owners.setdefault(x, []).append(i)
    met = {(a, b) for ids in owners.values() if len(ids) < 60 for a in ids for b in ids if a < b}
    close = [(a, b) for a, b in met if keys[a] != keys[b] and similar(rows[a], rows[b])]
    assert sum(got[a] == got[b] for a, b in close) >= 0.9 * len(close)
    parent = {i: i for i in rows}  # no class holds texts without a chain of similar ones

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in [*close, *((a, b) for a in rows for b in rows if a < b and (keys[a] == keys[b] or not rows[a] and not rows[b]))]:
        parent[find(b)] = find(a)
    assert all(find(a) == find(b) for a in rows for b in rows if got[a] == got[b])


def test_keep_similar_defined_cases(spark):
    words = " ".join(f"w{i}" for i in range(100))
    rows = [(5, words, 1), (3, words + " end", 2), (4, "Short text", 3), (9, "short TEXT", 4), (None, words, 5), (7, None, 6), (8, "", 7), (6, " ", 8), (4, "Short text", 3), (None, "alone in its class", 9), (3, "another text of the same id", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __kept_key int").withColumn("root", F.lit("x"))
    got = simhash.keep_similar(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, "alone in its class"), (3, "another text of the same id"), (3, words + " end"), (4, "Short text"), (6, " ")]
    assert simhash.keep_similar(df.limit(0)).collect() == []


def test_members_unlike_their_leader_meet_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "sample_prints", lambda hashes, tables=8, sample=4: np.full(tables, 7, np.uint64))
    bases = [[f"b{k}x{i}" for i in range(60)] for k in range(4)]
    rows = [(10 * k + j, " ".join(b + [f"t{j}"])) for k, b in enumerate(bases) for j in range(5)]
    got = {r.first_id: r.root for r in simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all((got[a] == got[b]) == (a // 10 == b // 10) for a in got for b in got)


def brute_roots(texts):
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for b in range(len(texts)):
        for a in range(b):
            if similar(sets[a], sets[b]):
                p, q = find(a), find(b)
                label[max(p, q)] = min(p, q)
    return [find(i) for i in range(len(texts))]


def found_roots(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = {}
    rows = simhash.similar_texts(df, **more).select("first_id", "root").collect()
    for r in rows:
        names[r.root] = min(names.get(r.root, r.first_id), r.first_id)
    got = {r.first_id: names[r.root] for r in rows}
    return [got[i] for i in range(len(texts))]


def chained(rng):
    """Sets of one size, each 0.8 or a little more like the next only, around a passage that others share in part."""
    words = [f"c{rng.randrange(10**9)}" for _ in range(104)]
    texts = []
    for step in range(6):
        texts.append(" ".join(words))
        k = 5 + 22 * step % 90
        words[k : k + 6] = [f"d{rng.randrange(10**9)}" for _ in range(6)]
    return texts


def odd_texts(seed):
    rng = random.Random(seed)
    texts = ["", " ", "\n \t", "one", "ONE ", "one two", "a a a a a a a a a a", "a a a a a a a"]
    shared = [f"s{i}" for i in range(80)]
    for _ in range(60):
        words = [f"v{rng.randrange(10**6)}" for _ in range(rng.randint(6, 160))]
        texts += [" ".join(words), edited(rng, words, 1), edited(rng, words, 2), " ".join(words[: int(len(words) * 0.84)])]
        texts.append(" ".join(shared[: rng.randint(60, 80)] + words[: rng.randint(0, 40)]))
        texts += chained(rng)
    return sorted(set(texts))


def test_no_similar_pair_is_left_out(spark):
    texts = odd_texts(21)
    assert found_roots(spark, texts) == brute_roots(texts)


def test_long_lists_and_large_cells_are_dealt(spark):
    texts = odd_texts(22)
    want = brute_roots(texts)
    assert found_roots(spark, texts, block=7) == want


def test_chains_are_followed_when_all_share_one_leader(spark, monkeypatch):
    monkeypatch.setattr(simhash, "sample_prints", lambda hashes, tables=8, sample=4: np.full(tables, 7, np.uint64))
    texts = [t for k in range(12) for t in chained(random.Random(k))]
    assert found_roots(spark, texts) == brute_roots(texts) and len(set(brute_roots(texts))) == 12


def test_all_similar_given_documents_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = sorted({r.text or "" for r in docs.collect()})
    assert found_roots(spark, texts) == brute_roots(texts)
