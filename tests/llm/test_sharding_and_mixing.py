import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from tussis.llm import mixing, sharding

ROWS = [(i, "word " * (i % 17 + 1), f"s{i % 5}") for i in range(200)] + [(7, "same row", "s0")] * 150 + [(None, None, None), (None, "", None), (None, "no id", "s1"), (500, "long " * 9000, "s2")]
SCHEMA = "doc_id bigint, text string, source string"


def test_contiguous_shards_of_near_equal_bytes(spark, many_slices):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumnRenamed("source", "shard").repartition(7)
    got = sharding.assign_shards(df, 5).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in ROWS)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    key = [(r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size) for r in order]
    assert key == sorted(key)  # one contiguous stretch each
    total, start = sum(r.size for r in got), 0
    for r in order:
        assert r.shard == min(4, (2 * start + r.size) * 5 // (2 * total))
        start += r.size
    for s in {r.shard for r in got}:
        assert [r.slot for r in order if r.shard == s] == list(range(sum(r.shard == s for r in got)))


def test_shards_of_documents_are_balanced(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = sharding.assign_shards(docs).collect()
    size = Counter()
    for r in got:
        size[r.shard] += r.size
    assert max(abs(v - sum(size.values()) / 8) for v in size.values()) <= max(r.size for r in got)


def brute_targets(sizes, weights=(5, 2, 1)):
    """Share, stop at three times the size, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    return target


@pytest.mark.parametrize("shape", ["given", "small first", "many"])
def test_targets_and_takes(spark, many_slices, shape):
    rows = {"given": ROWS, "small first": [(i, "w " * (1 if i < 50 else 40), "a" if i < 50 else f"z{i % 2}") for i in range(400)], "many": [(i, "w " * (i % 9), f"é{i % 97}") for i in range(900)]}[shape]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("source", "s").withColumnRenamed("s", "source")
    got = mixing.mix_plan(df).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target = brute_targets(sizes)
    drawn = defaultdict(list)
    seen = Counter()
    for i, text, src in rows:
        seen[i, text or "", src] += 1
        digest = hashlib.md5((text or "").encode()).hexdigest()
        u = int(hashlib.md5(f"{mixing.SEED}:{'null' if i is None else i}:{digest}:{seen[i, text or '', src]}".encode()).hexdigest()[:13], 16) / 2**52
        rate = target[src] / sizes[src] if sizes[src] else 0
        drawn[i, src, len((text or "").split())].append(math.floor(rate) + (u < rate - math.floor(rate)))
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-6)
        drawn[r.doc_id, r.source, r.size].remove(r.copies)
        assert r.taken == r.copies * r.size <= 3 * r.size
    assert not any(drawn.values())
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_plan(df.repartition(5)).collect()))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    taken = Counter()
    for r in got:
        taken[r.doc_id, r.source, r.size] += r.copies
    assert Counter((r.doc_id, r.source, len((r.text or "").split())) for r in mixed.collect()) == +taken


def test_repeated_and_missing_ids_come_near_the_target(spark):
    rows = [(7, "four words in all", "a")] * 300 + [(None, f"text number {i} here", "b") for i in range(300)] + [(i, "six words " * 3, "c") for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix_plan(df).groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect()
    assert len(got) == 3 and all(abs(r.taken / r.target - 1) < 0.1 for r in got)
    extra = df.withColumn("__number", F.lit(1)).withColumn("digest", F.lit("x"))
    assert mixing.mix(extra).columns == extra.columns and abs(mixing.mix(extra).filter("source = 'a'").count() * 4 / next(r.target for r in got if r.source == "a") - 1) < 0.1


def test_taken_words_come_near_the_target(spark):
    rows = [(i, "w " * (i * 7919 % 200 + 1), f"s{i % 4}") for i in range(8000)]
    got = mixing.mix_plan(spark.createDataFrame(rows, SCHEMA)).groupBy("source", "target").sum("taken").collect()
    assert all(abs(r["sum(taken)"] / r.target - 1) < 0.05 for r in got)


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert sharding.assign_shards(df).count() == mixing.mix_plan(df).count() == mixing.mix(df).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], SCHEMA)
    assert [r.taken for r in mixing.mix_plan(blank).collect()] == [0, 0] and mixing.mix(blank).count() == 0
