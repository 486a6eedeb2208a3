"""The stages compared with brute force, each on its own input."""

from collections import Counter

import corpus_pipeline
from test_decontamination import brute as brute_leaks
from test_simhash import shingles, similar


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    columns = docs.columns
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(stage(spark, tables[-1], folder).cache())
    assert all(t.columns == columns for t in tables[:-1]) and 4 <= len(corpus_pipeline.STAGES) <= 5
    given, clean, single, free, mixed, placed = ([r.asDict() for r in t.collect()] for t in tables)

    ids = {r["doc_id"]: r for r in given}
    assert all(len(r["text"]) <= len(ids[r["doc_id"]]["text"]) and r["n_chars"] == len(r["text"]) for r in clean)

    order = sorted(clean, key=lambda r: r["doc_id"])
    sets = [shingles(r["text"]) for r in order]
    classes = list(range(len(order)))

    def find(x):
        while classes[x] != x:
            x = classes[x]
        return x

    for b in range(len(order)):
        for a in range(b):
            if similar(sets[a], sets[b]):
                p, q = find(a), find(b)
                classes[max(p, q)] = min(p, q)
    firsts = {order[find(i)]["doc_id"] for i in range(len(order))}
    stay = {r["doc_id"] for r in single}
    assert firsts <= stay and len(single) == len(stay) and len(stay - firsts) <= 0.1 * (len(order) - len(firsts)) < len(order) - len(stay)

    leaks = brute_leaks([(r["doc_id"], r["text"]) for r in single], items)
    assert len(free) == sum(x.endswith("False)") for x in leaks) < len(single)

    copies = Counter(r["doc_id"] for r in mixed)
    assert set(copies) <= {r["doc_id"] for r in free} and max(copies.values()) <= 3
    assert Counter(r["doc_id"] for r in placed) == copies and {r["shard"] for r in placed} == set(range(8))


def test_whole_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0
