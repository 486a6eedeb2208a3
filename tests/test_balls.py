"""Pruned search gives the rows of the plain one and leaves most block pairs of clustered rows out."""

import numpy as np
import pytest

from tussis.operators import balls, neighbors


def table(spark, n, seed, spread=0.05, dims=6, centres=20):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims)) * 3
    rows = [(i, int(i % 3), [float(v) for v in middle[rng.integers(centres)] + rng.normal(0, spread, dims)]) for i in range(n)]
    rows += [(n + i, 0, rows[0][2]) for i in range(12)]  # ties
    return spark.createDataFrame(rows, "id long, g int, x array<double>")


@pytest.mark.parametrize("by,same,block", [([], False, 50), (["g"], True, 40), ([], True, 5000)])
def test_same_rows_as_without_pruning(spark, by, same, block):
    q, c = table(spark, 150, 1), table(spark, 400, 1)
    options = {"query_id": "id", "corpus_id": "id", "vector": "x", "by": by, "exclude_same": same, "block_rows": block}
    near, visited = balls.nearest_in_balls(q, c, 4, pivots=24, **options)
    plain = neighbors.nearest_neighbors(q, c, 4, **options)
    assert sorted(map(tuple, near.select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    assert 0 < visited.first()["visited"] < 0.3


def test_far_apart_sides_and_more_neighbours_than_rows(spark):
    c = table(spark, 30, 3)
    q = spark.createDataFrame([(1, 0, [90.0] * 6), (2, 1, [-90.0] * 6)], c.schema)
    options = {"query_id": "id", "corpus_id": "id", "vector": "x"}
    for k in (3, 100):
        near, _ = balls.nearest_in_balls(q, c, k, pivots=8, **options)
        assert sorted(map(tuple, near.collect())) == sorted(map(tuple, neighbors.nearest_neighbors(q, c, k, **options).select(near.columns).collect()))
    assert balls.nearest_in_balls(q, c.limit(0), 3, **options)[0].collect() == []
    assert balls.nearest_in_balls(q.limit(0), c, 3, **options)[0].collect() == []


def test_pivots_are_far_apart():
    rows = np.array([[0.0], [0.1], [5.0], [5.1], [0.1]])
    assert sorted(balls.farthest_points(rows, 3)[:, 0]) in ([0.0, 0.1, 5.1], [0.0, 5.0, 5.1], [0.0, 0.1, 5.0])
    assert len(balls.farthest_points(rows, 10)) == 4 and len(balls.farthest_points(rows[:0], 3)) == 0


@pytest.mark.parametrize("search", ["plain", "balls"])
def test_copies_of_the_queries_do_not_grow_with_blocks_and_balls(spark, monkeypatch, search):
    """Rows on no cluster: every block and every ball meets all others, and yet few packed pairs travel."""
    rng = np.random.default_rng(4)
    made = [(i, [float(v) for v in row]) for i, row in enumerate(rng.normal(size=(1200, 8)))]
    df = spark.createDataFrame(made, "id long, x array<double>")
    x = np.array([v for _, v in made])
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(apart, np.inf)
    expected = {(i, int(j)) for i in range(1200) for j in np.argsort(apart[i])[:3]}
    seen = spark.sparkContext.accumulator(0)
    module, name = (neighbors, "block_match") if search == "plain" else (balls, "_bundle_match")
    plain = getattr(module, name, neighbors.block_match)

    def counted(*args):
        match = plain(*args)

        def run(batches):
            for batch in batches:
                seen.add(len(batch))
                yield from match([batch])

        return run

    monkeypatch.setattr(module if hasattr(module, name) else neighbors, name if hasattr(module, name) else "block_match", counted)
    options = {"query_id": "id", "corpus_id": "id", "vector": "x", "exclude_same": True, "block_rows": 30}
    near = neighbors.nearest_neighbors(df, df, 3, **options) if search == "plain" else balls.nearest_in_balls(df, df, 3, pivots=40, **options)[0]
    assert {(r.query_id, r.neighbor_id) for r in near.collect()} == expected
    assert 0 < seen.value <= 40 * 12
