import math
import random

import numpy as np
import pytest

from scorelane.llm.neighbours import (
    CONFIDENCE, DIMENSIONS, Tree, box_distance, cells_of, chi_square, chi_square_bound, kd_cuts, search,
)

ASKS = "vec_id % 20 = 0"


def brute(rows, k=20):
    """The nearest rows of each query, by all inner products."""
    held = [(i, np.array(v, dtype=float)) for i, v in rows
            if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    found = {}
    for n, (i, query) in enumerate(held):
        if i % 20 == 0:
            scores = [(-float((v * query).sum()), j) for m, (j, v) in enumerate(held) if m != n]
            found.setdefault(i, []).append(sorted(scores)[:k])
    return found


def answers(frame):
    found = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    return found


def test_chi_square():
    chance = np.random.default_rng(1)
    drawn = (chance.standard_normal((200_000, DIMENSIONS)) ** 2).sum(1)
    for p in (0.5, 0.9, 0.97):
        assert chi_square(chi_square_bound(p, DIMENSIONS), DIMENSIONS) == pytest.approx(p)
        assert (drawn < chi_square_bound(p, DIMENSIONS)).mean() == pytest.approx(p, abs=0.005)


def test_cells_and_boxes():
    points = np.random.default_rng(2).standard_normal((500, 3))
    cells = cells_of(kd_cuts(points, 8), points)
    assert np.bincount(cells).tolist() == pytest.approx([62.5] * 8, abs=1)
    assert cells_of(kd_cuts(np.zeros((50, 3)), 8), np.zeros((50, 3))).max() == 0
    tree = Tree(points, 16)
    assert sorted(np.concatenate(tree.leaves)) == list(range(500))
    inside = [box_distance(tree.low, tree.high, p).min() for p in points]
    assert max(inside) == 0


def test_recall_on_the_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    expected = brute([(r.vec_id, r.embedding) for r in frame.collect()])
    found = answers(search(frame, ASKS, cell_rows=300))
    assert found.keys() == expected.keys()
    hits = sum(len({i for *_, i in found[q]} & {i for _, i in expected[q][0]}) for q in expected)
    assert hits >= 0.95 * 20 * len(expected) and CONFIDENCE >= 0.95
    for q, rows in found.items():
        assert [r for r, *_ in rows] == list(range(1, 21))
        assert [(s, i) for _, s, i in rows] == sorted((s, i) for _, s, i in rows)


def test_clusters_of_unequal_lengths(spark):
    chance = np.random.default_rng(3)
    centres = chance.standard_normal((20, 16))
    vectors = [(centres[i % 20] + 0.2 * chance.standard_normal(16)) * chance.uniform(0.5, 2) for i in range(2000)]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    expected = brute(rows)
    found = answers(search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), ASKS, cell_rows=100))
    hits = sum(len({i for *_, i in found[q]} & {i for _, i in expected[q][0]}) for q in expected)
    assert hits >= 0.95 * 20 * len(expected)


def test_many_equal_vectors(spark):
    """Copies of one vector, also among the queries, with ties to the smaller id."""
    chance = random.Random(4)
    rows = [(i, [1.0, 2.0, 3.0, 0.5]) for i in range(400)]
    rows += [(i, [chance.gauss(0, 1) for _ in range(4)]) for i in range(400, 600)]
    chance.shuffle(rows)
    expected = brute(rows)
    found = answers(search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), ASKS, cell_rows=50))
    for q in range(0, 400, 20):
        assert [i for *_, i in found[q]] == [i for _, i in expected[q][0]]


def test_odd_vectors(spark):
    nan, inf = math.nan, math.inf
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (20, [0.5, 0.5]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]),
            (5, [None, 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (7, [-1.0, 0.25]), (40, None), (60, []), (8, [0.0, 2.0])]
    schema = "vec_id int, embedding array<float>, cell string, query string, point string"
    frame = spark.createDataFrame([(*r, "z", "z", "z") for r in rows], schema)
    found = search(frame, ASKS).collect()
    assert sorted((r.query_id, r.vec_id) for r in found) == sorted(
        [(0, i) for i in (20, 20, 7, 8)] + 2 * [(20, i) for i in (0, 20, 7, 8)]
    )
    assert [(r["rank"], r.vec_id, r.score) for r in found if r.query_id == 0] == [(1, 20, 0.5), (2, 20, 0.5), (3, 8, 0.0), (4, 7, -1.0)]
    assert search(frame.limit(0), ASKS).count() == 0
