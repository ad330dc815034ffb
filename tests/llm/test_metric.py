"""Largest inner products through M-trees against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkprint.llm import metric

SCHEMA = "embedding array<double>, vec_id long, id long, score long, label int"


def brute(rows, asked, k=5):
    use = [(i, np.floor(256 * np.array(v, dtype=float))) for v, i in rows
           if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    out = []
    for i, q in use:
        if asked(i):
            own = sorted((-int((q[: len(v)] * v[: len(q)]).sum()), j) for j, v in use if j != i)
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(own[:k])]
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame([(v, i, 9, 9, 9) for v, i in rows], SCHEMA)
    got = metric.nearest(df, F.col("vec_id") % 10 == 0, **more)
    return sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect())


def test_search_is_exact_over_many_small_trees_and_blocks(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((9, 12)) * 5
    vectors = centres[rng.integers(0, 9, 900)] + rng.standard_normal((900, 12)) * rng.choice([0.05, 2], (900, 1))
    vectors[300:620] = vectors[300]  # copies, a third of all rows
    vectors[700] *= 50  # a norm far beyond the others
    rows = [(v.tolist(), int(i)) for i, v in enumerate(vectors)]
    want = brute(rows, lambda i: i % 10 == 0)
    assert run(spark, rows, tree_rows=120, page=8, block=16) == want
    assert run(spark, rows) == want


def test_odd_rows(spark):
    rows = [([1.0, 2.0], 0), ([1.0, 2.0], 0), ([], 10), ([3.0], 3), ([1.0, float("nan")], 20), ([float("inf"), 1.0], 4),
            (None, 30), ([None, 1.0], 5), ([1.0, 1.0], None), ([-1.0, -2.0, 4.0], 6), ([0.0, 0.0], 7)]
    assert run(spark, rows) == brute(rows, lambda i: i % 10 == 0)
    assert run(spark, []) == []
    assert run(spark, [([1.0], 3)]) == []
    assert run(spark, [([1.0], 10)]) == []


def test_scores_beyond_doubles_are_exact_and_beyond_64_bits_refused(spark):
    rows = [([float(1 << 20), 1.0], 0), ([float(1 << 20), 2.0], 1), ([float(1 << 20), 3.0], 2)]
    want = [(0, 1, 2, (1 << 56) + 3 * 65536), (0, 2, 1, (1 << 56) + 2 * 65536)]
    assert run(spark, rows) == want
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [([1e30], 0), ([1e30], 1)])


def test_nodes_cover_their_rows_and_bounds_save_distances():
    rng = np.random.default_rng(5)
    centres = np.floor(rng.standard_normal((40, 16)) * 300)
    v = centres[rng.integers(0, 40, 4000)] + np.floor(rng.standard_normal((4000, 16)) * 5)
    pages = metric.grow(v, 64)

    def below(p):
        return p.children.tolist() if p.leaf else [r for c in p.children for r in below(pages[c])]

    assert sorted(below(pages[0])) == list(range(4000))
    for p in pages:
        assert len(p.children) <= 64
        if not p.leaf:
            for k, c in enumerate(p.children):
                rows = v[below(pages[c])]
                assert np.linalg.norm(rows - p.v[k], axis=1).max() <= p.radius[k] + 1e-6
                assert (rows ** 2).sum(axis=1).max() == p.norm[k]
                assert np.allclose(pages[c].apart, np.linalg.norm(pages[c].v - p.v[k], axis=1))
    q = v[:50]
    asked, rows, scores, computed = metric.search(pages, np.arange(4000), q, [set()] * 50, np.full(50, -np.inf), 3)
    assert computed < 0.2 * 50 * 4000
    for i in range(50):
        assert sorted(scores[asked == i]) == sorted(np.sort(v @ q[i])[-3:])
