"""Hard negatives by threshold joins against brute force."""

import numpy as np
from pyspark.sql import functions as F

from inkprint.llm import negatives

SCHEMA = "embedding array<double>, vec_id long, label int, key long, score long, rank int"


def brute(rows, k=5):
    use = [(i, c, np.floor(256 * np.array(v, dtype=float))) for v, i, c in rows
           if None not in (v, i, c) and None not in v and np.isfinite(v).all()]
    out = []
    for i, c, q in use:
        if i % 10:
            continue
        own = sorted((-int((q[: len(v)] * v[: len(q)]).sum()), j, d) for j, d, v in use if j != i)
        for p, j, d in [x for x in own if x[2] == c][:k]:
            window = [(s, n) for s, n, d in own if d != c and -80 * p <= -100 * s <= -100 * p][:k]
            out += [(i, j, r + 1, n, -p, -s) for r, (s, n) in enumerate(window)]
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame([(v, i, c, 9, 9, 9) for v, i, c in rows], SCHEMA)
    got = negatives.mine(df, F.col("label"), F.col("vec_id") % 10 == 0, **more)
    return sorted(tuple(r) for r in got.collect())


def test_windows_are_whole_over_many_blocks(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 20))
    vectors = centres[rng.integers(0, 6, 500)] + rng.standard_normal((500, 20)) * 0.3
    vectors[100:260] = vectors[100]  # one text copied, one label in half of the rows
    labels = rng.choice([0, 0, 0, 1, 2], 500)
    labels[490:] = 7  # few of a label: positives far away, some below zero
    rows = [(v.tolist(), int(i), int(c)) for i, (v, c) in enumerate(zip(vectors, labels))]
    want = brute(rows)
    assert len(want) > 500
    assert run(spark, rows, block_rows=90) == want


def test_odd_rows(spark):
    rows = [([1.0, 2.0], 0, 1), ([1.0, 2.0], 0, 1), ([1.0, 1.9], 1, 1), ([1.0, 1.9], 2, 2), ([1.0, 1.9], 3, 2), ([], 4, 2),
            ([2.0], 5, 1), ([0.5], 6, 3), ([float("nan")], 7, 2), (None, 8, 2), ([None], 9, 2), ([1.0], None, 2),
            ([1.0], 11, None), ([], 20, 2), ([-1.0, -2.0], 12, 2)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [([1.0], 10, 1)]) == []


def test_join_omits_dimensions_but_no_pair():
    rng = np.random.default_rng(6)
    v = np.floor(rng.standard_normal((700, 33)) * 100 * np.linspace(2, 0.1, 33))
    q = v[:60]
    for share in (0.9, 0.5, 0.1, -1):
        at = np.full(60, share * (v ** 2).sum(axis=1).max()) * rng.uniform(0.5, 1, 60)
        i, j, s = negatives.threshold_join(v, q, at)
        whole = q @ v.T
        x, y = np.nonzero(whole >= at[:, None])
        assert sorted(zip(i, j, s)) == sorted(zip(x, y, whole[x, y]))
    norms = negatives._suffix_norms(v, 8)
    longest = np.linalg.norm(q, axis=1).max()
    filed = negatives.postings(v, norms, longest, 0.5 * longest ** 2, 8)
    assert sum(map(len, filed)) < 0.6 * len(v) * len(filed)
