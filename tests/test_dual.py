"""Machines in the dual against projected gradients and against each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkprint.operators import dual
from inkprint.operators import models as M


def problem(spark, names=("p1", "p2"), docs=24, seed=3):
    """(values, features, known, unknown): two problems of two and three candidates."""
    rng = np.random.default_rng(seed)
    values = {(p, d, t): float(rng.random()) for p in ("p1", "p2") for d in range(docs) for t in range(8) if rng.random() < 0.6}
    features = spark.createDataFrame(
        [("f", p, f"d{d:02}", f"t{t}", v) for (p, d, t), v in values.items() if p in names],
        "family string, problem string, doc_name string, term string, value double")
    rows = [(p, f"d{d:02}", "abc"[d % (3 if p == "p1" else 2)], d < docs - 4) for p in names for d in range(docs)]
    frame = spark.createDataFrame(rows, "problem string, doc_name string, author string, known boolean")
    return values, features, frame.where("known").drop("known"), frame.where("NOT known").drop("known")


def dense(values, p, docs=24):
    return np.array([[values.get((p, d, t), 0.0) for t in range(8)] for d in range(docs)])


def slow(k, y, cost, loss, passes=400):
    """Values at all rows by plain coordinate steps in the dual."""
    n = len(y)
    weight = cost * np.where(y > 0, n / (2 * (y > 0).sum()), n / (2 * (y < 0).sum()))
    ridge = np.zeros(n) if loss == dual.HINGE else 1 / (2 * weight)
    upper = weight if loss == dual.HINGE else np.full(n, np.inf)
    alpha = np.zeros(n)
    for _ in range(passes):
        for i in range(n):
            slope = y[i] * (k[i, :n] @ (alpha * y)) - 1 + ridge[i] * alpha[i]
            alpha[i] = min(max(alpha[i] - slope / (k[i, i] + ridge[i]), 0.0), upper[i])
    return k[:, :n] @ (alpha * y)


def run(features, known, unknown, settings, **more):
    roles = M.plain_roles(known, unknown)
    return {(r.problem, r.setting, r.doc_name, r.author): r.margin
            for r in dual.margins(features, known, roles, settings, **more).collect()}


SETTINGS = [dual.Setting("h1", 1.0, dual.HINGE), dual.Setting("s1", 1.0), dual.Setting("h5", 5.0, dual.HINGE)]


@pytest.mark.parametrize("radial", [False, True])
def test_margins_are_those_of_the_minimum_and_problems_dont_touch(spark, radial):
    values, *both = problem(spark)
    found = run(*both, SETTINGS, radial=radial, gap=1e-9)
    assert len(found) == 4 * (3 + 2) * len(SETTINGS)
    for p, authors in (("p1", "abc"), ("p2", "ab")):
        x = dense(values, p)
        used = (x[:20] > 0).any(axis=0).sum()
        k = x @ x.T + 1
        if radial:
            k = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / used) + 1
        for a, author in enumerate(authors):
            y = np.where(np.arange(20) % len(authors) == a, 1.0, -1.0)
            for s in SETTINGS:
                want = slow(k, y, s.cost, s.loss)
                for d in range(20, 24):
                    assert found[p, s.name, f"d{d}", author] == pytest.approx(want[d], abs=1e-3)
    _, *one = problem(spark, ["p1"])
    alone = run(*one, SETTINGS, radial=radial, gap=1e-9)
    assert alone == {k: v for k, v in found.items() if k[0] == "p1"}


def test_groups_reach_the_same_margins_in_rounds(spark, monkeypatch):
    _, *both = problem(spark)
    together = run(*both, SETTINGS[:2], gap=1e-6)
    monkeypatch.setattr(dual, "GROUP_ROWS", 12)
    monkeypatch.setattr(dual, "PIECE_ROWS", 3)
    rounds = run(*both, SETTINGS[:2], gap=1e-3)
    assert together.keys() == rounds.keys()
    assert max(abs(together[k] - rounds[k]) for k in together) < 0.1


def test_gap_is_closed_and_conditions_hold():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((80, 5))
    k = x @ x.T + 1
    y = np.sign(x[:, 0] + 0.5 * rng.standard_normal(80))[:, None]
    upper, ridge = np.full((80, 1), 2.0), np.zeros((80, 1))
    upper[:10] = 0  # rows that aren't learned from
    alpha, f = dual.solve_group(k, y, upper, ridge, 1e-4)
    lack, primal = dual.gaps(y, upper, ridge, alpha, f)
    assert 0 <= lack[0] <= 1e-4 * primal[0] and (alpha[:10] == 0).all() and (alpha <= upper + 1e-12).all()
    assert np.allclose(f, k @ (alpha * y))


def test_sparse_products_are_dense_ones(monkeypatch):
    rng = np.random.default_rng(2)
    sides = []
    for n in (13, 7):
        x = rng.standard_normal((n, 40)) * (rng.random((n, 40)) < rng.choice([0.05, 0.9], 40))
        x[2] = 0
        rows, terms = np.nonzero(x)
        sides.append((x, (np.bincount(rows, minlength=n), terms * 1_000_003, x[rows, terms])))
    (a, left), (b, right) = sides
    for strip, pairs in ((1 << 22, 1 << 22), (30, 5)):
        monkeypatch.setattr(dual, "STRIP", strip)
        monkeypatch.setattr(dual, "PAIRS", pairs)
        assert np.allclose(dual.inner(left, right), a @ b.T)
    assert np.allclose(dual.kernel(left, right, 0.3), np.exp(-0.3 * ((a[:, None] - b[None]) ** 2).sum(axis=2)) + 1)


def test_passes_and_wide_vocabularies_agree_with_the_dual(spark, monkeypatch):
    _, *both = problem(spark)
    want = {(r.problem, r.doc_name, r.author): r.margin for r in M.svm_ovr(*both).collect()}
    monkeypatch.setattr(M, "IN_PLACE_DOCS", 0)
    passes = {(r.problem, r.doc_name, r.author): r.margin for r in M.svm_ovr(*both).collect()}
    monkeypatch.setattr(M.svm, "MAX_TERMS", 3)  # too wide for passes: solved in the dual
    wide = {(r.problem, r.doc_name, r.author): r.margin for r in M.svm_ovr(*both).collect()}
    assert want.keys() == passes.keys() == wide.keys()
    assert all(abs(want[k] - passes[k]) < 1e-6 and abs(want[k] - wide[k]) < 1e-6 for k in want)


def test_documents_without_terms_have_the_bias(spark):
    _, features, known, unknown = problem(spark)
    none = features.where((F.col("doc_name") != "d23") & (F.col("doc_name") != "d01"))
    found = run(none, known, unknown, SETTINGS[:1])
    assert {k[2] for k in found} == {"d20", "d21", "d22", "d23"}


def test_large_sigmoid_groups_take_the_same_steps(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(a, f"d{k}", m, float(m + rng.normal() > 0)) for a in "ab" for k, m in enumerate(rng.normal(size=30).tolist())]
    margins = spark.createDataFrame(rows, "author string, doc_name string, margin double, hit double").selectExpr(
        "'f' AS family", "'p' AS problem", "author", "0 AS split", "'calibrate' AS role", "doc_name", "margin", "hit")
    few = {r.author: (r.slope, r.offset) for r in M.platt_scale(margins).collect()}
    monkeypatch.setattr(M, "IN_PLACE_MARGINS", 10)
    many = {r.author: (r.slope, r.offset) for r in M.platt_scale(margins).collect()}
    assert few.keys() == many.keys()
    assert all(np.allclose(few[a], many[a], atol=1e-6) for a in few)


def test_few_passes_reach_the_dual_on_alike_documents(spark, monkeypatch):
    """Terms that stand in every document curve the loss unevenly: the passes stay few, the minimum is the same."""
    rng = np.random.default_rng(5)
    terms, base = [f"t{i:02}" for i in range(30)], rng.random(30)
    known = [("p", f"k{i:03}", f"a{i % 3}") for i in range(240)]
    unknown = [("p", f"u{i:03}") for i in range(10)]
    rows = []
    for i, (_, doc, *_) in enumerate([*known, *unknown]):
        value = base * (1 + 0.05 * rng.standard_normal(30)) + 0.02 * (np.arange(30) % 3 == i % 3)
        rows += [("f", "p", doc, t, float(v)) for t, v in zip(terms, value / np.linalg.norm(value))]
    features = spark.createDataFrame(rows, "family string, problem string, doc_name string, term string, value double")
    docs = (spark.createDataFrame(known, "problem string, doc_name string, author string"),
            spark.createDataFrame(unknown, "problem string, doc_name string"))
    roles = M.calibration_roles(*docs)
    key = lambda r: (r.doc_name, r.split, r.role, r.author)
    read = lambda: {key(r): (r.margin, r.hit) for r in M.svm_margins(features, docs[0], roles, c=10.0).collect()}
    want = read()
    monkeypatch.setattr(M, "IN_PLACE_DOCS", 0)
    monkeypatch.setattr(M.svm, "LOCAL_CELLS", 0)
    passes, evaluate = [], M.svm._evaluate
    monkeypatch.setattr(M.svm, "_evaluate", lambda *a: passes.append(1) or evaluate(*a))
    counts = []
    for task_vectors, sparse in ((32, 16), (2, 16), (32, 0)):  # all eigenvalues, the largest, cell by cell
        monkeypatch.setattr(M.svm, "SKETCH_TASK", task_vectors)
        monkeypatch.setattr(M.svm, "SPARSE", sparse)
        passes.clear()
        got = read()
        counts.append(len(passes))
        assert got.keys() == want.keys()
        assert all(got[k] == (pytest.approx(want[k][0], abs=1e-5), want[k][1]) for k in want)
    assert max(counts) <= 20


def test_eigenvalues_from_all_and_from_few_products():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((50, 12)) * np.array([30.0, 9, 3] + [1e-3] * 9)
    matrix = x.T @ x
    for rank in (12, 6):
        ways = np.eye(12) if rank == 12 else rng.standard_normal((rank, 12))
        vectors, values = M.svm.eigen(ways @ matrix, ways)
        assert np.allclose(np.sort(values)[::-1][:3], np.linalg.eigvalsh(matrix)[::-1][:3], rtol=1e-4)
        assert np.allclose(vectors.T @ vectors, np.eye(vectors.shape[1]), atol=1e-8)


@pytest.mark.parametrize("local_cells", [0, 2_000_000])
def test_passes_close_the_gap_of_every_cost_and_loss(spark, monkeypatch, local_cells):
    """Hinge and squared hinge by passes: the margins of the dual."""
    _, *both = problem(spark)
    roles = M.plain_roles(*both[1:])
    key = lambda r: (r.problem, r.setting, r.doc_name, r.author)
    want = {key(r): r.margin for r in dual.margins(*both[:2], roles, SETTINGS, gap=1e-8).collect()}
    monkeypatch.setattr(M, "IN_PLACE_DOCS", 0)
    monkeypatch.setattr(M.svm, "LOCAL_CELLS", local_cells)
    monkeypatch.setattr(dual, "solve", lambda groups, *a: groups.sparkSession.createDataFrame([], dual.SOLVED))
    got = {key(r): r.margin for r in M.linear_margins(*both[:2], roles, SETTINGS, 500, 1e-8, 1e-4).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 0.05 for k in want)
