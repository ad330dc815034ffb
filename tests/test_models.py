import random
import threading
from hashlib import md5

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from inkprint.operators import boost as B
from inkprint.operators import decide as D
from inkprint.operators import imposters as I
from inkprint.operators import models as M
from inkprint.operators import vectorize as V
from inkprint.queries import corpus as C

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def languages(spark):
    """A separable problem: the author is the language of the text."""
    d = C.docs(spark, SF).withColumn("author", F.col("language")).withColumn("problem", F.lit("p"))
    known, unknown = d.where("split = 'known'"), C.unknown(d)
    features = V.fit_tfidf(known, V.chars(2, 2), 0.12).transform(d).withColumn("family", F.lit("c2"))
    return M.materialize(features), known, unknown


def sums_to_one(scores, *keys):
    totals = scores.groupBy(*keys).agg(F.sum("p").alias("s"))
    assert totals.where(F.abs(F.col("s") - 1) > 1e-6).count() == 0


def accuracy(scores, unknown):
    best = D.argmax_label(scores).join(unknown.select(*V.DOC, "author"), V.DOC)
    return best.agg(F.avg(F.when(F.col("predicted_author") == F.col("author"), 1.0).otherwise(0.0))).first()[0]


def test_calibrated_svm(spark, languages):
    features, known, unknown = languages
    scores = M.materialize(M.multi_fit_predict(features, known, unknown).drop("model"))
    sums_to_one(scores, *V.DOC)
    assert scores.select(*V.DOC).distinct().count() == unknown.count()
    assert accuracy(scores, unknown) > 0.9


def by_key(margins):
    return {(r.problem, r.doc_name, r.author): r.margin for r in margins.collect()}


def small_problems(spark, names):
    rng = np.random.default_rng(3)
    values = {(p, d, t): float(rng.random()) for p in ("p1", "p2") for d in range(14) for t in range(6) if rng.random() < 0.7}
    features = spark.createDataFrame(
        [("f", p, f"d{d}", f"t{t}", v) for (p, d, t), v in values.items() if p in names],
        "family string, problem string, doc_name string, term string, value double")
    docs = [(p, f"d{d}", "abc"[d % (3 if p == "p1" else 2)], d < 10) for p in names for d in range(14)]
    frame = spark.createDataFrame(docs, "problem string, doc_name string, author string, known boolean")
    return values, features, frame.where("known").drop("known"), frame.where("NOT known").drop("known")


def test_svm_solves_its_problem_alone(spark, monkeypatch):
    """Margins are those of the minimum, with or without other problems, packed or apart."""
    values, *one = small_problems(spark, ["p1"])
    alone = by_key(M.svm_ovr(*one))
    assert len(alone) == 4 * 3
    x = np.array([[1.0] + [values.get(("p1", d, t), 0.0) for t in range(6)] for d in range(14)])
    for k, author in enumerate("abc"):
        y = np.where(np.arange(10) % 3 == k, 1.0, -1.0)
        weight = np.where(y > 0, 10 / (2 * (y > 0).sum()), 10 / (2 * (y < 0).sum()))
        w = np.zeros(7)
        for _ in range(30_000):
            pull = weight * y * np.maximum(0, 1 - y * (x[:10] @ w))
            w -= 0.005 * (w - 2 * x[:10].T @ pull)
        for d in range(10, 14):
            assert abs(alone["p1", f"d{d}", author] - x[d] @ w) < 1e-5
    _, *two = small_problems(spark, ["p1", "p2"])
    both = by_key(M.svm_ovr(*two))
    monkeypatch.setattr(M.svm, "MAX_COEFFICIENTS", 28)
    monkeypatch.setattr(M.svm, "CHUNK", 4)
    monkeypatch.setattr(M.svm, "PIECE", 20)
    monkeypatch.setattr(M.svm, "LOCAL_TASKS", 2)
    apart = by_key(M.svm_ovr(*two))
    monkeypatch.setattr(M.svm, "LOCAL_CELLS", 0)
    spread = by_key(M.svm_ovr(*two))
    assert both.keys() == apart.keys() == spread.keys() and alone.keys() < both.keys()
    assert all(abs(alone[k] - both[k]) < 1e-6 for k in alone)
    assert all(abs(apart[k] - both[k]) < 1e-6 and abs(spread[k] - both[k]) < 1e-6 for k in both)


def test_many_problems_keep_within_the_bound():
    tasks = [{"split": s, "slot": a, "n_hit": 2, "n_all": 6} for s in range(3) for a in range(3)]
    found = [{"family": "f", "problem": str(k), "size": 20_000, "tasks": tasks} for k in range(200)]
    packs = list(M.fit_groups(found))
    assert max(sum(b.size * len(b.split) for b in p) for p in packs) <= M.svm.MAX_COEFFICIENTS
    solved = [(b.number, s, a) for p in packs for b in p for s, a in zip(b.split, b.slot)]
    assert len(solved) == len(set(solved)) == 1800
    with pytest.raises(ValueError):
        list(M.fit_groups([{"family": "f", "problem": "p", "size": M.svm.MAX_TERMS + 1, "tasks": tasks}]))


def test_sigmoids_reach_the_minimum(spark):
    rng = np.random.default_rng(5)
    rows = [(a, f"d{k}", m, float(m + rng.normal() * (a == "a") > 0)) for a in "ab" for k, m in enumerate(rng.normal(size=30).tolist())]
    margins = spark.createDataFrame(rows, "author string, doc_name string, margin double, hit double").selectExpr(
        "'f' AS family", "'p' AS problem", "author", "0 AS split", "'calibrate' AS role", "doc_name", "margin", "hit")
    fitted = {r.author: (r.slope, r.offset) for r in M.platt_scale(margins).collect()}
    for author, (slope, offset) in fitted.items():
        m, hit = (np.array([r[k] for r in rows if r[0] == author]) for k in (2, 3))
        target = np.where(hit > 0, (hit.sum() + 1) / (hit.sum() + 2), 1 / (len(hit) - hit.sum() + 2))
        error = 1 / (1 + np.exp(-(slope * m + offset))) - target
        assert abs(error.sum()) < 1e-6 and abs((error * m).sum()) < 1e-6


def test_roles(spark, languages):
    _, known, unknown = languages
    roles = M.calibration_roles(known, unknown)
    per_doc = roles.groupBy("doc_name").agg(
        F.count_if(F.col("role") == "calibrate").alias("c"), F.count_if(F.col("role") == "test").alias("t"))
    assert {(r["c"], r["t"]) for r in per_doc.collect()} == {(1, 0), (0, 3)}
    oof = M.oof_roles(known, 3, 2).groupBy("doc_name").agg(F.count_if(F.col("role") == "test").alias("t"))
    assert {r["t"] for r in oof.collect()} == {2}


def test_dense_classifiers(spark, languages):
    features, known, unknown = languages
    vectors, size = M.term_vectors(features, known)
    vectors = M.materialize(vectors)
    for name, estimator in (("forest", M.random_forest(20, 4)), ("mlp", M.mlp(size, 4, 20, 50))):
        scores = M.fit_predict(estimator, vectors, known, unknown, name).drop("model")
        sums_to_one(scores, *V.DOC)
        assert accuracy(scores, unknown) > 0.8


def brute_imposters(spark, d, s):
    """The rule written out, document by document."""
    fitted = V.fit_top_k(C.known(d), s.ngram_size, s.vocab_size)
    vocab, drawn = {}, {}
    for r in fitted.table.collect():
        vocab.setdefault(r["problem"], []).append(r["term"])

    def first(it, names, n):
        order = sorted(names, key=lambda x: (md5(f"{s.seed}|{it}|{x}".encode()).hexdigest(), x))
        return order[:n]

    def vectors(docs):
        out = {(r["problem"], r["doc_name"]): {} for r in docs.collect()}
        for r in fitted.transform(docs).collect():
            out[r["problem"], r["doc_name"]][r["term"]] = r["value"]
        return out

    known, unknown, others = (vectors(x) for x in (C.known(d), C.unknown(d), C.imposters(d)))
    authors = {}
    for r in C.known(d).collect():
        authors.setdefault((r["problem"], r["author"]), []).append(known[r["problem"], r["doc_name"]])

    def distance(a, b, used):
        low = sum(min(a.get(t, 0), b.get(t, 0)) for t in used)
        both = sum(a.get(t, 0) + b.get(t, 0) for t in used)
        return round(1 - low / (both - low + 1e-6), 9)

    scores = {}
    for (problem, name), doc in unknown.items():
        names = [n for p, n in others if p == problem]
        for it in range(s.iterations) if names else ():
            if (problem, it) not in drawn:
                terms = vocab[problem]
                drawn[problem, it] = (set(first(it, terms, int(len(terms) * s.keep))), first(it, names, s.imposters))
            used, texts = drawn[problem, it]
            least = min(distance(doc, others[problem, n], used) for n in texts)
            for (p, author), own in authors.items():
                if p == problem:
                    center = {t: sum(v.get(t, 0) for v in own) / len(own) for t in used}
                    hit = distance(doc, center, used) <= least
                    key = problem, name, author
                    scores[key] = scores.get(key, 0) + hit / s.iterations
    return scores


def test_imposters_against_brute_force(spark, monkeypatch):
    """Many small groups; one document has no known term, one problem no imposter, one text is empty."""
    for name, size in (("GROUP_DOCS", 2), ("GROUP_ITERATIONS", 2), ("GROUP_AUTHORS", 2)):
        monkeypatch.setattr(I, name, size)
    pick = random.Random(5)

    def text(words):
        return " ".join(pick.choice(words) for _ in range(30))

    words = {"a": ["alpha", "alps", "beta"], "b": ["beta", "gamma", "gamut"], "c": ["delta", "alpha", "dell"]}
    rows = []
    for problem in ("p", "q", "r"):
        for author in words:
            rows += [(problem, f"k{author}{k}", author, text(words[author]), "known", author) for k in range(3)]
            rows += [(problem, f"u{author}{k}", author, text(words[author]), "unknown", author) for k in range(2)]
        if problem != "r":
            rows += [(problem, f"i{k}", "x", text(sum(words.values(), [])), "known", C.UNKNOWN) for k in range(6)]
    rows += [("p", "none", "a", "zzzzzz", "unknown", "a"), ("q", "void", "a", "", "unknown", "a")]
    d = spark.createDataFrame(
        rows, "problem string, doc_name string, author string, text string, split string, true_author string")
    settings = I.ImpostersSettings(iterations=5, imposters=4, vocab_size=40)
    found = {(r["problem"], r["doc_name"], r["author"]): r["p"]
             for r in I.imposters_score(C.known(d), C.unknown(d), C.imposters(d), settings).collect()}
    assert found == pytest.approx(brute_imposters(spark, d, settings))
    assert len(found) == 2 * 7 * 3 and 0 < sum(found.values()) < len(found)


def test_stacking_keeps_problems_apart(spark):
    scores = [(p, f"d{k}", m, a, (k * 7 + len(a) * 3 + len(m)) % 10 / 10 + 0.05 * (a == "ab"[k % 2]))
              for p in ("p1", "p2") for k in range(12) for m in ("m1", "model2") for a in ("a", "b", "cc")[: 2 + (p == "p2")]]
    frame = spark.createDataFrame(scores, "problem string, doc_name string, model string, author string, p double")
    known = spark.createDataFrame(
        [(p, f"d{k}", "ab"[k % 2] if p == "p1" or k % 3 else "cc") for p in ("p1", "p2") for k in range(12)],
        "problem string, doc_name string, author string")

    def result(*problems):
        mine = F.col("problem").isin(*problems)
        rows = M.stacking(frame.where(mine), frame.where(mine), known.where(mine)).where("problem = 'p1'").collect()
        return {(r.doc_name, r.author): r.p for r in rows}

    alone, both = result("p1"), result("p1", "p2")
    assert len(alone) == 24 and alone.keys() == both.keys()
    assert all(abs(alone[k] - both[k]) < 1e-6 for k in alone)


def test_stacking_in_tasks_and_by_passes_agree(spark, monkeypatch):
    rng = np.random.default_rng(8)
    scores = [("p", f"d{k:02}", m, a, float(rng.random() + 0.3 * (a == "abc"[k % 3])))
              for k in range(40) for m in ("m1", "m2") for a in "abc"]
    frame = spark.createDataFrame(scores, "problem string, doc_name string, model string, author string, p double")
    known = spark.createDataFrame([("p", f"d{k:02}", "abc"[k % 3]) for k in range(40)], "problem string, doc_name string, author string")
    tasks = {(r.doc_name, r.author): r.p for r in M.stacking(frame, frame, known).collect()}
    monkeypatch.setattr(M, "STACK_CELLS", 0)
    passes = {(r.doc_name, r.author): r.p for r in M.stacking(frame, frame, known).collect()}
    assert len(tasks) == 120 and tasks.keys() == passes.keys()
    assert max(abs(tasks[k] - passes[k]) for k in tasks) < 1e-4


def test_dense_classifiers_refuse_two_problems(spark):
    known = spark.createDataFrame([("p1", "d", "a"), ("p2", "d", "a")], "problem string, doc_name string, author string")
    with pytest.raises(ValueError):
        M.fit_predict(M.random_forest(trees=2), known, known, known, "forest")


def test_cost_grid(spark):
    _, features, known, _ = small_problems(spark, ["p1"])
    rows = M.param_grid(features, known, (0.5,), 2).collect()
    assert [(r.problem, r.family, r.cost, r.best) for r in rows] == [("p1", "f", 0.5, True)]
    assert 0 <= rows[0].f1 <= 1


def test_boosted_classes_are_fitted_side_by_side(spark, languages):
    features, known, unknown = languages
    vectors = M.materialize(M.term_vectors(features, known)[0])
    both = M.boosted(rounds=1)
    assert both.getParallelism() >= 4
    scores = [{(r.doc_name, r.author): r.p for r in M.fit_predict(e, vectors, known, unknown, "b").collect()}
              for e in (both, both.copy({both.parallelism: 1}))]
    assert scores[0] == scores[1]


def test_boosted_in_tasks_gives_the_trees_of_the_library(spark, monkeypatch):
    """Few values per feature, so that both look at the same thresholds; documents may come twice."""
    rng = np.random.default_rng(11)
    x = rng.integers(0, 6, size=(1500, 70)) / 5
    label = (x[:, 0] + x[:, 66] > 1).astype(int) + (rng.random(1500) < 0.4)
    vectors = spark.createDataFrame(
        [("p", f"d{k:04}", Vectors.dense(row)) for k, row in enumerate(x.tolist())], ["problem", "doc_name", "features"])
    known = spark.createDataFrame(
        [("p", f"d{k:04}", "abc"[n]) for k, n in enumerate(label)] + [("p", "d0007", "a")], "problem string, doc_name string, author string")
    unknown = known.where("doc_name >= 'd1400'")

    def scores():
        rows = M.fit_predict(M.boosted(rounds=4), vectors, known, unknown, "b").collect()
        return {(r.doc_name, r.author): r.p for r in rows}

    tasks = scores()
    assert isinstance(M.boosted(1).fit(vectors.withColumn("label", F.lit(0.0))), B.BoostedModel)
    monkeypatch.setattr(B, "IN_PLACE_CELLS", 0)
    library = scores()
    assert len(tasks) == 300 and tasks.keys() == library.keys()
    assert max(abs(tasks[k] - library[k]) for k in tasks) < 1e-9


def test_thresholds_cut_equal_shares():
    values = np.random.default_rng(2).random(3200)
    cuts = B.cuts_of(values)
    assert len(cuts) == 31 and set(np.bincount(np.searchsorted(cuts, values))) == {100}
    assert B.cuts_of(np.array([1.0, 3.0, 3.0, 4.0])).tolist() == [2.0, 3.5] and not len(B.cuts_of(np.ones(5)))


def together(monkeypatch, *places):
    """Each of two functions begins when the other has been called."""
    barrier = threading.Barrier(2, timeout=60)
    for module, name in places:
        def run(*a, old=getattr(module, name), **b):
            barrier.wait()
            return old(*a, **b)

        monkeypatch.setattr(module, name, run)


def test_kinds_of_blocks_are_solved_side_by_side(spark, monkeypatch):
    """Problems with many and few documents don't wait for each other, nor do blocks with many and few cells."""
    _, *two = small_problems(spark, ["p1", "p2"])
    features, known, unknown = (df.where("problem = 'p1' OR doc_name < 'd5'") for df in two)
    alone = by_key(M.svm_ovr(features, known, unknown))
    monkeypatch.setattr(M, "IN_PLACE_DOCS", 9)
    with monkeypatch.context() as patch:
        together(patch, (M, "_margins_by_passes"), (M.dual, "margins"))
        apart = by_key(M.svm_ovr(features, known, unknown))
    assert alone.keys() == apart.keys() and all(abs(alone[k] - apart[k]) < 1e-5 for k in alone)
    monkeypatch.setattr(M, "IN_PLACE_DOCS", 0)
    monkeypatch.setattr(M.svm, "LOCAL_CELLS", 60)
    together(monkeypatch, (M.svm, "_solve_in_place"), (M.svm, "_curve"))
    passes = by_key(M.svm_ovr(features, known, unknown))
    assert alone.keys() == passes.keys() and all(abs(alone[k] - passes[k]) < 1e-5 for k in alone)


def test_blocks_are_sent_or_read(spark, monkeypatch):
    """Larger blocks are read by their tasks, and strips are kept or made anew, with the same margins."""
    _, *two = small_problems(spark, ["p1", "p2"])
    monkeypatch.setattr(M, "IN_PLACE_DOCS", 0)
    monkeypatch.setattr(M.svm, "LOCAL_TASKS", 2)
    sent = by_key(M.svm_ovr(*two))
    monkeypatch.setattr(M.svm, "SENT_CELLS", 0)
    monkeypatch.setattr(M.svm, "HELD", 0)
    read = by_key(M.svm_ovr(*two))
    assert sent.keys() == read.keys() and all(abs(sent[k] - read[k]) < 1e-9 for k in sent)
