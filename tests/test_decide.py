import pytest

from inkprint.operators import decide as D
from inkprint.operators import evaluate as E


def scores(spark, table, models=None):
    rows = []
    for doc, by_model in table.items():
        for model, ps in by_model.items():
            rows += [("p", doc, model, f"c{i}", float(p)) for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, "problem string, doc_name string, model string, author string, p double")


def answers(df):
    return {r["doc_name"]: r["predicted_author"] for r in df.collect()}


def test_soft_vote(spark):
    s = scores(spark, {"1": {"a": [1, 2, 3, 4], "b": [5, 6, 7, 8]}, "2": {"a": [4, 3, 2, 1], "b": [9, 8, 7, 6]}})
    voted = D.soft_vote(s)
    values = {(r["doc_name"], r["author"]): r["p"] for r in voted.collect()}
    assert [values["1", f"c{i}"] for i in range(4)] == [3, 4, 5, 6]
    assert [values["2", f"c{i}"] for i in range(4)] == [6.5, 5.5, 4.5, 3.5]
    assert answers(D.argmax_label(voted)) == {"1": "c3", "2": "c0"}
    weighted = D.soft_vote(s, {"a": 3.0})
    assert weighted.where("doc_name = '1' AND author = 'c0'").first()["p"] == pytest.approx(2.0)


def test_reject_rules(spark):
    s = scores(spark, {"x": {"m": [.40, .35, .25]}, "y": {"m": [.36, .33, .31]}, "z": {"m": [.6, .3, .1]},
                       "one": {"m": [1.0]}})
    assert answers(D.reject_gap3(s)) == {"x": "c0", "y": "<UNK>", "z": "c0", "one": "c0"}
    assert answers(D.reject_gap(s)) == {"x": "<UNK>", "y": "<UNK>", "z": "c0", "one": "c0"}
    novelty = spark.createDataFrame([("p", "x", -1), ("p", "y", 1)], "problem string, doc_name string, novelty int")
    assert answers(D.reject_novelty(s, novelty)) == {"x": "<UNK>", "y": "c0", "z": "c0", "one": "c0"}


def test_reject_cosine_modes(spark):
    s = scores(spark, {"x": {"m": [.40, .38, .22]}})
    cosines = s.withColumnRenamed("p", "cosine").drop("model")
    assert answers(D.reject_cosine(s, cosines, 0.1)) == {"x": "<UNK>"}
    assert answers(D.reject_cosine(s, cosines, 0.1, mode="top")) == {"x": "c0"}


def test_ties_go_to_the_smaller_label(spark):
    s = scores(spark, {"x": {"m": [.5, .5]}})
    assert answers(D.argmax_label(s)) == {"x": "c0"} and answers(D.reject_gap(s, 0)) == {"x": "c0"}


def test_pick_confident(spark):
    s = scores(spark, {"x": {"a": [.8, .2], "b": [.4, .6]}})
    assert answers(D.pick_confident(s)) == {"x": "c1"}
    assert answers(D.pick_confident(s, by="max")) == {"x": "c0"}


def test_macro_scores(spark):
    truth = spark.createDataFrame(
        [("p", f"u{i}", a) for i, a in enumerate(["A", "A", "B", "<UNK>", "B", "C"], 1)],
        "problem string, doc_name string, true_author string")
    given = spark.createDataFrame(
        [("p", d, a, i) for i, (d, a) in enumerate(
            [("u1", "A"), ("u1", "B"), ("u2", "<UNK>"), ("u3", "B"), ("u4", "A"), ("u5", "Z")])],
        "problem string, doc_name string, predicted_author string, pos int")
    from inkprint.sources.collection import first_answers
    aligned = E.align(truth, first_answers(given))
    row = E.macro_prf(aligned).first()
    assert row["macro_f1"] == pytest.approx(0.388889, abs=1e-6)
    assert row["macro_precision"] == pytest.approx(0.5) and row["macro_recall"] == pytest.approx(1 / 3)
    assert E.accuracy(aligned).first()["accuracy"] == pytest.approx(1 / 3)
    per_problem, overall = E.evaluate_all(aligned)
    assert overall.first()["overall_score"] == pytest.approx(0.389)
    problems = spark.createDataFrame([("p", "en")], "problem string, language string")
    assert E.language_mean(per_problem, problems).first()["mean_f1"] == pytest.approx(0.389)


def test_average_precision(spark):
    s = scores(spark, {"x": {"m": [.9, .1]}, "y": {"m": [.4, .6]}}).drop("model")
    truth = spark.createDataFrame([("p", "x", "c0"), ("p", "y", "c0")],
                                  "problem string, doc_name string, true_author string")
    curve = E.pr_curve(s, truth)
    assert [(r["precision"], r["recall"]) for r in curve.orderBy("threshold").collect()][-1] == (1.0, 0.5)
    assert E.avg_precision(curve).first()["avg_precision"] == pytest.approx(0.5 + 0.5 * 2 / 3)
