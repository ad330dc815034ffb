"""From scores to answers: voting, choice of the best candidate, reject rules.

Scores are (problem, doc_name[, model], author, p). Ties go to the smaller label.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkprint.operators.common import DOC

UNKNOWN = "<UNK>"


def soft_vote(scores: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Weighted mean of p over the models; models without a weight count 1."""
    weight = F.lit(1.0)
    for model, value in (weights or {}).items():
        weight = F.when(F.col("model") == model, F.lit(float(value))).otherwise(weight)
    return scores.groupBy(*DOC, "author").agg(
        (F.sum(weight * F.col("p")) / F.sum(weight)).alias("p")
    )


def mean_two(first: DataFrame, second: DataFrame) -> DataFrame:
    both = first.withColumn("model", F.lit("first")).unionByName(
        second.withColumn("model", F.lit("second"))
    )
    return soft_vote(both)


def argmax_label(scores: DataFrame) -> DataFrame:
    """(problem, doc_name, predicted_author, p), a plain aggregate with map-side combining."""
    best = F.min(F.struct((-F.col("p")).alias("q"), F.col("author")))
    return scores.groupBy(*DOC).agg(best.alias("b")).select(
        *DOC, F.col("b.author").alias("predicted_author"), (-F.col("b.q")).alias("p")
    )


def pick_confident(scores: DataFrame, by: str = "min") -> DataFrame:
    """Answer of the model whose smallest (or, with ``by='max'``, largest) p is larger."""
    rank = {"min": F.min, "max": F.max}[by]
    best = F.min(F.struct((-F.col("p")).alias("q"), F.col("author")))
    per_model = scores.groupBy(*DOC, "model").agg(
        rank("p").alias("confidence"), best.alias("b")
    )
    winner = F.min(F.struct((-F.col("confidence")).alias("c"), "model", F.col("b.author")))
    return per_model.groupBy(*DOC).agg(winner.alias("w")).select(
        *DOC, F.col("w.model"), F.col("w.author").alias("predicted_author")
    )


def proba_compare(scores: DataFrame) -> DataFrame:
    """Mean p per candidate over the models, and its total per document."""
    mean = soft_vote(scores)
    totals = mean.groupBy(*DOC).agg(F.sum("p").alias("total"))
    return mean.join(totals, DOC)


def proba_reverse(scores: DataFrame) -> DataFrame:
    return scores.withColumn("p", F.lit(1.0) - F.col("p"))


def top_scores(scores: DataFrame, k: int = 3) -> DataFrame:
    """(problem, doc_name, predicted_author, p1 .. pk), missing places 0.

    The rank filter is applied on the map side as well (window group limit).
    """
    order = Window.partitionBy(*DOC).orderBy(F.desc("p"), F.asc("author"))
    ranked = scores.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    places = [
        F.coalesce(F.max(F.when(F.col("_r") == i, F.col("p"))), F.lit(0.0)).alias(f"p{i}")
        for i in range(1, k + 1)
    ]
    first = F.max(F.when(F.col("_r") == 1, F.col("author"))).alias("predicted_author")
    return ranked.groupBy(*DOC).agg(first, *places)


def _reject(answers: DataFrame, doubtful: Column) -> DataFrame:
    return answers.withColumn(
        "predicted_author", F.when(doubtful, UNKNOWN).otherwise(F.col("predicted_author"))
    )


def gap(a: str = "p1", b: str = "p2") -> Column:
    return F.col(a) - F.col(b)


def half_gap() -> Column:
    return (gap("p1", "p2") + gap("p2", "p3")) / 2


def reject_gap(scores: DataFrame, pt: float = 0.1) -> DataFrame:
    return _reject(top_scores(scores, 2), gap() < pt)


def reject_gap3(scores: DataFrame, pt: float = 0.1, half: float = 0.07) -> DataFrame:
    return _reject(top_scores(scores, 3), (gap() < pt) & (half_gap() < half))


def reject_cosine(scores: DataFrame, cosines: DataFrame, pt: float = 0.1,
                  mode: str = "reference") -> DataFrame:
    """Reject if the answer is not the candidate singled out by cosine and the gap is small.

    ``mode='reference'`` singles out the least similar candidate, ``mode='top'`` the most similar.
    """
    side = F.col("cosine") if mode == "reference" else -F.col("cosine")
    chosen = cosines.groupBy(*DOC).agg(F.min(F.struct(side.alias("c"), "author")).alias("x")).select(
        *DOC, F.col("x.author").alias("_chosen")
    )
    joined = top_scores(scores, 2).join(chosen, DOC, "left")
    other = F.coalesce(F.col("predicted_author") != F.col("_chosen"), F.lit(True))
    return _reject(joined, other & (gap() < pt - 0.01)).drop("_chosen")


def reject_novelty(scores: DataFrame, novelty: DataFrame, pt: float = 0.1,
                   half: float = 0.1) -> DataFrame:
    joined = top_scores(scores, 3).join(novelty.select(*DOC, "novelty"), DOC, "left")
    doubtful = (gap() < pt) & (half_gap() < half) & (F.col("novelty") < 0)
    return _reject(joined, F.coalesce(doubtful, F.lit(False))).drop("novelty")


def answers_for(docs: DataFrame, answers: DataFrame) -> DataFrame:
    """Every document gets an answer: those without any score are left unattributed."""
    return docs.select(*DOC).join(answers, DOC, "left").withColumn(
        "predicted_author", F.coalesce("predicted_author", F.lit(UNKNOWN))
    )


def unattributed_count(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """Unattributed answers per problem next to an expected number (problem, expected)."""
    counts = answers.groupBy("problem").agg(
        F.count_if(F.col("predicted_author") == UNKNOWN).alias("unattributed"),
        F.count("*").alias("n_answers"),
    )
    return counts.join(expected, "problem", "left")
