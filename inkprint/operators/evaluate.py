"""Quality of answers: macro precision, recall and F1, curves and error tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkprint.operators.common import DOC, join_dimension, ordinal
from inkprint.operators.decide import UNKNOWN, top_scores


def align(truth: DataFrame, answers: DataFrame) -> DataFrame:
    """(problem, doc_name, gold, silver); missing answers and labels foreign to the problem's
    truth become unknown."""
    gold = truth.select("problem", F.col("true_author").alias("silver")).distinct().withColumn(
        "_in", F.lit(True)
    )
    joined = truth.join(answers.select(*DOC, "predicted_author"), DOC, "left").select(
        *DOC, F.col("true_author").alias("gold"),
        F.coalesce("predicted_author", F.lit(UNKNOWN)).alias("silver"),
    )
    marked = join_dimension(joined, gold, ["problem", "silver"], ["doc_name"], how="left")
    return marked.select(
        *DOC, "gold", F.when(F.col("_in"), F.col("silver")).otherwise(UNKNOWN).alias("silver")
    )


def class_report(aligned: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per gold class; undefined values count 0."""
    hit = F.when(F.col("gold") == F.col("silver"), 1).otherwise(0)
    marks = F.array(
        F.struct(F.col("gold").alias("author"), F.lit(1).alias("g"), F.lit(0).alias("s"), hit.alias("tp")),
        F.struct(F.col("silver").alias("author"), F.lit(0).alias("g"), F.lit(1).alias("s"),
                 F.lit(0).alias("tp")),
    )
    sums = aligned.select("problem", F.inline(marks)).groupBy("problem", "author").agg(
        F.sum("g").alias("support"), F.sum("s").alias("answered"), F.sum("tp").alias("tp")
    ).where(F.col("support") > 0)
    zero = F.lit(0.0)
    precision = F.when(F.col("answered") > 0, F.col("tp") / F.col("answered")).otherwise(zero)
    recall = F.col("tp") / F.col("support")
    f1 = F.when(
        F.col("tp") > 0, F.lit(2.0) * F.col("tp") / (F.col("answered") + F.col("support"))
    ).otherwise(zero)
    return sums.select("problem", "author", precision.alias("precision"), recall.alias("recall"),
                       f1.alias("f1"), "support")


def macro_prf(aligned: DataFrame) -> DataFrame:
    """Means over the gold authors; unattributed texts are no class of their own."""
    return class_report(aligned).where(F.col("author") != UNKNOWN).groupBy("problem").agg(
        F.avg("f1").alias("macro_f1"), F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
    )


def macro_f1_with_unknown(aligned: DataFrame) -> DataFrame:
    return class_report(aligned).groupBy("problem").agg(F.avg("f1").alias("macro_f1"))


def accuracy(aligned: DataFrame) -> DataFrame:
    return aligned.groupBy("problem").agg(
        F.avg(F.when(F.col("gold") == F.col("silver"), 1.0).otherwise(0.0)).alias("accuracy")
    )


def evaluate_all(aligned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores per problem rounded to three digits, and the mean of the rounded F1."""
    per_problem = macro_prf(aligned).select(
        "problem", *[F.round(c, 3).alias(c) for c in ("macro_f1", "macro_precision", "macro_recall")]
    )
    overall = per_problem.agg(F.round(F.avg("macro_f1"), 3).alias("overall_score"))
    return per_problem, overall


def language_mean(per_problem: DataFrame, problems: DataFrame) -> DataFrame:
    return per_problem.join(problems.select("problem", "language"), "problem").groupBy(
        "language"
    ).agg(F.avg("macro_f1").alias("mean_f1"), F.count("*").alias("n_problems"))


def pr_curve(scores: DataFrame, truth: DataFrame, digits: int = 6) -> DataFrame:
    """Precision and recall at every threshold, over all (document, candidate) pairs.

    Pairs are first counted per threshold (p rounded to ``digits``); the running sums then see
    at most ``10 ** digits`` rows per problem.
    """
    hit = F.when(F.col("author") == F.col("true_author"), 1).otherwise(0)
    steps = scores.join(truth, DOC).groupBy("problem", F.round("p", digits).alias("threshold")).agg(
        F.sum(hit).alias("_hits"), F.count("*").alias("_n")
    )
    down = Window.partitionBy("problem").orderBy(F.desc("threshold"))
    running = down.rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy("problem")
    return steps.select(
        "problem", "threshold",
        (F.sum("_hits").over(running) / F.sum("_n").over(running)).alias("precision"),
        F.try_divide(F.sum("_hits").over(running), F.sum("_hits").over(total)).alias("recall"),
    )


def avg_precision(curve: DataFrame) -> DataFrame:
    """Sum of the steps in recall times the precision reached."""
    down = Window.partitionBy("problem").orderBy(F.desc("threshold"))
    step = F.col("recall") - F.coalesce(F.lag("recall").over(down), F.lit(0.0))
    return curve.withColumn("_step", step).groupBy("problem").agg(
        F.sum(F.col("_step") * F.col("precision")).alias("avg_precision")
    )


def unknown_stats(scores: DataFrame, answers: DataFrame, truth: DataFrame) -> DataFrame:
    """Statistics of the top probability for the three ways an unknown text can come about."""
    top = scores.groupBy(*DOC).agg(F.max("p").alias("top"))
    joined = top.join(answers.select(*DOC, "predicted_author"), DOC).join(truth, DOC)
    no_author, no_answer = (F.col(c) == UNKNOWN for c in ("true_author", "predicted_author"))
    case = (
        F.when(no_author & ~no_answer, "false_known")
        .when(~no_author & no_answer, "false_unknown")
        .when(no_author & no_answer, "true_unknown")
    )
    return joined.withColumn("case", case).where(F.col("case").isNotNull()).groupBy(
        "problem", "case"
    ).agg(
        F.max("top").alias("max"), F.var_pop("top").alias("var"), F.stddev_pop("top").alias("std"),
        F.min("top").alias("min"), F.avg("top").alias("mean"), F.count("*").alias("n"),
    )


def error_table(scores: DataFrame, answers: DataFrame, truth: DataFrame,
                threshold: float = 0.1) -> DataFrame:
    """Per wrongly rejected or wrongly attributed document: gaps between the best four scores,
    whether the first or second choice was right, and the scores above the threshold."""
    order = Window.partitionBy(*DOC).orderBy(F.desc("p"), F.asc("author"))
    second = scores.withColumn("_r", F.row_number().over(order)).where("_r <= 2").where("_r = 2")
    second = second.select(*DOC, F.col("author").alias("second"))
    high = scores.groupBy(*DOC).agg(F.reverse(F.array_sort(F.collect_list(
        F.when(F.col("p") > threshold, F.col("p"))))).alias("high"))
    top = top_scores(scores, 4).withColumnRenamed("predicted_author", "first")
    joined = (
        top.join(second, DOC, "left").join(high, DOC)
        .join(answers.select(*DOC, "predicted_author"), DOC).join(truth, DOC)
    )
    no_author, no_answer = (F.col(c) == UNKNOWN for c in ("true_author", "predicted_author"))
    p1, p2, p3, p4 = (F.col(f"p{i}") for i in range(1, 5))
    return joined.where(no_author != no_answer).select(
        *DOC, "true_author", "predicted_author",
        ((p1 - p2) / 2).alias("half_first_gap"), p2.alias("p2"), (p1 - p2).alias("first_gap"),
        (((p1 - p2) + (p2 - p3)) / 2).alias("mean_gap"), ((p2 - p4) / 2).alias("late_gap"),
        "first", (F.col("first") == F.col("true_author")).alias("first_right"),
        "second", (F.col("second") == F.col("true_author")).alias("second_right"), "high",
    )


def oof_table(scores: DataFrame, truth: DataFrame, group_size: int = 9) -> DataFrame:
    """Per document: running group number, best candidate, whether it is right, all scores."""
    best = F.min(F.struct((-F.col("p")).alias("q"), F.col("author")))
    rows = F.array_sort(F.collect_list(F.struct("author", "p")))
    per_doc = scores.groupBy(*DOC).agg(
        best.alias("b"), F.transform(rows, lambda s: s["p"]).alias("proba")
    )
    numbered = ordinal(per_doc.join(truth, DOC), ["problem"], "doc_name", "_i")
    return numbered.select(
        *DOC, F.ceil((F.col("_i") + 1) / group_size).alias("group"),
        F.col("b.author").alias("best"), (F.col("b.author") == F.col("true_author")).alias("hit"),
        "proba",
    )
