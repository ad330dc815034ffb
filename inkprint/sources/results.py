"""Writers for answers and evaluation results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def answer_stats(answers: DataFrame, scores: DataFrame) -> DataFrame:
    """Answers with the list of probabilities, candidates in sorted order."""
    proba = scores.groupBy("problem", "doc_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("author", "p"))), lambda s: s["p"])
        .alias("proba")
    )
    return answers.join(proba, ["problem", "doc_name"], "left")


def write_answers(answers: DataFrame, path: str) -> None:
    """One JSON array per problem, in order of the document names, in a folder of the problem's own.
    ``read_answers`` reads it back. A problem's answers are a few short strings per document."""
    row = F.struct(
        F.col("doc_name").alias("unknown-text"), F.col("predicted_author").alias("predicted-author")
    )
    arrays = answers.groupBy("problem").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("value"))
    file = F.concat(F.lit("answers-"), F.col("problem"), F.lit(".json"))
    arrays.select(file.alias("file"), "value").write.mode("overwrite").partitionBy("file").text(path)


def prototext(overall: DataFrame) -> DataFrame:
    """The overall score as one text row in the protocol-buffer text format."""
    return overall.select(F.concat(
        F.lit('measure {\n key: "mean macro-f1"\n value: "'),
        F.col("overall_score").cast("string"), F.lit('"\n}\n'),
    ).alias("value"))


def write_evaluation(per_problem: DataFrame, overall: DataFrame, path: str) -> None:
    """``problems`` and ``overall`` as JSON, and the overall score as prototext."""
    named = per_problem.select(
        F.col("problem").alias("problem-name"), F.col("macro_f1").alias("macro-f1"),
        F.col("macro_precision").alias("macro-precision"),
        F.col("macro_recall").alias("macro-recall"),
    )
    named.write.mode("overwrite").json(f"{path}/problems")
    overall.write.mode("overwrite").json(f"{path}/overall")
    prototext(overall).write.mode("overwrite").text(f"{path}/evaluation.prototext")
