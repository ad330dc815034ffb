"""Readers for a collection of attribution problems: JSON descriptions and text folders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Layout of a collection.
COLLECTION_FILE = "collection-info.json"
PROBLEM_FILE = "problem-info.json"
TRUTH_FILE = "ground-truth.json"
FANDOM_FILE = "fandom-info.json"

LANGUAGES = {
    "en": "english", "fr": "french", "sp": "spanish", "it": "italian", "pl": "polish",
}


def _text(name: str) -> T.StructField:
    return T.StructField(name, T.StringType())


_COLLECTION = T.ArrayType(T.StructType([_text("problem-name"), _text("language")]))
_AUTHORS = T.ArrayType(T.StructType([_text("author-name")]))
_PROBLEM = T.StructType([_text("unknown-folder"), T.StructField("candidate-authors", _AUTHORS)])
_TRUTH = T.StructType([T.StructField("ground_truth", T.ArrayType(
    T.StructType([_text("unknown-text"), _text("true-author")])))])
_ANSWERS = T.ArrayType(T.StructType([_text("unknown-text"), _text("predicted-author")]))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as (path, value), one row each."""
    return spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _unquoted(part: Column) -> Column:
    """A quoted part of a path; a plus sign in it is just a plus sign."""
    return F.url_decode(F.replace(part, F.lit("+"), F.lit("%2B")))


def _part_of_path(pattern: str) -> Column:
    return _unquoted(F.regexp_extract("path", pattern, 1))


FOLDER = r"([^/]+)/[^/]+$"
FILE = r"([^/]+)$"


def parse_collection(files: DataFrame) -> DataFrame:
    """(idx, problem, language) in file order."""
    items = files.select(F.posexplode(F.from_json("value", _COLLECTION)).alias("idx", "p"))
    return items.select("idx", F.col("p.problem-name").alias("problem"), F.col("p.language"))


def read_collection(spark: SparkSession, base: str) -> DataFrame:
    return parse_collection(whole_files(spark, f"{base}/{COLLECTION_FILE}"))


def slice_problems(problems: DataFrame, low: int = 0, high: int | None = None,
                   names: Mapping[str, str] = LANGUAGES) -> DataFrame:
    """Keep problems low..high-1 and add the full language name (unknown codes stay)."""
    mapping = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    kept = problems.where(F.col("idx") >= low)
    if high is not None:
        kept = kept.where(F.col("idx") < high)
    return kept.withColumn(
        "language_name", F.coalesce(F.element_at(mapping, F.col("language")), F.col("language"))
    )


def parse_problem_info(files: DataFrame) -> DataFrame:
    """(problem, author, unknown_folder), one row per candidate."""
    info = files.select(
        _part_of_path(FOLDER).alias("problem"), F.from_json("value", _PROBLEM).alias("j")
    )
    return info.select(
        "problem", F.explode("j.candidate-authors").alias("a"),
        F.col("j.unknown-folder").alias("unknown_folder"),
    ).select("problem", F.col("a.author-name").alias("author"), "unknown_folder")


def read_problem_info(spark: SparkSession, base: str) -> DataFrame:
    return parse_problem_info(whole_files(spark, f"{base}/*/{PROBLEM_FILE}"))


def parse_documents(files: DataFrame) -> DataFrame:
    """(problem, folder, doc_name, text): every text file as one row."""
    return files.select(
        _part_of_path(r"([^/]+)/[^/]+/[^/]+$").alias("problem"),
        _part_of_path(FOLDER).alias("folder"), _part_of_path(FILE).alias("doc_name"),
        F.col("value").alias("text"),
    )


def read_documents(spark: SparkSession, base: str) -> DataFrame:
    return parse_documents(whole_files(spark, f"{base}/*/*/*.txt"))


def train_test(documents: DataFrame, info: DataFrame) -> DataFrame:
    """Label documents as known texts of a candidate or as unknown; others drop out.

    File names repeat from author to author, so a known document is named ``author/file``:
    (problem, doc_name) is the key of a document in every operator.
    """
    known = documents.join(
        info.select("problem", F.col("author").alias("folder")), ["problem", "folder"]
    ).select(
        "problem", F.concat_ws("/", "folder", "doc_name").alias("doc_name"),
        F.col("folder").alias("author"), F.lit("known").alias("split"), "text",
    )
    folders = info.select("problem", F.col("unknown_folder").alias("folder")).distinct()
    unknown = documents.join(folders, ["problem", "folder"]).select(
        "problem", "doc_name", F.lit(None).cast("string").alias("author"),
        F.lit("unknown").alias("split"), "text",
    )
    return known.unionByName(unknown)


def parse_truth(files: DataFrame) -> DataFrame:
    """(problem, doc_name, true_author)."""
    rows = files.select(
        _part_of_path(FOLDER).alias("problem"),
        F.explode(F.from_json("value", _TRUTH)["ground_truth"]).alias("t"),
    )
    return rows.select("problem", F.col("t.unknown-text").alias("doc_name"),
                       F.col("t.true-author").alias("true_author"))


def read_truth(spark: SparkSession, base: str) -> DataFrame:
    return parse_truth(whole_files(spark, f"{base}/*/{TRUTH_FILE}"))


def parse_answers(files: DataFrame) -> DataFrame:
    """(problem, doc_name, predicted_author, pos) from ``answers-<problem>.json`` files, or
    folders of that name as ``write_answers`` makes them."""
    name = _part_of_path(r"answers-([^/]+)\.json(?:/[^/]+)?$")
    # names of partition folders are quoted once more
    written = F.regexp_like("path", F.lit(r"/file=answers-[^/]+/[^/]+$"))
    rows = files.select(
        F.when(written, _unquoted(name)).otherwise(name).alias("problem"),
        F.posexplode(F.from_json("value", _ANSWERS)).alias("pos", "a"),
    )
    return rows.select("problem", F.col("a.unknown-text").alias("doc_name"),
                       F.col("a.predicted-author").alias("predicted_author"), "pos")


def read_answers(spark: SparkSession, folder: str) -> DataFrame:
    return parse_answers(whole_files(spark, f"{folder}/{{file=,}}answers-*.json"))


def first_answers(answers: DataFrame) -> DataFrame:
    """The first answer per document wins; a partial aggregate, so repeats cost nothing."""
    return answers.groupBy("problem", "doc_name").agg(
        F.min_by("predicted_author", "pos").alias("predicted_author")
    )


def parse_fandom(files: DataFrame) -> DataFrame:
    """(problem, author) from the fandom descriptions."""
    rows = files.select(
        _part_of_path(FOLDER).alias("problem"), F.explode(F.from_json("value", _AUTHORS)).alias("a")
    )
    return rows.select("problem", F.col("a.author-name").alias("author"))


def read_fandom(spark: SparkSession, base: str) -> DataFrame:
    return parse_fandom(whole_files(spark, f"{base}/*/{FANDOM_FILE}"))


def parse_imposters(files: DataFrame) -> DataFrame:
    """(language, doc_name, text) from one sub-folder per language."""
    return files.select(
        _part_of_path(FOLDER).alias("language"), _part_of_path(FILE).alias("doc_name"),
        F.col("value").alias("text"),
    )


def read_imposters(spark: SparkSession, folder: str) -> DataFrame:
    return parse_imposters(whole_files(spark, f"{folder}/*/*.txt"))


def parse_pronunciations(rows: DataFrame) -> DataFrame:
    """(word, variant, phonemes): lines ``WORD  PH ON EMES``, variants as ``WORD(1)``."""
    entries = rows.where(F.col("value").contains("  "))
    key = F.lower(F.split("value", "  ")[0])
    digit = F.regexp_extract(key, r"\((\d)\)", 1)
    return entries.select(
        F.regexp_replace(key, r"\(\d\)", "").alias("word"),
        F.when(digit == "", 1).otherwise(digit.cast("int") + 1).alias("variant"),
        F.lower(F.split("value", "  ")[1]).alias("phonemes"),
    )


def read_pronunciations(spark: SparkSession, path: str) -> DataFrame:
    return parse_pronunciations(lines(spark, path))


def parse_lexicon(rows: DataFrame, columns: Sequence[str] = ("word",)) -> DataFrame:
    """Word lists (one per line) or tab-separated tables such as spelling pairs."""
    parts = F.split("value", "\t")
    return rows.where(F.col("value") != "").select(
        *[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(columns)]
    )


def read_lexicon(spark: SparkSession, path: str, columns: Sequence[str] = ("word",)) -> DataFrame:
    return parse_lexicon(lines(spark, path), columns)


def parse_phones(rows: DataFrame) -> DataFrame:
    """(phone, class) from tab-separated lines."""
    return parse_lexicon(rows, ("phone", "class")).withColumn("phone", F.lower("phone"))


def read_phones(spark: SparkSession, path: str) -> DataFrame:
    return parse_phones(lines(spark, path))


def corpus_summary(documents: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Candidates, known texts, unknown texts and vocabulary size per problem."""
    is_known = F.col("split") == "known"
    counts = documents.groupBy("problem").agg(
        F.count_distinct(F.when(is_known, F.col("author"))).alias("n_candidates"),
        F.count_if(is_known).alias("n_known"),
        F.count_if(~is_known).alias("n_unknown"),
    )
    sizes = vocabulary.groupBy("problem").agg(F.count("*").alias("n_vocabulary"))
    return counts.join(sizes, "problem", "left").fillna(0, ["n_vocabulary"])
