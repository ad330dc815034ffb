"""Text operators that look at more than one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.functions import text as T
from inkprint.functions.stems import english_stems
from inkprint.operators.common import DOC, join_dimension, ordinal, replace_tokens


def truncate_common(docs: DataFrame, split: str = "split") -> DataFrame:
    """Cut the texts of each set to the shortest length found among its first k rows,
    k being the size of the smaller set of the problem."""
    sizes = docs.groupBy("problem", split).agg(F.count("*").alias("_n"))
    smallest = sizes.groupBy("problem").agg(F.min("_n").alias("_k"))
    numbered = ordinal(
        docs.select("problem", split, "doc_name", F.length("text").alias("_length")),
        ["problem", split], "doc_name", "_ordinal",
    )
    cuts = (
        numbered.join(smallest, "problem").where(F.col("_ordinal") < F.col("_k"))
        .groupBy("problem", split).agg(F.min("_length").alias("_cut"))
    )
    cut = join_dimension(docs, cuts, ["problem", split], ["doc_name"])
    return cut.withColumn("text", F.substring("text", F.lit(1), F.col("_cut"))).drop("_cut")


def _ordered_text(tags: DataFrame, value: Column) -> DataFrame:
    """One document is one bounded group; the rows are sorted inside it."""
    rows = F.array_sort(F.collect_list(F.struct("pos", value.alias("v"))))
    return tags.groupBy(*DOC).agg(
        F.array_join(F.transform(rows, lambda r: r["v"]), " ").alias("text")
    )


def tag_strings(tags: DataFrame) -> DataFrame:
    """(problem, doc_name, text): the part-of-speech tags of a document as one string."""
    return _ordered_text(tags, F.col("tag"))


def token_tag_strings(tags: DataFrame) -> DataFrame:
    """(problem, doc_name, text): ``token/TAG`` strings."""
    return _ordered_text(tags, F.concat("token", F.lit("/"), "tag"))


def english_stem_table(docs: DataFrame, language: str = "english") -> DataFrame:
    """(language, token, stem) of the distinct tokens of English documents."""
    english = docs.where(F.col("language") == language)
    tokens = english.select("language", F.explode(T.wordpunct_tokens(F.col("text"))).alias("token"))
    return english_stems(tokens.distinct())


def stem_tokens(docs: DataFrame, stems: DataFrame) -> DataFrame:
    """Replace each token by its stem and join by blanks; tokens without a stem stay.

    ``stems`` is (language, token, stem), made once per distinct token.
    """
    # A token is looked up once per part, so none is hot.
    named = stems.select("language", "token", F.col("stem").alias("value"), F.lit(1).alias("_often"))

    def value_of(tokens: DataFrame) -> DataFrame:
        return join_dimension(tokens, named, ["language", "token"], ["_part"], weight="_often")

    return replace_tokens(docs, T.wordpunct_tokens(F.col("text")), value_of, ["language"])
