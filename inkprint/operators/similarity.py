"""Similarity of documents with profiles: sparse products as joins on the term."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.operators.common import DOC, join_dimension

PAIR = [*DOC, "author"]
EPSILON = 1e-6  # fixed value: keeps the min-max quotient defined for two empty vectors


def complete_scores(docs: DataFrame, candidates: DataFrame, scores: DataFrame,
                    column: str, fill: float = 0.0) -> DataFrame:
    """One row per document and candidate of its problem, missing scores filled.

    The score matrix is the result asked for; a document without any known term keeps its row.
    """
    pairs = join_dimension(
        docs.select(*DOC), candidates.select("problem", "author"), ["problem"], ["doc_name"]
    )
    filled = pairs.join(scores, PAIR, "left")
    return filled.withColumn(column, F.coalesce(column, F.lit(fill)))


def author_centroids(features: DataFrame, labels: DataFrame) -> DataFrame:
    """(problem, author, term, value): mean vector over the author's documents, zeros included."""
    sizes = labels.groupBy("problem", "author").agg(F.count("*").alias("_n"))
    sums = features.join(labels.select(*PAIR), DOC).groupBy("problem", "author", "term").agg(
        F.sum("value").alias("_s")
    )
    return join_dimension(sums, sizes, ["problem", "author"], ["term"]).select(
        "problem", "author", "term", (F.col("_s") / F.col("_n")).alias("value")
    )


def cosine_matrix(features: DataFrame, profiles: DataFrame) -> DataFrame:
    """(problem, doc_name, author, cosine) for pairs that share a term; neither side need be normed."""
    right = profiles.select("problem", "term", "author", F.col("value").alias("_b"))
    joined = join_dimension(features, right, ["problem", "term"], DOC)
    dots = joined.groupBy(*PAIR).agg(F.sum(F.col("value") * F.col("_b")).alias("_dot"))
    left_norm = features.groupBy(*DOC).agg(F.sqrt(F.sum(F.col("value") ** 2)).alias("_na"))
    right_norm = profiles.groupBy("problem", "author").agg(
        F.sqrt(F.sum(F.col("value") ** 2)).alias("_nb")
    )
    normed = join_dimension(dots.join(left_norm, DOC), right_norm, ["problem", "author"], ["doc_name"])
    return normed.select(*PAIR, (F.col("_dot") / (F.col("_na") * F.col("_nb"))).alias("cosine"))


def cosine_self(profiles: DataFrame) -> DataFrame:
    """(problem, author, other, cosine) between the profiles of a problem."""
    renamed = profiles.withColumnRenamed("author", "doc_name")
    return cosine_matrix(renamed, profiles).select(
        "problem", F.col("doc_name").alias("author"), F.col("author").alias("other"), "cosine"
    )


def minmax_distance(features: DataFrame, profiles: DataFrame) -> DataFrame:
    """(problem, doc_name, author, distance) for pairs that share a term; others are at 1.

    Values are not negative, so the sum of maxima is the sum of both sides less the minima.
    """
    right = profiles.select("problem", "term", "author", F.col("value").alias("_b"))
    joined = join_dimension(features, right, ["problem", "term"], DOC)
    mins = joined.groupBy(*PAIR).agg(F.sum(F.least("value", "_b")).alias("_min"))
    left_sum = features.groupBy(*DOC).agg(F.sum("value").alias("_sa"))
    right_sum = profiles.groupBy("problem", "author").agg(F.sum("value").alias("_sb"))
    full = join_dimension(mins.join(left_sum, DOC), right_sum, ["problem", "author"], ["doc_name"])
    largest = F.col("_sa") + F.col("_sb") - F.col("_min") + F.lit(EPSILON)
    return full.select(*PAIR, (F.lit(1.0) - F.col("_min") / largest).alias("distance"))


def share_per_document(scores: DataFrame, column: str, out: str = "p") -> DataFrame:
    """Scores of a document divided by their sum; all zero stays all zero."""
    sums = scores.groupBy(*DOC).agg(F.sum(column).alias("_sum"))
    share = F.when(F.col("_sum") > 0, F.col(column) / F.col("_sum")).otherwise(F.lit(0.0))
    return scores.join(sums, DOC).withColumn(out, share).drop("_sum")


def novelty(features: DataFrame, known_keys: DataFrame) -> DataFrame:
    """(problem, doc_name, similarity, novelty): -1 for documents less similar to the centroid
    of the known documents than half of those are, else 1.

    Similarities are rounded to six digits: the exact median then comes from a histogram of at
    most a million values per problem instead of all documents in one place.
    """
    keys = known_keys.select(*DOC).withColumn("author", F.lit("all"))
    center = author_centroids(features, keys)
    similar = cosine_matrix(features, center).select(*DOC, F.round("cosine", 6).alias("similarity"))
    training = similar.join(keys.select(*DOC), DOC, "left_semi")
    histogram = training.groupBy("problem", "similarity").agg(F.count("*").alias("n"))
    cutoff = histogram.groupBy("problem").agg(
        F.percentile("similarity", 0.5, F.col("n")).alias("cutoff")
    )
    joined = join_dimension(similar, cutoff, ["problem"], ["doc_name"])
    return joined.select(
        *DOC, "similarity", F.when(F.col("similarity") < F.col("cutoff"), -1).otherwise(1)
        .alias("novelty"),
    )
