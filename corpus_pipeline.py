"""Pipeline over documents: one stage after the other, each on the rows its predecessor kept.

Every stage but the last returns the columns of documents. ``run`` writes each stage's rows to the
folder named by spark.checkpoint.dir before the next one reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkprint.llm import decontaminate, pieces, private, quality, simhash
from inkprint.llm.queries import piece_model, table
from inkprint.session import materialize


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_texts(docs, model, docs.columns, at_least=quality.THRESHOLD)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked."""
    return private.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the number and digest of their ids, and the digest of the decoded text.

    Columns of those names that documents may bring are replaced."""
    made = {"n_tokens", "ids_sha256", "decoded_sha256"}
    return pieces.digest_texts(docs, piece_model(), [c for c in docs.columns if c not in made])


STAGES = [
    ("quality", good), ("near_duplicates", distinct), ("decontamination", clean),
    ("private", masked), ("pieces", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Boosted tables, graph scores, components and merges can't be said in SQL; a test compares run()
#: with brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
