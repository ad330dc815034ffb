"""The driver's tables seen as attribution problems, in Spark and in SQL.

One problem per language. Documents of the nine candidate sources are their known
texts unless they belong to the unknown split; every document is in exactly one of
the roles known, imposter (known text of a source that is no candidate) and unknown.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.functions import text as T

Query = Callable[[SparkSession, str], DataFrame]

# The candidate sources and the label of a text without author.
CANDIDATES = [f"src{i}" for i in range(9)]
UNKNOWN = "<UNK>"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """(problem, language, doc_name, author, text, split, true_author) for every document."""
    return table(spark, sf, "documents").select(
        F.col("lang").alias("problem"),
        F.col("lang").alias("language"),
        F.col("doc_id").cast("string").alias("doc_name"),
        F.col("source").alias("author"),
        "text",
        F.when(F.col("doc_id") % 3 == 0, "unknown").otherwise("known").alias("split"),
        F.when(F.col("source").isin(CANDIDATES), F.col("source")).otherwise(UNKNOWN)
        .alias("true_author"),
    )


def known(d: DataFrame) -> DataFrame:
    return d.where((F.col("split") == "known") & (F.col("true_author") != UNKNOWN))


def unknown(d: DataFrame) -> DataFrame:
    return d.where(F.col("split") == "unknown")


def imposters(d: DataFrame) -> DataFrame:
    return d.where((F.col("split") == "known") & (F.col("true_author") == UNKNOWN))


def candidates(d: DataFrame) -> DataFrame:
    return known(d).select("problem", "author").distinct()


# -- SQL side -------------------------------------------------------------------

CORPUS = """corpus AS (
  SELECT lang AS problem, CAST(doc_id AS VARCHAR) AS doc_name, source AS author, text,
         CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE 'known' END AS split,
         CASE WHEN source IN ('src0','src1','src2','src3','src4','src5','src6','src7','src8')
              THEN source ELSE '<UNK>' END AS true_author
  FROM documents),
known AS (SELECT * FROM corpus WHERE split = 'known' AND true_author <> '<UNK>'),
unknown AS (SELECT * FROM corpus WHERE split = 'unknown'),
imposters AS (SELECT * FROM corpus WHERE split = 'known' AND true_author = '<UNK>')"""

WORD_SQL, WORDPUNCT_SQL, DEFAULT_SQL = T.WORD, T.WORDPUNCT, T.DEFAULT_TOKEN
WORDS_SQL = f"{T.NONSPACE}+"


def sql(*ctes_and_body: str) -> str:
    *ctes, body = ctes_and_body
    return "WITH " + ",\n".join([CORPUS, *ctes]) + "\n" + body


def char_counts_sql(name: str, source: str, sizes, text: str = "text", collapse: bool = True,
                    keys: str = "problem, doc_name") -> str:
    """CTE ``name``(keys, term, tf): character n-gram counts, read in short pieces of the text."""
    longest = max(sizes)
    value = f"regexp_replace({text}, '{T.SPACES}', ' ', 'g')" if collapse else text
    values = ", ".join(f"({n})" for n in sizes)
    return f"""{name} AS (
  SELECT {keys}, substring(piece, p, n) AS term, count(*) AS tf
  FROM (SELECT {keys}, piece, unnest(range(1, 1 + least(256, length(piece)))) AS p
        FROM (SELECT {keys}, substring(t, 256 * c + 1, {256 + longest - 1}) AS piece
              FROM (SELECT {keys}, t, unnest(range(0, (length(t) + 255) // 256)) AS c
                    FROM (SELECT {keys}, {value} AS t FROM {source})))),
       (VALUES {values}) AS sizes(n)
  WHERE p + n - 1 <= length(piece)
  GROUP BY ALL)"""


def word_counts_sql(name: str, source: str, low: int, high: int, pattern: str = WORDPUNCT_SQL,
                    text: str = "text", keys: str = "problem, doc_name") -> str:
    following = ", ".join(
        f"lead(tok, {i}) OVER (PARTITION BY {keys} ORDER BY i) AS t{i}" for i in range(1, high)
    )
    grams = ["tok"]
    for i in range(1, high):
        grams.append(f"{grams[-1]} || ' ' || t{i}")
    listed = ", ".join(grams[low - 1:high])
    return f"""{name} AS (
  SELECT {keys}, term, count(*) AS tf
  FROM (SELECT {keys}, unnest([{listed}]) AS term
        FROM (SELECT {keys}, tok{", " + following if following else ""}
              FROM (SELECT {keys}, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i
                    FROM (SELECT {keys}, regexp_extract_all({text}, '{pattern}') AS toks FROM {source}))))
  WHERE term IS NOT NULL GROUP BY ALL)"""


def idf_sql(name: str, counts: str, source: str, min_df: float, n_docs: str = "count(*)") -> str:
    return f"""{name} AS (
  SELECT problem, term, df, cf, n_docs, ln((1.0::DOUBLE + n_docs) / (1.0::DOUBLE + df)) + 1 AS idf
  FROM (SELECT problem, term, count(*) AS df, sum(tf) AS cf FROM {counts} GROUP BY ALL)
  JOIN (SELECT problem, {n_docs} AS n_docs FROM {source} GROUP BY problem) USING (problem)
  WHERE df >= {float(min_df)}::DOUBLE * n_docs)"""


def tfidf_sql(name: str, counts: str, idf: str, sublinear: bool = True,
              key: str = "doc_name") -> str:
    tf = "(1 + ln(tf))" if sublinear else "CAST(tf AS DOUBLE)"
    return f"""{name}_w AS (
  SELECT problem, {key}, term, {tf} * idf AS w FROM {counts} JOIN {idf} USING (problem, term)),
{name} AS (
  SELECT problem, {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY problem, {key})) AS value
  FROM {name}_w)"""


# -- summaries that keep results small but depend on every row -------------------


def count_summary(counts: DataFrame, *keys: str) -> DataFrame:
    return counts.groupBy(*keys).agg(
        F.count("*").alias("n_terms"), F.sum("tf").alias("n_total"),
        F.sum(F.col("tf") * F.col("tf")).alias("n_squares"),
        F.min("term").alias("first_term"), F.max("term").alias("last_term"),
    )


def count_summary_sql(source: str, keys: str) -> str:
    return f"""SELECT {keys}, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_total,
  CAST(sum(tf * tf) AS BIGINT) AS n_squares, min(term) AS first_term, max(term) AS last_term
FROM {source} GROUP BY {keys}"""


def value_summary(features: DataFrame, *keys: str) -> DataFrame:
    return features.groupBy(*keys).agg(
        F.count("*").alias("n_terms"), F.round(F.sum("value"), 6).alias("sum_value"),
        F.round(F.max("value"), 6).alias("max_value"),
        F.round(F.sum(F.col("value") * F.length("term")), 6).alias("sum_by_length"),
        F.min("term").alias("first_term"), F.max("term").alias("last_term"),
    )


def value_summary_sql(source: str, keys: str) -> str:
    return f"""SELECT {keys}, count(*) AS n_terms, round(sum(value), 6) AS sum_value,
  round(max(value), 6) AS max_value, round(sum(value * length(term)), 6) AS sum_by_length,
  min(term) AS first_term, max(term) AS last_term
FROM {source} GROUP BY {keys}"""
