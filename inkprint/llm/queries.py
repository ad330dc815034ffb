"""Registered queries over the whole tables of documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.llm import (
    counts, decontaminate, language, lexical, metric, multiset, negatives, ngrams, pieces, private, quality,
    simhash, wrappers,
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.digest_texts(table(spark, sf, "documents"), piece_model(), ["doc_id"])


def op2_private(spark: SparkSession, sf: str) -> DataFrame:
    return private.find_private(table(spark, sf, "documents"))


def op3_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op4_multiset(spark: SparkSession, sf: str) -> DataFrame:
    return multiset.compare_edited(table(spark, sf, "documents"))


def op5_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.find_passages(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op6_wrappers(spark: SparkSession, sf: str) -> DataFrame:
    return wrappers.main_text(table(spark, sf, "pages"))


def op7_language(spark: SparkSession, sf: str) -> DataFrame:
    return language.identify(table(spark, sf, "documents"))


def op8_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with three edits, made of its own text: the last 20 code points go, 40 from the
    second quarter are written again in its middle, and its first two thirds get a new word."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    size = F.length("text")
    quarter, half, third = (F.floor(size * x).cast("int") for x in (0.25, 0.5, 0.66))

    def edit(start, end, put):
        return F.struct(start.alias("start"), end.alias("end"), put.alias("put"))

    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("edits", F.array(
        edit(F.greatest(size - 20, third), size, F.lit("")),
        edit(half, half, F.substring("text", quarter + 1, F.lit(40))),
        edit(quarter, F.least(quarter + 3, half), F.lit(" revised")),
    ))
    planted = counts.plant(docs, path, pattern, ["doc_id", "text", "edits"])
    return counts.revise(planted, path, pattern).select(
        "doc_id", "n_tokens", "edited_tokens", "n_leaves", "n_encoded", F.sha2("text", 256).alias("edited_sha256")
    )


def op9_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents")).select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op10_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    return ngrams.score_texts(table(spark, sf, "documents"))


def op11_lexical(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.rank(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op12_negatives(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf, "embeddings"), label, F.col("vec_id") % 100 == 0)


def op13_metric(spark: SparkSession, sf: str) -> DataFrame:
    return metric.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_private": op2_private,
    "op3_quality": op3_quality,
    "op4_multiset": op4_multiset,
    "op5_decontaminate": op5_decontaminate,
    "op6_wrappers": op6_wrappers,
    "op7_language": op7_language,
    "op8_counts": op8_counts,
    "op9_simhash": op9_simhash,
    "op10_ngrams": op10_ngrams,
    "op11_lexical": op11_lexical,
    "op12_negatives": op12_negatives,
    "op13_metric": op13_metric,
}

#: Rows of embeddings that take part, with whole components in doubles: their products are exact below 2^53.
WHOLE = """
            SELECT row_number() OVER () AS place, vec_id, label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND
                  len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
"""

ORACLES: dict[str, str] = {
    "op5_decontaminate": """
        WITH texts AS (
            SELECT row_number() OVER () AS place, doc_id AS id, text, false AS item FROM documents
            UNION ALL SELECT 0, item_id, text, true FROM benchmark
        ), worded AS (
            SELECT place, id, item, list_filter(string_split(
                regexp_replace(lower(text), '[\\x00-/:-@\\[-`{-\\x7F]', ' ', 'g'), ' '), lambda w: w <> '') AS w
            FROM texts WHERE text IS NOT NULL
        ), sized AS (
            SELECT item, len(w) AS n, least(5, len(w)) AS width, place, id, w FROM worded WHERE len(w) > 0
        ), widths AS (SELECT DISTINCT width FROM sized WHERE item),
        cut AS (
            SELECT DISTINCT s.item, s.place, s.id, v.width,
                   unnest(list_transform(range(1, s.n - v.width + 2),
                          lambda k: array_to_string(s.w[k : k + v.width - 1], ' '))) AS shingle
            FROM sized s JOIN widths v ON CASE WHEN s.item THEN s.width = v.width ELSE s.n >= v.width END
        ), sizes AS (SELECT id, width, count(*) AS n FROM cut WHERE item GROUP BY ALL)
        SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, count(*) / any_value(z.n) AS containment
        FROM cut d JOIN cut i ON d.shingle = i.shingle AND d.width = i.width
             JOIN sizes z ON z.id = i.id
        WHERE NOT d.item AND i.item
        GROUP BY d.place, d.id, i.id HAVING count(*) >= 0.8 * any_value(z.n) - 1e-9
    """,
    "op11_lexical": """
        WITH worded AS (
            SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t
            FROM documents WHERE text IS NOT NULL
        ), whole AS (SELECT count(*) AS big_n, sum(len(t))::BIGINT AS big_l FROM worded WHERE len(t) > 0),
        items AS (
            SELECT row_number() OVER () AS item, item_id, list_distinct(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t
            FROM benchmark WHERE text IS NOT NULL
        ), asked AS (SELECT item, item_id, unnest(t) AS term FROM items),
        postings AS (
            SELECT place, any_value(doc_id) AS doc_id, term, count(*) AS tf, any_value(n) AS n
            FROM (SELECT place, doc_id, len(t) AS n, unnest(t) AS term FROM worded)
            WHERE term IN (SELECT term FROM asked) GROUP BY place, term
        ), weighed AS (
            SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
            FROM postings, whole GROUP BY term
        ), parts AS (
            SELECT place, doc_id, term,
                   w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))) AS part
            FROM postings JOIN weighed USING (term), whole
        ), scored AS (
            SELECT item, any_value(item_id) AS item_id, any_value(doc_id) AS doc_id, sum(part)::BIGINT AS score
            FROM asked JOIN parts USING (term) GROUP BY item, place
        )
        SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank
        FROM scored WHERE score > 0 QUALIFY rank <= 10
    """,
    "op12_negatives": f"""
        WITH vectors AS ({WHOLE} AND label IS NOT NULL),
        named AS (SELECT place, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v FROM vectors),
        scored AS (
            SELECT a.place AS key, a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same,
                   list_dot_product(a.v, r.v)::BIGINT AS score
            FROM named a JOIN named r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
        ), positive AS (
            SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, id) AS no FROM scored WHERE same
            QUALIFY no <= 5
        )
        SELECT p.anchor_id, p.id AS positive_id,
               row_number() OVER (PARTITION BY p.key, p.no ORDER BY n.score DESC, n.id) AS rank,
               n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM positive p JOIN scored n ON n.key = p.key AND NOT n.same
             AND 80 * p.score <= 100 * n.score AND n.score <= p.score
        QUALIFY rank <= 5
    """,
    "op13_metric": f"""
        WITH vectors AS ({WHOLE})
        SELECT q.vec_id AS query_id, r.vec_id, list_dot_product(q.v, r.v)::BIGINT AS score,
               row_number() OVER (PARTITION BY q.place ORDER BY list_dot_product(q.v, r.v) DESC, r.vec_id) AS rank
        FROM vectors q JOIN vectors r ON q.vec_id <> r.vec_id
        WHERE q.vec_id % 50 = 0
        QUALIFY rank <= 5
    """,
}
