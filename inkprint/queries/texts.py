"""Sources and text maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkprint.functions import text as T
from inkprint.operators import vectorize as V
from inkprint.operators.common import by_doc
from inkprint.operators.texts import tag_strings, token_tag_strings, truncate_common
from inkprint.queries import corpus as C
from inkprint.queries.derived import TAGS_SQL, tags
from inkprint.sources import collection as S

QUERIES: dict[str, C.Query] = {}
ORACLES: dict[str, str] = {}


def src_train_test(spark, sf):
    d = C.docs(spark, sf)
    documents = d.select(
        "problem", "doc_name", "text",
        F.when(F.col("split") == "unknown", "unknown").otherwise(F.col("author")).alias("folder"),
    )
    info = C.candidates(d).withColumn("unknown_folder", F.lit("unknown"))
    return S.train_test(documents, info).select(
        "problem", "doc_name", "author", "split", F.md5("text").alias("digest")
    )


QUERIES["src_train_test"] = src_train_test
ORACLES["src_train_test"] = C.sql("""
SELECT problem, author || '/' || doc_name AS doc_name, author, split, md5(text) AS digest FROM known
UNION ALL SELECT problem, doc_name, NULL, split, md5(text) FROM unknown""")


def src_profiles(spark, sf):
    return V.profile_summary(C.known(C.docs(spark, sf)))


QUERIES["src_profiles"] = src_profiles
ORACLES["src_profiles"] = C.sql("""
SELECT problem, author, count(*) AS n_docs, CAST(length(string_agg(text, ' ')) AS BIGINT) AS n_chars
FROM known GROUP BY problem, author""")


def src_answers(spark, sf):
    d = C.docs(spark, sf)
    # The same text may be answered several times: copies share one document name here.
    answers = d.select(
        "problem", F.md5("text").alias("doc_name"), F.col("true_author").alias("predicted_author"),
        F.col("doc_name").cast("long").alias("pos"),
    )
    return S.first_answers(answers)


QUERIES["src_answers"] = src_answers
ORACLES["src_answers"] = C.sql("""
SELECT problem, md5(text) AS doc_name, arg_min(true_author, CAST(doc_name AS BIGINT)) AS predicted_author
FROM corpus GROUP BY problem, md5(text)""")


def src_slice(spark, sf):
    d = C.docs(spark, sf)
    # Rank the problems by name: at most one row per problem reaches the window.
    names = d.groupBy("problem", "language").agg(F.count("*").alias("n_docs"))
    idx = F.row_number().over(V.Window.orderBy("problem")) - 1
    return S.slice_problems(names.withColumn("idx", idx), 1, 3)


QUERIES["src_slice"] = src_slice
ORACLES["src_slice"] = C.sql("""
SELECT problem, problem AS language, n_docs, idx,
       CASE problem WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' WHEN 'sp' THEN 'spanish'
                    WHEN 'it' THEN 'italian' WHEN 'pl' THEN 'polish' ELSE problem END AS language_name
FROM (SELECT problem, count(*) AS n_docs, CAST(row_number() OVER (ORDER BY problem) - 1 AS INTEGER) AS idx
      FROM corpus GROUP BY problem)
WHERE idx >= 1 AND idx < 3""")


def corpus_summary(spark, sf):
    d = C.docs(spark, sf)
    used = C.known(d).unionByName(C.unknown(d))
    return S.corpus_summary(used, V.vocab_min_count(C.known(d), 3, 5))


QUERIES["corpus_summary"] = corpus_summary
ORACLES["corpus_summary"] = C.sql(
    C.char_counts_sql("grams", "known", [3], collapse=False, keys="problem"), """
SELECT k.problem, n_candidates, n_known, n_unknown, n_vocabulary
FROM (SELECT problem, count(DISTINCT author) AS n_candidates, count(*) AS n_known FROM known GROUP BY problem) k
JOIN (SELECT problem, count(*) AS n_unknown FROM unknown GROUP BY problem) u USING (problem)
JOIN (SELECT problem, count(*) AS n_vocabulary FROM grams WHERE tf >= 5 GROUP BY problem) v USING (problem)""")


# -- n-grams and tokens ------------------------------------------------------------


def char_ngrams(spark, sf):
    counts = V.represent_text(C.docs(spark, sf), 3)
    return counts.groupBy("problem", "term").agg(
        F.sum("tf").alias("n"), F.count("*").alias("n_docs")
    )


QUERIES["char_ngrams"] = char_ngrams
ORACLES["char_ngrams"] = C.sql(C.char_counts_sql("grams", "corpus", [3], collapse=False), """
SELECT problem, term, CAST(sum(tf) AS BIGINT) AS n, count(*) AS n_docs FROM grams GROUP BY ALL""")


def char_ngram_range(spark, sf):
    return V.count_totals(by_doc(C.docs(spark, sf)), V.chars(3, 5))


QUERIES["char_ngram_range"] = char_ngram_range
ORACLES["char_ngram_range"] = C.sql(
    C.char_counts_sql("grams", "corpus", [3, 4, 5]), C.count_summary_sql("grams", "problem, doc_name"))


def _tokens(tokenize):
    def run(spark, sf):
        d = T.computed_once(C.docs(spark, sf), "tokens", tokenize(F.col("text")))
        return d.select(
            "problem", "doc_name", F.size("tokens").cast("long").alias("n_tokens"),
            F.md5(F.array_join("tokens", "|")).alias("digest"),
        )

    return run


def _tokens_sql(pattern):
    return C.sql(f"""
SELECT problem, doc_name, len(t) AS n_tokens, md5(coalesce(array_to_string(t, '|'), '')) AS digest
FROM (SELECT problem, doc_name, regexp_extract_all(text, '{pattern}') AS t FROM corpus)""")


for name, tokenize, pattern in (
    ("word_tokens", T.word_tokens, C.WORD_SQL),
    ("wordpunct_tokens", T.wordpunct_tokens, C.WORDPUNCT_SQL),
    ("default_tokens", T.default_tokens, C.DEFAULT_SQL),
):
    QUERIES[name] = _tokens(tokenize)
    ORACLES[name] = _tokens_sql(pattern)


def word_ngram_range(spark, sf):
    return C.count_summary(V.term_counts(by_doc(C.docs(spark, sf)), V.words(1, 3)), *V.DOC)


QUERIES["word_ngram_range"] = word_ngram_range
ORACLES["word_ngram_range"] = C.sql(
    C.word_counts_sql("grams", "corpus", 1, 3), C.count_summary_sql("grams", "problem, doc_name"))


def distort(spark, sf):
    masked = T.distort(F.col("text"))
    return C.docs(spark, sf).select(
        "problem", "doc_name", F.length(masked).cast("long").alias("n_chars"),
        F.md5(masked).alias("digest"),
    )


MASK_SQL = "regexp_replace(replace(replace(text, chr(10), ' '), '  ', ' '), '[1-9A-Za-z]', '*', 'g')"
QUERIES["distort"] = distort
ORACLES["distort"] = C.sql(f"""
SELECT problem, doc_name, length(m) AS n_chars, md5(m) AS digest
FROM (SELECT problem, doc_name, {MASK_SQL} AS m FROM corpus)""")


def skip_bigrams(spark, sf):
    d = T.computed_once(C.docs(spark, sf), "tokens", T.word_tokens(F.col("text")))
    d = T.computed_once(d, "pairs", T.skip_bigrams(F.col("tokens"), 2))
    return d.select("problem", "doc_name", F.size("pairs").cast("long").alias("n_pairs"),
                    F.md5(F.array_join("pairs", " ")).alias("digest"))


QUERIES["skip_bigrams"] = skip_bigrams
ORACLES["skip_bigrams"] = C.sql(rf"""
SELECT problem, doc_name, CAST(greatest(len(t) - 2, 0) AS BIGINT) AS n_pairs,
       md5(coalesce((SELECT string_agg(t[i] || '_' || t[i + 2], ' ' ORDER BY i)
                     FROM (SELECT unnest(range(1, len(t) - 1)) AS i)), '')) AS digest
FROM (SELECT problem, doc_name, regexp_extract_all(text, '{C.WORD_SQL}') AS t FROM corpus)""")


def truncate_common_query(spark, sf):
    d = C.docs(spark, sf)
    used = C.known(d).unionByName(C.unknown(d))
    return truncate_common(used, "split").select(
        "problem", "split", "doc_name", F.length("text").cast("long").alias("n_chars"),
        F.md5("text").alias("digest"),
    )


ORDINAL_SQL = "CAST('0x' || substr(md5(doc_name), 1, 6) AS INTEGER) % 256, doc_name"
QUERIES["truncate_common"] = truncate_common_query
ORACLES["truncate_common"] = C.sql("used AS (SELECT * FROM known UNION ALL SELECT * FROM unknown)",
f"""numbered AS (
  SELECT *, row_number() OVER (PARTITION BY problem, split ORDER BY {ORDINAL_SQL}) AS rn FROM used)""",
"""sizes AS (
  SELECT problem, min(n) AS k FROM (SELECT problem, split, count(*) AS n FROM used GROUP BY ALL)
  GROUP BY problem)""",
"""cuts AS (
  SELECT problem, split, min(length(text)) AS cut FROM numbered JOIN sizes USING (problem)
  WHERE rn <= k GROUP BY ALL)""",
"""SELECT problem, split, doc_name, length(left(text, cut)) AS n_chars, md5(left(text, cut)) AS digest
FROM used JOIN cuts USING (problem, split)""")


def sentences(spark, sf):
    d = T.computed_once(C.docs(spark, sf), "parts", T.sentences(F.col("text")))
    return d.select("problem", "doc_name", F.size("parts").cast("long").alias("n_sentences"),
                    F.md5(F.array_join("parts", "|")).alias("digest"))


QUERIES["sentences"] = sentences
ORACLES["sentences"] = C.sql(rf"""
SELECT problem, doc_name, count(s) FILTER (regexp_matches(s, '{T.NONSPACE}')) AS n_sentences,
       md5(coalesce(string_agg(s, '|' ORDER BY i) FILTER (regexp_matches(s, '{T.NONSPACE}')), '')) AS digest
FROM (SELECT problem, doc_name, unnest(p) AS s, generate_subscripts(p, 1) AS i
      FROM (SELECT problem, doc_name,
                   string_split(regexp_replace(text, '{T.SENTENCE_END}', '\1' || chr(1), 'g'), chr(1)) AS p
            FROM corpus))
GROUP BY problem, doc_name""")


def pos_strings(spark, sf):
    return tag_strings(tags(C.docs(spark, sf))).select(
        "problem", "doc_name", F.length("text").cast("long").alias("n_chars"),
        F.md5("text").alias("digest"))


QUERIES["pos_strings"] = pos_strings
ORACLES["pos_strings"] = C.sql(TAGS_SQL, """
SELECT problem, doc_name, length(t) AS n_chars, md5(t) AS digest
FROM (SELECT problem, doc_name, string_agg(tag, ' ' ORDER BY pos) AS t FROM tags GROUP BY ALL)""")


def pos_token_strings(spark, sf):
    return token_tag_strings(tags(C.docs(spark, sf))).select(
        "problem", "doc_name", F.length("text").cast("long").alias("n_chars"),
        F.md5("text").alias("digest"))


QUERIES["pos_token_strings"] = pos_token_strings
ORACLES["pos_token_strings"] = C.sql(TAGS_SQL, """
SELECT problem, doc_name, length(t) AS n_chars, md5(t) AS digest
FROM (SELECT problem, doc_name, string_agg(token || '/' || tag, ' ' ORDER BY pos) AS t FROM tags GROUP BY ALL)""")
