"""Stylometric measures and compression distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkprint.functions import text as T
from inkprint.operators import compression as K
from inkprint.operators import stylometry as S
from inkprint.operators import vectorize as V
from inkprint.queries import corpus as C
from inkprint.queries.decisions import rounded
from inkprint.queries.derived import TAGS_SQL, tags
from inkprint.queries.features import USED_SQL, used

QUERIES: dict[str, C.Query] = {}
ORACLES: dict[str, str] = {}

# A lexicon of frequent short words in the corpus languages (a parameter of the operator).
WORDS = ["the", "of", "and", "in", "is", "that", "by", "it", "for", "with", "le", "la", "un", "des",
         "que", "der", "die", "und", "den", "el", "los", "para", "con", "es"]


def values(items):
    return ", ".join(f"('{i}')" for i in items)


QUERIES["function_word_freq"] = lambda spark, sf: rounded(
    S.function_word_freq(C.docs(spark, sf), WORDS), "share")
ORACLES["function_word_freq"] = C.sql(
    f"""counted AS (
  SELECT problem, doc_name, word, (length(text) - length(replace(text, word, ''))) // length(word) AS n
  FROM corpus, (VALUES {values(WORDS)}) AS w(word))""", """
SELECT problem, doc_name, word, n, round(CASE WHEN total > 0 THEN n::DOUBLE / total END, 6) AS share
FROM (SELECT *, sum(n) OVER (PARTITION BY problem, doc_name) AS total FROM counted)""")

WORDS_SQL = f"""words AS (
  SELECT problem, doc_name, word, count(*) AS f
  FROM (SELECT problem, doc_name, unnest(regexp_extract_all(lower(text), '{C.WORD_SQL}')) AS word FROM corpus)
  GROUP BY ALL)"""
RICHNESS_SQL = """richness AS (
  SELECT problem, doc_name, n AS n_words, v AS n_vocabulary, v / n::DOUBLE AS type_ratio,
         CASE WHEN n > 2 THEN log2(v) / log2(log2(n)) END AS log_ratio,
         1e4::DOUBLE * (s / (n * n)::DOUBLE - 1 / n::DOUBLE) AS yule_k,
         1e4::DOUBLE * (s / (n * n)::DOUBLE - n) / (n * n)::DOUBLE AS yule_k_words
  FROM (SELECT problem, doc_name, CAST(sum(f) AS BIGINT) AS n, count(*) AS v, CAST(sum(f * f) AS BIGINT) AS s
        FROM words GROUP BY ALL))"""
QUERIES["frequency_spectrum"] = lambda spark, sf: S.frequency_spectrum(C.docs(spark, sf))
ORACLES["frequency_spectrum"] = C.sql(
    WORDS_SQL, "SELECT problem, doc_name, f, count(*) AS v FROM words GROUP BY ALL")
RICH = ("type_ratio", "log_ratio", "yule_k", "yule_k_words")
QUERIES["lexical_richness"] = lambda spark, sf: rounded(S.lexical_richness(C.docs(spark, sf)), *RICH)
ORACLES["lexical_richness"] = C.sql(WORDS_SQL, RICHNESS_SQL, """
SELECT problem, doc_name, n_words, n_vocabulary, round(type_ratio, 6) AS type_ratio, round(log_ratio, 6) AS log_ratio,
       round(yule_k, 6) AS yule_k, round(yule_k_words, 6) AS yule_k_words FROM richness""")

LENGTH_SQL = f"""word_length AS (
  SELECT problem, doc_name, CASE WHEN len(w) > 0 THEN length(array_to_string(w, ''))::DOUBLE / len(w) END AS mean_word_length
  FROM (SELECT problem, doc_name, regexp_extract_all(text, '{C.WORD_SQL}') AS w FROM corpus))"""
QUERIES["mean_word_length"] = lambda spark, sf: rounded(
    S.mean_word_length(C.docs(spark, sf)), "mean_word_length")
ORACLES["mean_word_length"] = C.sql(
    LENGTH_SQL, "SELECT problem, doc_name, round(mean_word_length, 6) AS mean_word_length FROM word_length")

SENTENCES_SQL = rf"""pieces AS (
  SELECT problem, doc_name, s
  FROM (SELECT problem, doc_name,
               unnest(string_split(regexp_replace(text, '{T.SENTENCE_END}', '\1' || chr(1), 'g'), chr(1))) AS s
        FROM corpus) WHERE regexp_matches(s, '{T.NONSPACE}'))"""
MEASURES_SQL = [
    SENTENCES_SQL,
    f"""measures AS (
  SELECT problem, doc_name, split, m AS words_per_sentence, sd AS sentence_spread,
         len(list_distinct(w)) / len(w)::DOUBLE AS type_ratio,
         (length(text) - length(replace(text, ',', '')))::DOUBLE / n AS commas,
         (length(text) - length(replace(text, ';', '')))::DOUBLE / n AS semicolons,
         (length(text) - length(replace(text, ':', '')))::DOUBLE / n AS colons
  FROM (SELECT *, regexp_extract_all(lower(text), '{C.WORDPUNCT_SQL}') AS w FROM corpus)
  JOIN (SELECT problem, doc_name, count(*) AS n, avg(k) AS m, stddev_pop(k) AS sd
        FROM (SELECT problem, doc_name, len(regexp_extract_all(s, '{C.WORDPUNCT_SQL}')) AS k FROM pieces)
        GROUP BY ALL) USING (problem, doc_name))""",
    "whitened AS (SELECT problem, doc_name, split, " + ", ".join(
        f"""{c} / CASE WHEN stddev_pop({c}) OVER grp > 0 THEN stddev_pop({c}) OVER grp ELSE 1 END AS {c}"""
        for c in S.LEXICAL) + " FROM measures WINDOW grp AS (PARTITION BY problem, split))",
]


def _rounded_sql(columns):
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


QUERIES["lexical_features"] = lambda spark, sf: rounded(S.lexical_features(C.docs(spark, sf)), *S.LEXICAL)
ORACLES["lexical_features"] = C.sql(
    *MEASURES_SQL, f"SELECT problem, doc_name, split, {_rounded_sql(S.LEXICAL)} FROM whitened")


def whiten(spark, sf):
    """Whitening of document length and word count."""
    d = C.docs(spark, sf)
    wide = d.select(
        "problem", "split", "doc_name", F.length("text").cast("double").alias("n_chars"),
        F.size(T.word_tokens(F.col("text"))).cast("double").alias("n_words"))
    return rounded(V.whiten(wide, ["n_chars", "n_words"], ["problem", "split"]), "n_chars", "n_words")


QUERIES["whiten"] = whiten
ORACLES["whiten"] = C.sql(f"""
SELECT problem, split, doc_name, round(c / CASE WHEN stddev_pop(c) OVER grp > 0 THEN stddev_pop(c) OVER grp ELSE 1 END, 6) AS n_chars,
       round(w / CASE WHEN stddev_pop(w) OVER grp > 0 THEN stddev_pop(w) OVER grp ELSE 1 END, 6) AS n_words
FROM (SELECT problem, split, doc_name, length(text)::DOUBLE AS c,
             len(regexp_extract_all(text, '{C.WORD_SQL}'))::DOUBLE AS w FROM corpus)
WINDOW grp AS (PARTITION BY problem, split)""")

QUERIES["char_class_freq"] = lambda spark, sf: rounded(S.char_class_freq(C.docs(spark, sf)), "per_sentence")
ORACLES["char_class_freq"] = C.sql(
    SENTENCES_SQL, C.char_counts_sql("chars", "corpus", [1], collapse=False), r"""
SELECT problem, doc_name, term AS mark, tf AS n, round(tf::DOUBLE / k, 6) AS per_sentence
FROM chars JOIN (SELECT problem, doc_name, count(*) AS k FROM pieces GROUP BY ALL) USING (problem, doc_name)
WHERE regexp_matches(term, '^[!-/:-@\[-`{-~a-zA-Z]$')""")

TAG_COLUMNS = ["CD", "NN", "NNS", "NNP", "RB", "SYM", "VB"]


def pos_counts(spark, sf):
    t = tags(C.docs(spark, sf))
    nouns = S.pos_group_counts(t, {"nouns": ["NN", "NNS", "NNP", "NNPS"]})
    return S.pos_counts(t).join(nouns, V.DOC)


QUERIES["pos_counts"] = pos_counts
ORACLES["pos_counts"] = C.sql(TAGS_SQL, "SELECT problem, doc_name, " + ", ".join(
    f"""count(*) FILTER (tag = '{t}') AS "{t}\"""" for t in S.PENN_TAGS) + """,
  count(*) FILTER (tag IN ('NN', 'NNS', 'NNP', 'NNPS')) AS nouns FROM tags GROUP BY problem, doc_name""")


def spelling_variants(spark, sf):
    """Word pairs of the corpus itself: a word ending in -er against the same word ending in -re."""
    d = C.docs(spark, sf)
    words = d.select(F.explode(T.word_tokens(F.col("text"))).alias("w")).distinct()
    american = words.where(F.col("w").endswith("er")).select(
        F.col("w").alias("american"), F.regexp_replace("w", "er$", "re").alias("british"))
    pairs = american.join(words.withColumnRenamed("w", "british"), "british").select("british", "american")
    return S.spelling_variants(d, pairs).withColumn(
        "british", F.array_join("british", " ")).withColumn("american", F.array_join("american", " "))


QUERIES["spelling_variants"] = spelling_variants
ORACLES["spelling_variants"] = C.sql(
    f"""tokens AS (
  SELECT DISTINCT problem, doc_name, w
  FROM (SELECT problem, doc_name, unnest(regexp_extract_all(text, '{C.WORD_SQL}')) AS w FROM corpus))""",
    """pairs AS (
  SELECT a.w AS american, b.w AS british FROM (SELECT DISTINCT w FROM tokens WHERE ends_with(w, 'er')) a
  JOIN (SELECT DISTINCT w FROM tokens) b ON b.w = left(a.w, length(a.w) - 2) || 're')""", """
SELECT problem, doc_name, CAST(coalesce(nb, 0) AS INTEGER) AS n_british, CAST(coalesce(na, 0) AS INTEGER) AS n_american,
       coalesce(b, '') AS british, coalesce(a, '') AS american
FROM corpus
LEFT JOIN (SELECT problem, doc_name, count(*) AS nb, string_agg(w, ' ' ORDER BY w) AS b
           FROM tokens WHERE w IN (SELECT british FROM pairs) GROUP BY ALL) USING (problem, doc_name)
LEFT JOIN (SELECT problem, doc_name, count(*) AS na, string_agg(w, ' ' ORDER BY w) AS a
           FROM tokens WHERE w IN (SELECT american FROM pairs) GROUP BY ALL) USING (problem, doc_name)""")


def stylometric_assemble(spark, sf):
    wide = S.stylometric_assemble(C.docs(spark, sf))
    columns = ["mean_word_length", "word_type_ratio", *RICH[1:], *S.LEXICAL]
    return rounded(wide, *columns)


QUERIES["stylometric_assemble"] = stylometric_assemble
ORACLES["stylometric_assemble"] = C.sql(
    WORDS_SQL, RICHNESS_SQL, LENGTH_SQL, *MEASURES_SQL, f"""
SELECT problem, doc_name, split, round(mean_word_length, 6) AS mean_word_length, n_words, n_vocabulary,
       round(r.type_ratio, 6) AS word_type_ratio, {_rounded_sql(RICH[1:])},
       {_rounded_sql(c for c in S.LEXICAL if c != 'type_ratio')}, round(w.type_ratio, 6) AS type_ratio
FROM corpus LEFT JOIN word_length USING (problem, doc_name) LEFT JOIN richness r USING (problem, doc_name)
LEFT JOIN (SELECT * EXCLUDE (split) FROM whitened) w USING (problem, doc_name)""")


# -- compression ----------------------------------------------------------------------


def compressed_size(spark, sf):
    text = F.col("text")
    return C.docs(spark, sf).select(
        "problem", "doc_name", *[K.compressed_size(text, a).alias(a) for a in ("zlib", "bz2", "lzma")])


QUERIES["compressed_size"] = compressed_size


def pair_compressed_size(spark, sf):
    d = used(spark, sf)
    return K.pair_compressed_size(d, K.profile_sizes(C.known(d)))


QUERIES["pair_compressed_size"] = pair_compressed_size


def compression_features(spark, sf):
    d = used(spark, sf)
    return rounded(K.compression_features(d, C.known(d)), "cbc", "ncd")


QUERIES["compression_features"] = compression_features


def _document_sizes(spark, sf):
    """Sizes that SQL can check: characters of profile, document and both."""
    d = used(spark, sf)
    x = V.profile_summary(C.known(d)).select("problem", "author", F.col("n_chars").alias("x"))
    return d.select("problem", "doc_name", F.length("text").alias("y")).join(x, "problem").withColumn(
        "xy", F.col("x") + F.floor(F.col("y") / 2))


for name, function, formula in (
    ("cbc", K.cbc, "1 - (x + y - xy) / sqrt(x * y)"),
    ("ncd", K.ncd, "(xy - least(x, y))::DOUBLE / greatest(x, y)"),
):
    def run(spark, sf, name=name, function=function):
        sizes = _document_sizes(spark, sf)
        value = function(F.col("x"), F.col("y"), F.col("xy"))
        return sizes.select("problem", "doc_name", "author", F.round(value, 6).alias(name))

    QUERIES[name] = run
    ORACLES[name] = C.sql(USED_SQL, f"""
SELECT problem, doc_name, author, round({formula}, 6) AS {name}
FROM (SELECT problem, doc_name, p.author, x, length(text) AS y, x + length(text) // 2 AS xy
      FROM used JOIN (SELECT problem, author, CAST(length(string_agg(text, ' ')) AS BIGINT) AS x FROM known
                      GROUP BY ALL) p USING (problem))""")
