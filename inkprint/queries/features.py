"""Vocabularies, TF-IDF families and feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkprint.functions import text as T
from inkprint.operators import vectorize as V
from inkprint.operators.common import by_doc
from inkprint.operators.texts import english_stem_table, stem_tokens, tag_strings
from inkprint.queries import corpus as C
from inkprint.queries.derived import STEM_SQL, TAGS_SQL, stems, tags
from inkprint.queries.texts import MASK_SQL, ORDINAL_SQL
from inkprint.session import materialize

QUERIES: dict[str, C.Query] = {}
ORACLES: dict[str, str] = {}

USED_SQL = "used AS (SELECT * FROM known UNION ALL SELECT * FROM unknown)"
PROFILES_SQL = f"""profiles AS (
  SELECT problem, author, string_agg(text, ' ' ORDER BY {ORDINAL_SQL}) AS text
  FROM known GROUP BY problem, author)"""
PROFILE_KEYS = "problem, author"


def used(spark, sf):
    """Known texts of candidates and all unknown texts."""
    d = C.docs(spark, sf)
    return C.known(d).unionByName(C.unknown(d))


def vocab_min_count(spark, sf):
    return V.vocab_min_count(C.known(C.docs(spark, sf)), 3, 5)


QUERIES["vocab_min_count"] = vocab_min_count
ORACLES["vocab_min_count"] = C.sql(
    C.char_counts_sql("grams", "known", [3], collapse=False, keys="problem"),
    "SELECT problem, term, tf AS n FROM grams WHERE tf >= 5")


def count_by_length(spark, sf):
    vocab = V.vocab_min_count(C.known(C.docs(spark, sf)), 3, 5)
    return C.value_summary(V.count_by_length(used(spark, sf), vocab, [3]), "problem", "term").drop(
        "first_term", "last_term")


QUERIES["count_by_length"] = count_by_length
ORACLES["count_by_length"] = C.sql(
    USED_SQL,
    C.char_counts_sql("vocab", "known", [3], collapse=False, keys="problem"),
    C.char_counts_sql("grams", "(SELECT *, length(text) AS len FROM used)", [3],
                      keys="problem, doc_name, len"),
    """counted AS (
  SELECT problem, doc_name, term, g.tf::DOUBLE / len AS value FROM grams g
  JOIN (SELECT problem, term FROM vocab WHERE tf >= 5) USING (problem, term))""",
    """SELECT problem, term, count(*) AS n_terms, round(sum(value), 6) AS sum_value,
  round(max(value), 6) AS max_value, round(sum(value * length(term)), 6) AS sum_by_length
FROM counted GROUP BY problem, term""")


def tfidf_fit(spark, sf):
    fitted = V.fit_tfidf(C.known(C.docs(spark, sf)), V.chars(3, 5), 0.12)
    return fitted.table.select("problem", "term", "df", "n_docs", F.round("idf", 6).alias("idf"))


QUERIES["tfidf_fit"] = tfidf_fit
ORACLES["tfidf_fit"] = C.sql(
    C.char_counts_sql("grams", "known", [3, 4, 5]), C.idf_sql("idf", "grams", "known", 0.12),
    "SELECT problem, term, df, n_docs, round(idf, 6) AS idf FROM idf")


def _instance(analyzer, min_df, prepare=None, sublinear=True):
    """Fit on the known documents, weight known and unknown ones."""
    def run(spark, sf):
        d = used(spark, sf) if prepare is None else prepare(spark, sf)
        fitted = V.fit_tfidf(C.known(d), analyzer, min_df, sublinear)
        return C.value_summary(fitted.transform(d), *V.DOC)

    return run


def _instance_sql(min_df, *ctes):
    """The last CTEs define ``grams`` over ``used`` and ``train`` over the known documents."""
    return C.sql(
        USED_SQL, *ctes,
        """train AS (SELECT g.* FROM grams g SEMI JOIN known USING (problem, doc_name))""",
        C.idf_sql("idf", "train", "known", min_df), C.tfidf_sql("weights", "grams", "idf"),
        C.value_summary_sql("weights", "problem, doc_name"))


QUERIES["tfidf_transform"] = _instance(V.chars(2, 3), 0.12)
ORACLES["tfidf_transform"] = _instance_sql(0.12, C.char_counts_sql("grams", "used", [2, 3]))

QUERIES["instance_char_tfidf"] = _instance(V.chars(3, 5), 0.12)
ORACLES["instance_char_tfidf"] = _instance_sql(0.12, C.char_counts_sql("grams", "used", [3, 4, 5]))

QUERIES["instance_pos_tfidf"] = _instance(
    V.chars(4, 5), 0.12, lambda spark, sf: _tagged(spark, sf))
ORACLES["instance_pos_tfidf"] = _instance_sql(
    0.12, TAGS_SQL,
    """tagged AS (SELECT problem, doc_name, string_agg(tag, ' ' ORDER BY pos) AS text
  FROM tags SEMI JOIN used USING (problem, doc_name) GROUP BY ALL)""",
    C.char_counts_sql("grams", "tagged", [4, 5]))


def _tagged(spark, sf):
    d = used(spark, sf)
    return materialize(d.drop("text").join(tag_strings(tags(d)), V.DOC))


def instance_dist_tfidf(spark, sf):
    """Masked texts; the n-gram range depends on the language of the problem."""
    d = used(spark, sf)
    english = F.col("language") == "en"
    parts = []
    for rows, low, high in ((english, 2, 6), (~english, 1, 8)):
        part = d.where(rows)
        fitted = V.fit_tfidf(C.known(part), V.chars(low, high, T.distort), 0.12)
        parts.append(fitted.transform(part))
    return C.value_summary(parts[0].unionByName(parts[1]), *V.DOC)


QUERIES["instance_dist_tfidf"] = instance_dist_tfidf
ORACLES["instance_dist_tfidf"] = _instance_sql(
    0.12, f"masked AS (SELECT problem, doc_name, {MASK_SQL} AS text FROM used)",
    C.char_counts_sql("g_en", "(SELECT * FROM masked WHERE problem = 'en')", [2, 3, 4, 5, 6]),
    C.char_counts_sql("g_other", "(SELECT * FROM masked WHERE problem <> 'en')", list(range(1, 9))),
    "grams AS (SELECT * FROM g_en UNION ALL SELECT * FROM g_other)")

QUERIES["instance_word_tfidf"] = _instance(
    V.words(1, 3, T.default_tokens), 0.03,
    lambda spark, sf: materialize(stem_tokens(used(spark, sf), stems(used(spark, sf)))))
ORACLES["instance_word_tfidf"] = _instance_sql(
    0.03, STEM_SQL.format(source="used"),
    C.word_counts_sql("grams", "stemmed", 1, 3, C.DEFAULT_SQL))


def stem_tokens_query(spark, sf):
    d = C.docs(spark, sf)
    return stem_tokens(d, stems(d)).select("problem", "doc_name", F.md5("text").alias("digest"))


QUERIES["stem_tokens"] = stem_tokens_query
ORACLES["stem_tokens"] = C.sql(
    STEM_SQL.format(source="corpus"), "SELECT problem, doc_name, md5(text) AS digest FROM stemmed")


def stem_tokens_english(spark, sf):
    """Snowball stems for the English documents; the others keep their tokens."""
    d = C.docs(spark, sf)
    return stem_tokens(d, english_stem_table(d, "en")).select(
        "problem", "doc_name", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


QUERIES["stem_tokens_english"] = stem_tokens_english


def vocab_top_k(spark, sf):
    return V.vocab_top_k(C.known(C.docs(spark, sf)), 4, 10_000).select(
        "problem", "term", "rank", "cf", F.round("idf", 6).alias("idf"))


TOP_K_SQL = """best AS (
  SELECT problem, term, idf, cf, row_number() OVER (PARTITION BY problem ORDER BY cf DESC, term) AS rank
  FROM idf QUALIFY rank <= 10000)"""
QUERIES["vocab_top_k"] = vocab_top_k
ORACLES["vocab_top_k"] = C.sql(
    C.char_counts_sql("grams", "known", [4], text="lower(text)"),
    C.idf_sql("idf", "grams", "known", 0.0), TOP_K_SQL,
    "SELECT problem, term, rank, CAST(cf AS BIGINT) AS cf, round(idf, 6) AS idf FROM best")


# -- profiles --------------------------------------------------------------------


def _profile(fit):
    """Two result parts: the weighted profiles and the weighted documents."""
    def run(spark, sf):
        d = used(spark, sf)
        fitted = fit(C.known(d))
        profiles = fitted.profiles().select(
            "problem", F.concat(F.lit("profile "), "author").alias("doc_name"), "term", "value")
        return C.value_summary(profiles.unionByName(fitted.transform(d)), *V.DOC)

    return run


def _profile_sql(min_df, *ctes):
    return C.sql(
        USED_SQL, PROFILES_SQL, *ctes,
        C.idf_sql("idf", "profile_grams", "profiles", min_df),
        C.tfidf_sql("profile_weights", "profile_grams", "idf", key="author"),
        C.tfidf_sql("weights", "grams", "idf"),
        """everything AS (
  SELECT problem, 'profile ' || author AS doc_name, term, value FROM profile_weights
  UNION ALL SELECT problem, doc_name, term, value FROM weights)""",
        C.value_summary_sql("everything", "problem, doc_name"))


QUERIES["profile_char_tfidf"] = _profile(lambda known: V.fit_profile_chars(known, 3, 5))
ORACLES["profile_char_tfidf"] = _profile_sql(
    0.12, C.char_counts_sql("profile_grams", "profiles", [3, 4, 5], keys=PROFILE_KEYS),
    C.char_counts_sql("grams", "used", [3, 4, 5]))

QUERIES["profile_word_tfidf"] = _profile(V.fit_profile_words)
ORACLES["profile_word_tfidf"] = _profile_sql(
    0.03, C.word_counts_sql("profile_grams", "profiles", 1, 3, keys=PROFILE_KEYS),
    C.word_counts_sql("grams", "used", 1, 3))

# The mask works on single texts; here it is applied before the texts are joined.
QUERIES["profile_dist_tfidf"] = _profile(
    lambda known: V.fit_profile_chars(known, 2, 6, text_map=T.distort))
ORACLES["profile_dist_tfidf"] = _profile_sql(
    0.12, f"masked AS (SELECT problem, doc_name, author, {MASK_SQL} AS text FROM used)",
    f"""masked_profiles AS (
  SELECT problem, author, string_agg(text, ' ' ORDER BY {ORDINAL_SQL}) AS text
  FROM masked SEMI JOIN known USING (problem, doc_name) GROUP BY problem, author)""",
    C.char_counts_sql("profile_grams", "masked_profiles", list(range(2, 7)), keys=PROFILE_KEYS),
    C.char_counts_sql("grams", "masked", list(range(2, 7))))


# -- feature tables ----------------------------------------------------------------


def _blocks(spark, sf):
    d = used(spark, sf)
    one = V.fit_tfidf(C.known(d), V.words(1, 1), 0.03).transform(d)
    two = V.fit_tfidf(C.known(d), V.words(2, 2), 0.03).transform(d)
    return d, V.hstack({"w1": one, "w2": two})


BLOCKS_SQL = [
    USED_SQL,
    C.word_counts_sql("g1", "used", 1, 1), C.word_counts_sql("g2", "used", 2, 2),
    "t1 AS (SELECT g1.* FROM g1 SEMI JOIN known USING (problem, doc_name))",
    "t2 AS (SELECT g2.* FROM g2 SEMI JOIN known USING (problem, doc_name))",
    C.idf_sql("i1", "t1", "known", 0.03), C.idf_sql("i2", "t2", "known", 0.03),
    C.tfidf_sql("v1", "g1", "i1"), C.tfidf_sql("v2", "g2", "i2"),
    """stacked AS (
  SELECT problem, doc_name, 'w1:' || term AS term, value FROM v1
  UNION ALL SELECT problem, doc_name, 'w2:' || term, value FROM v2)""",
]


def hstack(spark, sf):
    return C.value_summary(_blocks(spark, sf)[1], *V.DOC)


QUERIES["hstack"] = hstack
ORACLES["hstack"] = C.sql(*BLOCKS_SQL, C.value_summary_sql("stacked", "problem, doc_name"))


def max_abs_scale(spark, sf):
    d, features = _blocks(spark, sf)
    keys = C.known(d).select(*V.DOC)
    return C.value_summary(V.max_abs_scale(features, features.join(keys, V.DOC, "left_semi")), *V.DOC)


QUERIES["max_abs_scale"] = max_abs_scale
ORACLES["max_abs_scale"] = C.sql(
    *BLOCKS_SQL,
    """scaled AS (
  SELECT problem, doc_name, term, value / CASE WHEN m > 0 THEN m ELSE 1 END AS value FROM stacked
  LEFT JOIN (SELECT problem, term, max(abs(value)) AS m FROM stacked SEMI JOIN known USING (problem, doc_name)
             GROUP BY ALL) USING (problem, term))""",
    C.value_summary_sql("scaled", "problem, doc_name"))


def chi2_select(spark, sf):
    d = C.known(C.docs(spark, sf))
    features = V.fit_tfidf(d, V.words(1, 1), 0.03).transform(d)
    return V.chi2_select(features, d.select(*V.DOC, "author"), 200).select(
        "problem", "term", "rank", "chi2")


QUERIES["chi2_select"] = chi2_select
ORACLES["chi2_select"] = C.sql(
    C.word_counts_sql("grams", "known", 1, 1), C.idf_sql("idf", "grams", "known", 0.03),
    C.tfidf_sql("weights", "grams", "idf"),
    """observed AS (
  SELECT problem, author, term, sum(value) AS o
  FROM weights JOIN (SELECT problem, doc_name, author FROM known) USING (problem, doc_name) GROUP BY ALL)""",
    """classes AS (SELECT problem, author, count(*)::DOUBLE AS nc,
  sum(count(*)) OVER (PARTITION BY problem)::DOUBLE AS n FROM known GROUP BY problem, author)""",
    """expected AS (
  SELECT t.problem, c.author, t.term, nc / n * total AS e
  FROM (SELECT problem, term, sum(o) AS total FROM observed GROUP BY ALL) t JOIN classes c USING (problem))""",
    """scores AS (
  SELECT problem, term, round(sum((coalesce(o, 0) - e) * (coalesce(o, 0) - e) / e), 6) AS chi2
  FROM expected LEFT JOIN observed USING (problem, author, term) GROUP BY ALL)""",
    """SELECT problem, term, chi2, row_number() OVER (PARTITION BY problem ORDER BY chi2 DESC, term) AS rank
FROM scores QUALIFY rank <= 200""")
