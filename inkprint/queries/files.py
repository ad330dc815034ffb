"""Readers, run on file contents that Spark derives from the tables.

Each query builds (path, value) or (value) rows in the documented file formats, row by row,
and parses them. Reading real folders is covered by the tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from inkprint.functions.phonetics import PHONES
from inkprint.functions import text as T
from inkprint.queries import corpus as C
from inkprint.queries.derived import CMU_SQL, pronunciations
from inkprint.sources import collection as S

QUERIES: dict[str, C.Query] = {}
ORACLES: dict[str, str] = {}


def _file(df, path, value):
    """A file per row; path parts are quoted as in a listing."""
    parts = [F.lit(p) if isinstance(p, str) else
             F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")) for p in path]
    return df.select(F.concat_ws("/", F.lit("file:/collection"), *parts).alias("path"),
                     value.alias("value"))


def _object(**fields):
    return F.struct(*[F.col(c).alias(name.replace("_", "-")) for name, c in fields.items()])


def src_collection(spark, sf):
    """One description per source: its documents as problems."""
    d = C.docs(spark, sf)
    entry = F.to_json(F.array(_object(problem_name="doc_name", language="language")))
    return S.parse_collection(_file(d, [F.col("author"), S.COLLECTION_FILE], entry))


QUERIES["src_collection"] = src_collection
ORACLES["src_collection"] = C.sql(
    "SELECT 0 AS idx, doc_name AS problem, problem AS language FROM corpus")


def src_problem_info(spark, sf):
    """One description per document, with its author and the two neighbouring names."""
    d = C.docs(spark, sf).select(
        "problem", "doc_name", "author", F.concat("author", F.lit("b")).alias("second"))
    info = F.to_json(F.struct(
        F.concat(F.lit("unknown-"), "doc_name").alias("unknown-folder"),
        F.array(_object(author_name="author"), _object(author_name="second")).alias("candidate-authors")))
    return S.parse_problem_info(_file(d, [F.concat("problem", F.lit(" "), "doc_name"), S.PROBLEM_FILE], info))


QUERIES["src_problem_info"] = src_problem_info
ORACLES["src_problem_info"] = C.sql("""
SELECT problem || ' ' || doc_name AS problem, unnest([author, author || 'b']) AS author,
       'unknown-' || doc_name AS unknown_folder FROM corpus""")


def src_documents(spark, sf):
    files = _file(C.docs(spark, sf), [F.col("problem"), F.col("author"),
                                      F.concat("doc_name", F.lit(".txt"))], F.col("text"))
    return S.parse_documents(files).withColumn("text", F.md5("text"))


QUERIES["src_documents"] = src_documents
ORACLES["src_documents"] = C.sql("""
SELECT problem, author AS folder, doc_name || '.txt' AS doc_name, md5(text) AS text FROM corpus""")


def src_imposters(spark, sf):
    files = _file(C.imposters(C.docs(spark, sf)), [F.col("problem"), F.concat("doc_name", F.lit(".txt"))],
                  F.col("text"))
    return S.parse_imposters(files).withColumn("text", F.md5("text"))


QUERIES["src_imposters"] = src_imposters
ORACLES["src_imposters"] = C.sql("""
SELECT problem AS language, doc_name || '.txt' AS doc_name, md5(text) AS text FROM imposters""")


def src_truth(spark, sf):
    truth = F.to_json(F.struct(F.array(
        _object(unknown_text="doc_name", true_author="true_author")).alias("ground_truth")))
    return S.parse_truth(_file(C.docs(spark, sf), [F.col("problem"), S.TRUTH_FILE], truth))


QUERIES["src_truth"] = src_truth
ORACLES["src_truth"] = C.sql("SELECT problem, doc_name, true_author FROM corpus")


def src_answer_files(spark, sf):
    """Two answers per file for the same document; the first one counts."""
    answers = F.to_json(F.array(_object(unknown_text="doc_name", predicted_author="author"),
                                _object(unknown_text="doc_name", predicted_author="true_author")))
    path = F.concat(F.lit("answers-"), "problem", F.lit(".json"))
    return S.first_answers(S.parse_answers(_file(C.docs(spark, sf), [path], answers)))


QUERIES["src_answer_files"] = src_answer_files
ORACLES["src_answer_files"] = C.sql("SELECT problem, doc_name, author AS predicted_author FROM corpus")


def src_fandom(spark, sf):
    authors = F.to_json(F.array(_object(author_name="author")))
    return S.parse_fandom(_file(C.docs(spark, sf), [F.col("problem"), S.FANDOM_FILE], authors))


QUERIES["src_fandom"] = src_fandom
ORACLES["src_fandom"] = C.sql("SELECT problem, author FROM corpus")


def src_cmudict(spark, sf):
    """Dictionary lines WORD  PH ON EMES with numbered variants."""
    variant = F.when(F.col("variant") > 1, F.concat(F.lit("("), F.col("variant") - 1, F.lit(")"))).otherwise("")
    line = F.concat(F.upper("word"), variant, F.lit("  "), F.upper("phonemes"))
    return S.parse_pronunciations(pronunciations(C.docs(spark, sf)).select(line.alias("value")))


QUERIES["src_cmudict"] = src_cmudict
ORACLES["src_cmudict"] = C.sql(*CMU_SQL, "SELECT word, variant, phonemes FROM cmu")


def src_phones(spark, sf):
    """One line per phone of the corpus pronunciations, with its class."""
    phones = pronunciations(C.docs(spark, sf)).select(F.explode(F.split(
        F.regexp_replace("phonemes", "[0-9]", ""), " ")).alias("phone")).distinct()
    table = F.create_map(*[F.lit(x) for pair in PHONES.items() for x in pair])
    line = F.concat_ws("\t", F.upper("phone"), F.element_at(table, F.col("phone")))
    return S.parse_phones(phones.select(line.alias("value")))


QUERIES["src_phones"] = src_phones
ORACLES["src_phones"] = C.sql(
    *CMU_SQL, "classes AS (SELECT * FROM (VALUES " + ", ".join(
        f"('{p}', '{c}')" for p, c in PHONES.items()) + ") AS v(phone, class))", """
SELECT DISTINCT phone, class
FROM (SELECT unnest(string_split(regexp_replace(phonemes, '[0-9]', '', 'g'), ' ')) AS phone FROM cmu)
JOIN classes USING (phone)""")


def src_lexicon(spark, sf):
    """A word list with frequencies, one tab-separated line per word of the corpus."""
    words = C.docs(spark, sf).select(F.explode(T.word_tokens(F.col("text"))).alias("word"))
    rows = words.groupBy("word").agg(F.count("*").alias("n")).select(
        F.concat_ws("\t", "word", "n").alias("value"))
    return S.parse_lexicon(rows, ("word", "n"))


QUERIES["src_lexicon"] = src_lexicon
ORACLES["src_lexicon"] = C.sql(f"""
SELECT word, CAST(count(*) AS VARCHAR) AS n
FROM (SELECT unnest(regexp_extract_all(text, '{C.WORD_SQL}')) AS word FROM corpus) GROUP BY word""")
