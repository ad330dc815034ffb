"""Input tables that the driver does not ship, derived by Spark from its documents.

Tags, stems and pronunciations come from outside in real use. Here simple spelling
rules stand in, so that these queries too grow with the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.functions import text as T
from inkprint.queries.corpus import WORDPUNCT_SQL, WORDS_SQL

# Spelling rule -> tag, first match wins.
TAG_RULES = [
    (r"^\p{N}+$", "CD"),
    (r"^[^\p{L}\p{N}_]+$", "SYM"),
    (r"(ly|ment)$", "RB"),
    (r"(ing|ed|er|en)$", "VB"),
    (r"(es|s)$", "NNS"),
    (r"^\p{Lu}", "NNP"),
]


def tags(docs: DataFrame) -> DataFrame:
    """(problem, doc_name, pos, token, tag) by spelling."""
    tokens = docs.select(
        "problem", "doc_name", F.posexplode(T.wordpunct_tokens(F.col("text"))).alias("pos", "token")
    )
    tag = F.lit("NN")
    for pattern, name in reversed(TAG_RULES):
        tag = F.when(F.col("token").rlike(pattern), name).otherwise(tag)
    return tokens.withColumn("tag", tag)


TAGS_SQL = (
    "tags AS (SELECT *, CASE "
    + " ".join(f"WHEN regexp_matches(token, '{p}') THEN '{t}'" for p, t in TAG_RULES)
    + f""" ELSE 'NN' END AS tag FROM (
  SELECT problem, doc_name, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos
  FROM (SELECT problem, doc_name, regexp_extract_all(text, '{WORDPUNCT_SQL}') AS t FROM corpus)))"""
)

# Endings that the stand-in stemmer strips when at least three letters remain.
ENDINGS = r"^(\p{L}{3,}?)(ing|ment|tion|ed|es|en|er|s)$"


def stems(docs: DataFrame) -> DataFrame:
    """(language, token, stem): one row per distinct token."""
    tokens = docs.select(
        "language", F.explode(T.wordpunct_tokens(F.col("text"))).alias("token")
    ).distinct()
    stem = F.regexp_replace(F.lower("token"), ENDINGS, "$1")
    return tokens.withColumn("stem", stem)


# Fill in ``source``; defines ``stemmed`` (problem, doc_name, text).
STEM_SQL = f"""stemmed AS (
  SELECT problem, doc_name, coalesce(string_agg(
           regexp_replace(lower(token), '{ENDINGS.replace("{", "{{").replace("}", "}}")}', '\\1'), ' ' ORDER BY pos), '') AS text
  FROM {{source}} LEFT JOIN (
    SELECT problem, doc_name, unnest(t) AS token, generate_subscripts(t, 1) AS pos
    FROM (SELECT problem, doc_name, regexp_extract_all(text, '{WORDPUNCT_SQL.replace("{", "{{").replace("}", "}}")}') AS t
          FROM {{source}})) USING (problem, doc_name)
  GROUP BY problem, doc_name)"""

# Letter -> phone of the stand-in pronunciation by spelling.
LETTERS = {
    "a": "ae0", "b": "b", "c": "k", "d": "d", "e": "eh0", "f": "f", "g": "g", "h": "hh", "i": "ih0",
    "j": "jh", "k": "k", "l": "l", "m": "m", "n": "n", "o": "ow0", "p": "p", "q": "k", "r": "r",
    "s": "s", "t": "t", "u": "uw0", "v": "v", "w": "w", "x": "z", "y": "y", "z": "z",
}


def pronunciations(docs: DataFrame) -> DataFrame:
    """(word, variant, phonemes) for every word of plain letters in the corpus.

    The first vowel has primary stress, the third secondary. Words with an a have a second
    pronunciation.
    """
    words = docs.select(
        F.explode(T.spaced_words(F.lower("text"))).alias("word")
    ).where(F.col("word").rlike("^[a-z]+$")).distinct()
    table = F.create_map(*[F.lit(x) for pair in LETTERS.items() for x in pair])
    spelled = F.array_join(
        F.transform(F.split("word", ""), lambda c: F.element_at(table, c)), " "
    )
    first = T.computed_once(words, "p", F.regexp_replace(spelled, "^([^0]*)0", "$1\\1"))
    first = T.computed_once(first, "p", F.regexp_replace("p", "^([^0]*0[^0]*)0", "$1\\2"))
    both = F.array(
        F.struct(F.lit(1).alias("variant"), F.col("p").alias("phonemes")),
        F.struct(F.lit(2).alias("variant"), F.regexp_replace("p", "ae", "ah").alias("phonemes")),
    )
    return first.select("word", F.inline(both)).where(
        "variant = 1 OR phonemes LIKE '%ah%'"
    )


CMU_SQL = [
    f"""plain AS (
  SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(text), '{WORDS_SQL}')) AS word FROM corpus)
  WHERE regexp_matches(word, '^[a-z]+$'))""",
    "letters AS (SELECT * FROM (VALUES " + ", ".join(
        f"('{letter}', '{phone}')" for letter, phone in LETTERS.items()) + ") AS v(letter, phone))",
    r"""spelled AS (
  SELECT word, regexp_replace(regexp_replace(string_agg(phone, ' ' ORDER BY i), '^([^0]*)0', '\11'),
                              '^([^0]*0[^0]*)0', '\12') AS p
  FROM (SELECT word, unnest(string_split(word, '')) AS letter, generate_subscripts(string_split(word, ''), 1) AS i FROM plain)
  JOIN letters USING (letter) GROUP BY word)""",
    """cmu AS (
  SELECT word, 1 AS variant, p AS phonemes FROM spelled
  UNION ALL SELECT word, 2, replace(p, 'ae', 'ah') FROM spelled WHERE p LIKE '%ae%')""",
]
