"""Stylometric measures per document. Token work stays inside the document's row or partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.functions import text as T
from inkprint.operators.common import DOC, by_doc, join_dimension
from inkprint.operators.vectorize import char_terms, term_counts, whiten, words

# Penn Treebank tags; a group counts all its members.
PENN_TAGS = [
    "CC", "CD", "DT", "EX", "FW", "IN", "JJ", "JJR", "JJS", "LS", "MD", "NN", "NNS", "NNP",
    "NNPS", "PDT", "POS", "PRP", "PRP$", "RB", "RBR", "RBS", "RP", "SYM", "TO", "UH", "VB",
    "VBD", "VBG", "VBN", "VBP", "VBZ", "WDT", "WP", "WP$", "WRB",
]
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def function_word_freq(docs: DataFrame, lexicon: Sequence[str]) -> DataFrame:
    """(problem, doc_name, word, n, share): substring counts and their share of all of them.

    The lexicon is a list of literals that unfolds inside each row; no join is needed.
    """
    counts = F.transform(
        F.array(*[F.lit(w) for w in lexicon]), lambda w: F.struct(w.alias("word"), T.occurrences(F.col("text"), w).cast("long").alias("n"))
    )
    counted = T.computed_once(docs.select(*DOC, "text"), "_counts", counts).select(*DOC, "_counts")
    total = F.aggregate("_counts", F.lit(0).cast("long"), lambda acc, c: acc + c["n"])
    return counted.select(*DOC, total.alias("_total"), F.inline("_counts")).select(
        *DOC, "word", "n", F.when(F.col("_total") > 0, F.col("n") / F.col("_total")).alias("share")
    )


def word_counts(docs: DataFrame) -> DataFrame:
    """(problem, doc_name, word, f): counts of lower-cased words."""
    return term_counts(by_doc(docs), words(1, 1, lambda t: T.word_tokens(F.lower(t)))).select(
        *DOC, F.col("term").alias("word"), F.col("tf").alias("f")
    )


def frequency_spectrum(docs: DataFrame) -> DataFrame:
    """(problem, doc_name, f, v): number of words that occur f times."""
    return word_counts(docs).groupBy(*DOC, "f").agg(F.count("*").alias("v"))


def lexical_richness(docs: DataFrame) -> DataFrame:
    """Words, vocabulary, V/N, log ratio and two variants of Yule's K; NULL where undefined."""
    n, v = F.col("n_words"), F.col("n_vocabulary")
    sums = word_counts(docs).groupBy(*DOC).agg(
        F.sum("f").alias("n_words"), F.count("*").alias("n_vocabulary"),
        F.sum(F.col("f") * F.col("f")).alias("_squares"),
    )
    k_sum = F.col("_squares") / (n * n)
    log_ratio = F.when(n > 2, F.log2(v) / F.log2(F.log2(n)))
    return sums.select(
        *DOC, "n_words", "n_vocabulary", (v / n).alias("type_ratio"), log_ratio.alias("log_ratio"),
        (F.lit(1e4) * (k_sum - F.lit(1.0) / n)).alias("yule_k"),
        (F.lit(1e4) * (k_sum - n) / (n * n)).alias("yule_k_words"),
    )


def mean_word_length(docs: DataFrame) -> DataFrame:
    split = T.computed_once(docs.select(*DOC, "text"), "_words", T.word_tokens(F.col("text")))
    letters = F.length(F.array_join("_words", ""))
    return split.select(
        *DOC, F.when(F.size("_words") > 0, letters / F.size("_words")).alias("mean_word_length")
    )


LEXICAL = ["words_per_sentence", "sentence_spread", "type_ratio", "commas", "semicolons", "colons"]


def lexical_measures(docs: DataFrame) -> DataFrame:
    """Words per sentence (mean and spread), type/token ratio and marks per sentence."""
    parts = T.computed_once(by_doc(docs).select(*DOC, "text"), "_parts", T.sentences(F.col("text")))
    sentences = parts.where(F.size("_parts") > 0).select(
        *DOC, F.explode("_parts").alias("_sentence")
    )
    lengths = sentences.groupBy(*DOC).agg(
        F.count("*").alias("_n"),
        F.avg(F.size(T.wordpunct_tokens(F.col("_sentence")))).alias("words_per_sentence"),
        F.stddev_pop(F.size(T.wordpunct_tokens(F.col("_sentence")))).alias("sentence_spread"),
    )
    marks = T.computed_once(
        by_doc(docs).select(*DOC, "text"), "_words", T.wordpunct_tokens(F.lower("text"))
    ).select(
        *DOC, F.try_divide(F.size(F.array_distinct("_words")), F.size("_words")).alias("type_ratio"),
        *[T.occurrences(F.col("text"), F.lit(mark)).alias(f"_{name}")
          for mark, name in ((",", "commas"), (";", "semicolons"), (":", "colons"))],
    )
    return marks.join(lengths, DOC).select(
        *DOC, "words_per_sentence", "sentence_spread", "type_ratio",
        *[(F.col(f"_{name}") / F.col("_n")).alias(name) for name in ("commas", "semicolons", "colons")],
    )


def lexical_features(docs: DataFrame) -> DataFrame:
    """The lexical measures, whitened within each problem and split."""
    measures = lexical_measures(docs).join(docs.select(*DOC, "split"), DOC)
    return whiten(measures, LEXICAL, ["problem", "split"])


def char_class_freq(docs: DataFrame, marks: str = PUNCTUATION + ALPHABET + ALPHABET.upper()) -> DataFrame:
    """(problem, doc_name, mark, n, per_sentence) for the marks that occur."""
    counts = char_terms(by_doc(docs).select(*DOC, "text"), [1], collapse=False).where(
        F.col("term").isin(list(marks))
    ).groupBy(*DOC, F.col("term").alias("mark")).agg(F.count("*").alias("n"))
    sentences = by_doc(docs).select(*DOC, F.size(T.sentences(F.col("text"))).alias("_n"))
    return counts.join(sentences, DOC).select(
        *DOC, "mark", "n", (F.col("n") / F.col("_n")).alias("per_sentence")
    )


def pos_counts(tags: DataFrame, names: Sequence[str] = tuple(PENN_TAGS)) -> DataFrame:
    """One column per tag, counted per document."""
    return tags.groupBy(*DOC).agg(*[F.count_if(F.col("tag") == t).alias(t) for t in names])


def pos_group_counts(tags: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """One column per named group of tags."""
    return tags.groupBy(*DOC).agg(
        *[F.count_if(F.col("tag").isin(list(members))).alias(name) for name, members in groups.items()]
    )


def spelling_variants(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per document the British and American words of ``pairs`` (british, american) it contains."""
    forms = pairs.select(F.inline(F.array(
        F.struct(F.trim("british").alias("word"), F.lit("british").alias("variety")),
        F.struct(F.trim("american").alias("word"), F.lit("american").alias("variety")),
    ))).distinct()
    distinct = by_doc(docs).select(
        *DOC, F.explode(F.array_distinct(T.word_tokens(F.col("text")))).alias("word")
    )
    found = join_dimension(distinct, forms, ["word"], ["doc_name"])
    def listed(variety):
        return F.array_sort(F.collect_list(F.when(F.col("variety") == variety, F.col("word"))))

    lists = found.groupBy(*DOC).agg(
        listed("british").alias("british"), listed("american").alias("american")
    )
    empty = F.array().cast("array<string>")
    joined = docs.select(*DOC).join(lists, DOC, "left").select(
        *DOC, F.coalesce("british", empty).alias("british"),
        F.coalesce("american", empty).alias("american"),
    )
    return joined.select(
        *DOC, F.size("british").alias("n_british"), F.size("american").alias("n_american"),
        "british", "american",
    )


def stylometric_assemble(docs: DataFrame) -> DataFrame:
    """Richness, word length and whitened lexical measures side by side, one row per document."""
    richness = lexical_richness(docs).withColumnRenamed("type_ratio", "word_type_ratio")
    return (
        docs.select(*DOC, "split").join(mean_word_length(docs), DOC, "left")
        .join(richness, DOC, "left").join(lexical_features(docs).drop("split"), DOC, "left")
    )
