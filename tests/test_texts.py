from pyspark.sql import functions as F

from inkprint.functions import text as T
from inkprint.operators import vectorize as V
from inkprint.operators.common import by_doc
from inkprint.operators.texts import stem_tokens, truncate_common

SAMPLE = "L'età  era\n\nbella 😀x a9_b don't"


def one(spark, value, text=SAMPLE):
    return spark.createDataFrame([(text,)], "text string").select(value(F.col("text"))).first()[0]


def test_distort(spark):
    assert one(spark, T.distort, "It's 2019, età\n ok   no") == "**'* *0**, **à **  **"


def test_tokens(spark):
    assert one(spark, T.word_tokens) == ["L", "età", "era", "bella", "x", "a9_b", "don", "t"]
    assert one(spark, T.default_tokens) == ["età", "era", "bella", "a9_b", "don"]
    assert one(spark, T.wordpunct_tokens) == [
        "L", "'", "età", "era", "bella", "😀", "x", "a9_b", "don", "'", "t"]


def test_all_of_unicode_white_space_collapses(spark):
    text = "a\u00a0\u2003b \u3000 c\x1f\x85d\u00a0e"
    assert one(spark, T.collapse_spaces, text) == "a b c d\u00a0e"
    assert one(spark, T.spaced_words, text) == ["a", "b", "c", "d", "e"]
    assert one(spark, T.wordpunct_tokens, "a\u00a0. \u2003!") == ["a", ".", "!"]


def test_sentences_drop_empty_pieces(spark):
    assert one(spark, T.sentences, "One. Two!  Three?") == ["One.", "Two!", "Three?"]
    assert one(spark, T.sentences, "") == []


def test_skip_bigrams(spark):
    def pairs(text, span):
        df = spark.createDataFrame([(text,)], "text string")
        df = T.computed_once(df, "t", T.word_tokens(F.col("text")))
        return df.select(T.skip_bigrams(F.col("t"), span)).first()[0]

    assert pairs("a b c d", 2) == ["a_c", "b_d"]
    assert pairs("a b", 2) == []


def test_grams_cross_chunks(spark, docs):
    """Chunked reading finds the same n-grams as slicing, emoji included."""
    text = ("abcdefg 😀é" * 4000)[:40000]
    counts = V.term_counts(by_doc(docs(("p", "1", "a", text))), V.chars(1, 4))
    mine = {r["term"]: r["tf"] for r in counts.collect()}
    expected = {}
    for n in range(1, 5):
        for i in range(len(text) - n + 1):
            expected[text[i:i + n]] = expected.get(text[i:i + n], 0) + 1
    assert mine == expected


def test_word_grams(spark, docs):
    counts = V.term_counts(by_doc(docs(("p", "1", "a", "a b a b"), ("p", "2", "a", "x"))), V.words(1, 3))
    rows = {(r["doc_name"], r["term"]): r["tf"] for r in counts.collect()}
    assert rows == {("1", "a"): 2, ("1", "b"): 2, ("1", "a b"): 2, ("1", "b a"): 1,
                    ("1", "a b a"): 1, ("1", "b a b"): 1, ("2", "x"): 1}


def test_truncate_common(spark):
    rows = [("p", "known", "1", "abcdef"), ("p", "known", "2", "abc"), ("p", "unknown", "3", "abcde")]
    df = spark.createDataFrame(rows, "problem string, split string, doc_name string, text string")
    cut = {r["doc_name"]: r["text"] for r in truncate_common(df).collect()}
    assert cut["3"] == "abcde"
    # Only the first known text counts, because the unknown set has one row.
    first = cut["1"]
    assert first in ("abcdef", "abc") and cut["2"] == "abc"


def test_stem_tokens(spark):
    df = spark.createDataFrame([("p", "en", "1", "Runs, ran!"), ("p", "en", "2", "")],
                               "problem string, language string, doc_name string, text string")
    stems = spark.createDataFrame([("en", "Runs", "run")], "language string, token string, stem string")
    out = {r["doc_name"]: r["text"] for r in stem_tokens(df, stems).collect()}
    assert out == {"1": "run , ran !", "2": ""}


def test_spaced_words_by_code_point(spark):
    """Every character counts as white space for the words exactly if it does for SPACE."""
    df = spark.range(0x110000).where("id NOT BETWEEN 55296 AND 57343 AND id <> 65279").select(  # no surrogates, no byte order mark
        F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    wrong = df.where((F.size(T.spaced_words(F.col("c"))) == 0) != F.col("c").rlike(f"^{T.SPACE}$"))
    assert [r["c"] for r in wrong.collect()] == []


def test_stem_tokens_makes_no_row_per_token(spark):
    """Many documents of many tokens, odd values among them: nothing is gathered by document."""
    texts = [None, "", " ", "Runs, ran!", *(f"Runs w{i}, " * 300 for i in range(200))]
    rows = [("p", None if i % 7 == 6 else "en", str(i), text) for i, text in enumerate(texts)]
    df = spark.createDataFrame(rows, "problem string, language string, doc_name string, text string")
    stems = spark.createDataFrame([("en", "Runs", "run"), ("en", "w5", None)],
                                  "language string, token string, stem string")
    out = stem_tokens(df, stems)
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    found = {r["doc_name"]: r["text"] for r in out.collect()}
    assert found == {
        name: "" if not (text or "").strip() else "run , ran !" if name == "3" else " ".join(
            ["run" if language else "Runs", text.split()[1][:-1], ","] * 300)
        for _, language, name, text in rows}


def test_count_totals(spark, docs):
    """Sums of the character n-grams, as those of the rows of term_counts, long texts included."""
    texts = ["", None, "ab", "abcabc", "x\u00e9\U0001f600 \u00e9x  \n y" * 50, "ab cd" * 210_000]
    df = by_doc(docs(*[("p", str(i), "a", t) for i, t in enumerate(texts)]))
    totals = V.count_totals(df, V.chars(3, 5))
    assert "MapInArrow" in totals._jdf.queryExecution().optimizedPlan().toString()
    counts = V.term_counts(df, V.chars(3, 5)).groupBy(*V.DOC).agg(
        F.count("*"), F.sum("tf"), F.sum(F.col("tf") * F.col("tf")), F.min("term"), F.max("term"))
    assert sorted(map(tuple, totals.collect())) == sorted(map(tuple, counts.collect()))
    assert totals.count() == 3
