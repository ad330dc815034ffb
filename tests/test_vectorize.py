import math
import random
import re

import pytest
from pyspark.sql import functions as F

from inkprint.functions import grams as G
from inkprint.functions import text as T
from inkprint.operators import common
from inkprint.operators import vectorize as V


def test_tfidf_values(spark, docs):
    d = docs(("p", "1", "a", "aab"), ("p", "2", "a", "abb"), ("p", "3", "b", "ccc"))
    rows = V.fit_tfidf(d, V.chars(1, 1), 0.0).transform(d).collect()
    values = {(r["doc_name"], r["term"]): round(r["value"], 6) for r in rows}
    assert values == {("1", "a"): 0.861037, ("1", "b"): 0.508542, ("2", "a"): 0.508542,
                      ("2", "b"): 0.861037, ("3", "c"): 1.0}


@pytest.mark.parametrize("hot_rows,hot_keys", [(10**6, 10**6), (20, 10**6), (20, 0)])
@pytest.mark.parametrize("weight", [None, "df"])
def test_large_dimension_joins_like_a_small_one(spark, docs, monkeypatch, hot_rows, hot_keys, weight):
    """Without hot keys, with a few salted hot keys, and with every key salted."""
    d = docs(*[("p", str(i), "a", "the cat " * (i % 5 + 1)) for i in range(40)])
    counts = V.term_counts(common.by_doc(d), V.chars(2, 3))
    idf = V.idf_table(V.document_frequency(counts), V.problem_sizes(d)).select(
        "problem", "term", "idf", *([weight] if weight else []))
    on, salt = ["problem", "term"], common.DOC
    small = common.join_dimension(counts, idf, on, salt, weight=weight)
    monkeypatch.setattr(common, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(common, "fits_broadcast", lambda df, n=hot_keys: df.count() <= n)
    for how in ("inner", "left"):
        large = common.join_dimension(counts, idf, on, salt, how, max_rows=0, weight=weight)
        assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.select(small.columns).collect()))
    part = idf.where(F.col("term") == "th")
    kept = common.join_dimension(counts, part, on, salt, "left_semi", max_rows=0, weight=weight)
    assert [r["term"] for r in kept.select("term").distinct().collect()] == ["th"]


def test_top_k_and_ordinal(spark):
    rows = [("g" if i % 3 else "h", f"n{i}", i * 7 % 31) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, name string, v int")
    best = common.top_k(df, ["g"], [F.desc("v"), F.asc("name")], 5, ["name"])
    for group in "gh":
        mine = [(r["v"], r["name"]) for r in best.where(F.col("g") == group).orderBy("rank").collect()]
        ordered = sorted(((v, n) for g, n, v in rows if g == group), key=lambda t: (-t[0], t[1]))
        assert mine == ordered[:5]
    numbered = common.ordinal(df, ["g"], "name")
    for group in "gh":
        got = sorted(r["ordinal"] for r in numbered.where(F.col("g") == group).collect())
        assert got == list(range(len(got)))


def bucket(name):
    import hashlib
    return int(hashlib.md5(name.encode()).hexdigest()[:6], 16) % 256


def random_texts(seed, n, longest):
    rng = random.Random(seed)
    alphabet = "ab \n é.\u00a0\u2003\x1f"
    return [(f"d{i}", "".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))))
            for i in range(n)]


@pytest.mark.parametrize("seed,n,longest", [(1, 1, 20), (2, 30, 4), (3, 12, 60), (4, 400, 3)])
def test_profile_grams_equal_joined_text(spark, docs, seed, n, longest):
    """N-grams over document borders, with very short and blank documents."""
    texts = random_texts(seed, n, longest)
    if not any(t.strip() for _, t in texts):
        texts.append(("dx", "ab"))
    joined = " ".join(t for _, t in sorted(texts, key=lambda x: (bucket(x[0]), x[0])))
    d = docs(*[("p", name, "a", t) for name, t in texts])

    collapsed = re.sub(r"\s\s+", " ", joined)
    expected = {}
    for k in range(1, 6):
        for i in range(len(collapsed) - k + 1):
            expected[collapsed[i:i + k]] = expected.get(collapsed[i:i + k], 0) + 1
    counts = V.profile_counts(V.profile_char_terms(d, range(1, 6)))
    assert {r["term"]: r["tf"] for r in counts.collect()} == expected

    tokens = re.findall(r"\w+|[^\w\s]+", joined)
    expected = {}
    for k in range(1, 4):
        for i in range(len(tokens) - k + 1):
            gram = " ".join(tokens[i:i + k])
            expected[gram] = expected.get(gram, 0) + 1
    counts = V.profile_counts(V.profile_word_terms(d, 1, 3))
    assert {r["term"]: r["tf"] for r in counts.collect()} == expected


def test_chi2_by_hand(spark, docs):
    features = spark.createDataFrame(
        [("p", "1", "t", 1.0), ("p", "2", "t", 3.0), ("p", "3", "u", 2.0)],
        "problem string, doc_name string, term string, value double")
    labels = docs(("p", "1", "a", ""), ("p", "2", "b", ""), ("p", "3", "b", "")).drop("text")
    scores = {r["term"]: r["chi2"] for r in V.chi2_scores(features, labels).collect()}
    e = (4 / 3, 8 / 3)
    assert math.isclose(scores["t"], (1 - e[0]) ** 2 / e[0] + (3 - e[1]) ** 2 / e[1])
    e = (2 / 3, 4 / 3)
    assert math.isclose(scores["u"], e[0] + (2 - e[1]) ** 2 / e[1])


def test_long_documents_take_the_other_way(spark, docs, monkeypatch):
    d = docs(("p", "1", "a", "abc abc  ab"), ("p", "2", "a", "abcabcabc abcabc"), ("p", "3", "a", ""))
    for analyzer in (V.chars(1, 3), V.words(1, 2)):
        short = sorted(map(tuple, V.term_counts(common.by_doc(d), analyzer).collect()))
        for limit in (0, 12):
            monkeypatch.setattr(V, "LONG_TEXT", limit)
            assert sorted(map(tuple, V.term_counts(common.by_doc(d), analyzer).collect())) == short
        monkeypatch.undo()


def test_no_exchange_after_partitioning_by_document(spark, docs):
    """Counting, weighting and normalising need no shuffle beyond the one by document."""
    d = docs(("p", "1", "a", "aab"), ("p", "2", "b", "abb"))
    plan = V.fit_tfidf(d, V.chars(1, 2), 0.0).transform(d)._jdf.queryExecution().executedPlan().toString()
    # One for the short and one for the long documents: every text moves once.
    assert plan.count("Exchange hashpartitioning") == 2
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan


def test_text_partitions_grow_with_the_texts(spark, docs, monkeypatch):
    """More text means more partitions, not larger ones."""
    monkeypatch.setattr(common, "PARTITION_CHARS", 10)
    some = docs(*[("p", str(i), "x", "abcdefghij" * 4) for i in range(10)], ("p", "n", "x", None))
    assert common.by_doc(some).rdd.getNumPartitions() == 40
    assert common.by_doc(some.where("false")).rdd.getNumPartitions() == 8


@pytest.mark.parametrize("slice_chars,part_chars,long_text", [(400_000, 2_000_000, 1_000_000), (7, 20, 1_000_000), (400_000, 30, 25)])
def test_weights_in_tasks(spark, docs, monkeypatch, slice_chars, part_chars, long_text):
    """Counting in tasks, in small slices and parts and beside long texts, gives the counts of rows."""
    monkeypatch.setattr(G, "SLICE", slice_chars)
    monkeypatch.setattr(V, "PARTITION_CHARS", part_chars)
    monkeypatch.setattr(V, "LONG_TEXT", long_text)
    rng = random.Random(3)
    rows = [(p, str(i), "x", "".join(rng.choice("ab  é🙂\n中") for _ in range(rng.randint(0, 40))))
            for i in range(30) for p in ("p", "q")]
    some = docs(*rows, ("p", "n", "x", None), (None, "m", "x", "abab"))
    for analyzer in (V.chars(2, 4), V.chars(3, 3, T.distort), V.char_analyzer([1, 14], collapse=False)):
        fitted = V.fit_tfidf(some, analyzer, 0.05)
        plain = V.document_frequency(V.term_counts(common.by_doc(some), analyzer))
        table = V.idf_table(plain, V.problem_sizes(some), 0.05)
        assert sorted(map(tuple, fitted.table.collect())) == sorted(map(tuple, table.select(*fitted.table.columns).collect()))
        mine = {tuple(r)[:3]: r["value"] for r in fitted.transform(some).collect()}
        rest = V.tfidf_weights(V.term_counts(common.by_doc(some), analyzer), fitted.table)
        assert mine == pytest.approx({tuple(r)[:3]: r["value"] for r in rest.collect()}) and mine
    assert "FlatMapCoGroupsInArrow" in fitted.transform(some)._jdf.queryExecution().toString()


def test_packed_counts_are_the_weights(spark, docs, monkeypatch):
    """One row per document, also without terms, empty, null or too long for a task; weights as in rows."""
    monkeypatch.setattr(V, "LONG_TEXT", 60)
    d = docs(("p", "a", "x", "abab abba baab"), ("p", "b", "y", "zzzz abab"), ("p", "c", "x", "abba " * 40),
             ("p", "d", "y", ""), ("p", "e", "y", None), ("q", "a", "x", "caab caab abba"), ("p", "f", "x", "qqqqqqq"))
    fitted = V.fit_top_k(d.where("doc_name IN ('a', 'c')"), 2, 5)
    vocab = V.materialize(fitted.table.select("problem", "term", (F.col("rank") - 1).cast("smallint").alias("place"), "idf"))
    rows = V.packed_counts(d, fitted.analyzer, vocab, [*V.DOC, "author"]).collect()
    terms = {(r["problem"], r["place"]): (r["term"], r["idf"]) for r in vocab.collect()}
    found = {}
    for r in rows:
        for at, tf in zip(r["at"], r["tf"]):
            term, idf = terms[r["problem"], at]
            found[r["problem"], r["doc_name"], term] = tf * idf / r["norm"]
    assert found == pytest.approx({tuple(r)[:3]: r["value"] for r in fitted.transform(d).collect()})
    assert len(rows) == 7 and {r["doc_name"] for r in rows if not r["at"]} == {"d", "e", "f"}
    assert all(list(r["at"]) == sorted(r["at"]) for r in rows)


def test_rare_words_are_not_shuffled(spark, docs, monkeypatch):
    """Frequent terms keep their numbers over parts of any size; most of the rare ones never leave their part."""
    pick = random.Random(3)
    rows = [(p, f"d{k}", "x", " ".join(pick.choice(["der", "die", "das", "und"]) for _ in range(6)) + f" w{p}{k} v{p}{k % 30}")
            for p in "pq" for k in range(120)]
    d = docs(*rows, ("p", "none", "x", None), ("p", "void", "x", ""), ("q", "long", "x", "der die und " * 40), (None, "d", "x", "der die"))
    analyzer = V.words(1, 2)
    monkeypatch.setattr(V, "PARTITION_CHARS", 800)
    monkeypatch.setattr(V, "LONG_TEXT", 300)
    plain = V.document_frequency(V.term_counts(common.by_doc(d), analyzer))
    sizes = V.problem_sizes(d)
    want = sorted(map(tuple, V.idf_table(plain, sizes, 0.25).collect()))
    found = V.text_frequency(d, analyzer, 0.25)
    assert sorted(map(tuple, V.idf_table(found, sizes, 0.25).collect())) == want and len(want) > 10
    assert found.count() < plain.count() / 10
