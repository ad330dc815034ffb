import bz2
import zlib

import pytest
from pyspark.sql import functions as F

from inkprint.operators import compression as K
from inkprint.operators import similarity as S
from inkprint.operators import stylometry as Y


def test_richness(spark, docs):
    d = docs(("p", "1", "a", "the cat the dog a cat the"), ("p", "2", "a", ""), ("p", "3", "a", "two words"))
    rows = {r["doc_name"]: r for r in Y.lexical_richness(d).collect()}
    assert rows["1"]["type_ratio"] == pytest.approx(0.571429, abs=1e-6)
    assert rows["1"]["log_ratio"] == pytest.approx(1.342993, abs=1e-6)
    assert rows["1"]["yule_k"] == pytest.approx(1632.653061, abs=1e-6)
    assert rows["3"]["log_ratio"] is None and "2" not in rows
    spectrum = {r["f"]: r["v"] for r in Y.frequency_spectrum(d.where("doc_name = '1'")).collect()}
    assert spectrum == {1: 2, 2: 1, 3: 1}


def test_function_words(spark, docs):
    rows = Y.function_word_freq(docs(("p", "1", "a", "The other bathe there"), ("p", "2", "a", "")),
                                ["the", "other", "here", "zzz"]).collect()
    got = {(r["doc_name"], r["word"]): (r["n"], r["share"]) for r in rows}
    assert got["1", "the"] == (3, 0.6) and got["1", "other"] == (1, 0.2)
    assert got["1", "zzz"] == (0, 0.0) and got["2", "the"] == (0, None)


def test_spelling(spark, docs):
    pairs = spark.createDataFrame([("colour", "color"), (" centre", "center")], "british string, american string")
    rows = {r["doc_name"]: r for r in Y.spelling_variants(
        docs(("p", "1", "a", "colour colour center"), ("p", "2", "a", "none")), pairs).collect()}
    assert rows["1"]["british"] == ["colour"] and rows["1"]["american"] == ["center"]
    assert rows["2"]["n_british"] == 0


def test_compression_formulas(spark):
    row = spark.range(1).select(K.cbc(F.lit(100), F.lit(80), F.lit(150)).alias("c"),
                                K.ncd(F.lit(100), F.lit(80), F.lit(150)).alias("n")).first()
    assert row["c"] == pytest.approx(0.664590, abs=1e-6) and row["n"] == pytest.approx(0.7)


def test_profile_is_one_stream(spark, docs):
    texts = [f"text number {i} with some words " * 5 for i in range(40)]
    d = docs(*[("p", f"d{i}", "a", t) for i, t in enumerate(texts)])
    from test_vectorize import bucket
    order = sorted(range(40), key=lambda i: (bucket(f"d{i}"), f"d{i}"))
    joined = " ".join(texts[i] for i in order).encode()
    row = K.profile_sizes(d).first()
    assert row["size"] == len(zlib.compress(joined)) and bytes(row["tail"]) == joined[-32768:]
    assert K.profile_sizes(d, "bz2").first()["size"] == len(bz2.compress(joined))
    blocks = K.profile_sizes(d, block_chars=1000).first()
    assert blocks["size"] > row["size"]  # several independent streams


def test_pair_sizes_recognise_a_copy(spark, docs):
    known = docs(("p", "1", "a", "completely different words stand in this one " * 3),
                 ("p", "2", "b", "quick brown foxes jump over lazy dogs each day " * 3))
    unknown = docs(("p", "u", None, "quick brown foxes jump over lazy dogs each day"))
    for algo in ("zlib", "bz2", "lzma"):
        rows = {r["author"]: r for r in K.compression_features(unknown, known, algo).collect()}
        assert rows["b"]["cbc"] <= rows["a"]["cbc"]


def test_minmax(spark):
    schema = "problem string, {} string, term string, value double"
    left = spark.createDataFrame([("p", "1", "a", 1.0), ("p", "1", "b", .5)], schema.format("doc_name"))
    right = spark.createDataFrame([("p", "x", "b", 1.0), ("p", "x", "c", .25)], schema.format("author"))
    assert S.minmax_distance(left, right).first()["distance"] == pytest.approx(0.777778, abs=1e-6)
