"""The additive model on held-out labels and on odd inputs."""

import math
import zlib

import numpy as np
import pyarrow as pa

from inkprint.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    assert all(r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [(r.quality, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held) > 0


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", quality.F.when(quality.held_out("doc_id", 5), 1 - quality.F.col("quality"))
                               .otherwise(quality.F.col("quality")))
    assert quality.judge(docs, labels).collect() == quality.judge(docs, turned).collect()


def test_features_count_as_said():
    row = dict(zip(quality.FEATURES, quality.features(pa.array(["Ab c! c!\nAb c! c!\n7|é"]))[0]))
    assert math.isclose(row["log_words"], math.log1p(7)) and math.isclose(row["distinct_words"], 3 / 7)
    assert math.isclose(row["top_word"], 4 / 7) and math.isclose(row["marked_words"], 4 / 7)
    assert math.isclose(row["repeated_lines"], 1 / 3) and math.isclose(row["upper_share"], 2 / 8)
    odd = quality.features(pa.array([None, "", " \n", "x" * 200_000, "a " * 50_000]))
    assert np.isfinite(odd).all()
    assert np.array_equal(quality.features(pa.array(["a b", "c d e"]).slice(1)), quality.features(pa.array(["c d e"])))


def test_pairs_of_features_count():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x, y)
    assert model.pairs[0][:2] == (0, 1)
    assert ((model.score(x) > 0.5) == (y > 0)).mean() > 0.9


def test_odd_tables(spark):
    docs = spark.createDataFrame(
        [(1, "a"), (1, "a"), (None, "b"), (2, None), (3, "")], "doc_id long, text string"
    ).selectExpr("*", "0.5 AS score", "1 AS quality")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 0), (2, None, 0), (99, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    got = quality.judge(docs, labels).collect()
    assert len(got) == 5 and all(0 < r.score < 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    empty = quality.judge(docs, labels.limit(0)).collect()
    assert [r.score for r in empty] == [0.5] * 5 and quality.judge(docs.limit(0), labels).count() == 0
    kept = quality.score_texts(docs, quality.AdditiveModel(), docs.columns, at_least=0.3)
    assert kept.columns == docs.columns and kept.count() == 5
