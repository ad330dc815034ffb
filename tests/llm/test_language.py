"""Code lengths against a plain walk down the trees, and held-out accuracy."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from inkprint.llm import language

SF = "/root/testdata/sf0.01"


def slow_bits(train, text, order=3):
    counts = Counter()
    for t in train:
        b = b" " * order + t.lower().encode()
        for i in range(order, len(b)):
            for k in range(order + 1):
                counts[b[i - k:i], b[i]] += 1
    follow = {}
    for (c, s), n in counts.items():
        follow.setdefault(c, {})[s] = n
    total, b = 0.0, b" " * order + text.lower().encode()
    for i in range(order, len(b)):
        for k in range(order, -1, -1):
            seen = follow.get(b[i - k:i])
            if seen is None:
                continue
            whole = sum(seen.values()) + len(seen)
            if b[i] in seen:
                total += math.log2(whole / seen[b[i]])
                break
            total += math.log2(whole / len(seen))
        else:
            total += 8
    return total


def test_code_lengths(monkeypatch):
    rnd = random.Random(3)
    said = {"aa": ["the cat sat", "a cat"], "bb": ["le chat été", "un chat"], "cc": ["x"]}
    rows = []
    for name, texts in said.items():
        keys, _ = language.grams(pa.array(texts))
        rows += [(name, int(k), n) for k, n in Counter(keys.tolist()).items()]
    trees = language.ContextTrees.of(rows)
    texts = ["", "The CAT", "été", "zz\x00", "x" * 50] + ["".join(rnd.choices("thecatlé sun", k=30)) for _ in range(40)]
    for cells in (4 << 20, 30):
        monkeypatch.setattr(language, "CELLS", cells)
        got = trees.code_lengths(pa.array(["skip", *texts]).slice(1))
        want = [[slow_bits(said[name], t) for name in trees.languages] for t in texts]
        assert np.allclose(got, want, rtol=1e-4, atol=1e-3)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.97 * len(held) > 0


def test_odd_tables(spark):
    rows = [(k, "some english words", "en") for k in range(12)] + [(k, "quelques mots été", "fr") for k in range(12, 24)]
    rows += [(50, None, "en"), (51, "", None), (52, "12 .. 3", "fr"), (None, "some words", "xx"), (53, "été " * 50_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'n' AS lang_pred")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    assert [got[k].lang_pred for k in (50, 51, 52)] == ["und"] * 3 and got[52].score == 0
    assert got[53].lang_pred == "fr" and got[None].lang_pred == "en" and got[None].held_out is False
    assert {r.lang_pred for r in language.identify(docs.where("lang is null")).collect()} == {"und"}
    assert language.identify(docs.limit(0)).count() == 0
