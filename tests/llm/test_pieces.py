"""SentencePiece ids and decoded texts against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from inkprint.llm import pieces
from inkprint.llm.common import bounds, plain, words_of

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_and_texts(library):
    model, rnd = pieces.load(PATH), random.Random(5)
    letters = "aaab  ethinosr\n\t.,éßñ▁😀字#$%019\x00AB　﻿﷽"
    known = [p.replace("▁", " ") for p in model.of]
    texts = ["", *(" " * k for k in range(1, 60)), *("a" * k for k in range(1, 40))]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(rnd.choice(known) for _ in range(rnd.randint(1, 12))) for _ in range(4000)]
    texts += ["ab" * 3000 + " " * 5000 + "x ", "the" * 2000, "ñ字" * 1500, "<s> <0x41> </s>"]
    ids, per = model.encode(pa.array(texts))
    at, shown = bounds(per), model.decode(ids, per)
    for k, text in enumerate(texts):
        want = library.encode(text)
        assert ids[at[k]:at[k + 1]].tolist() == want
        assert shown[k].decode() == library.decode(want)


def test_slices_of_arrays():
    model, texts = pieces.load(PATH), ["Some A b", "C  d E f\n", None, "", "G h I"]
    whole = pa.array(texts)
    for k in range(5):
        ids, per = model.encode(whole.slice(k))
        want = model.encode(pa.array(texts[k:], pa.string()))
        assert ids.tolist() == want[0].tolist() and per.tolist() == want[1].tolist()
        words, counts = words_of(plain(whole.slice(k)))
        assert words.to_pylist() == [w.lower() for t in texts[k:] for w in (t or "").split()]
        assert counts.tolist() == [len((t or "").split()) for t in texts[k:]]


def test_decodes_any_ids(library):
    model, rnd = pieces.load(PATH), random.Random(6)
    for _ in range(1500):
        ids = [rnd.choice([rnd.randrange(32000), rnd.randrange(3, 259), rnd.randrange(5)]) for _ in range(rnd.randint(0, 8))]
        assert model.decode(np.array(ids, dtype=np.int64), np.array([len(ids)]))[0].decode() == library.decode(ids)


def test_rows(spark, library):
    rows = [(1, "Two words"), (1, "Two words"), (None, " x"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS n_tokens")
    got = pieces.digest_texts(docs, PATH, ["doc_id"]).collect()

    def want(text):
        ids = library.encode(text or "")
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
        return (len(ids), *sha)

    assert sorted(map(tuple, got), key=str) == sorted(((i, *want(t)) for i, t in rows), key=str)
    lists = pieces.encode_texts(docs, PATH).collect()
    assert sorted((r.ids, r.decoded) for r in lists) == sorted((library.encode(t or ""), t or "") for _, t in rows)
    assert pieces.digest_texts(docs.limit(0), PATH, ["doc_id"]).count() == 0
