"""run() against brute force, and odd tables through every stage."""

import hashlib

import public_tokenizers
import sentencepiece

import corpus_pipeline
from inkprint.llm import private, quality, simhash
from test_decontaminate import slow_pairs
from test_simhash import slow_components, slow_print

SF = "/root/testdata/sf0.001"


def slow_run(docs, items, scores):
    docs = [d for d in docs if scores[d.doc_id] >= quality.THRESHOLD]
    prints = {d.doc_id: slow_print(d.text) for d in docs}
    root = slow_components(set(prints.values()))
    first = {}
    for i, p in sorted(prints.items()):
        first.setdefault(root[p], i)
    docs = [d for d in docs if d.doc_id in set(first.values())]
    bad = {i for i, _, _ in slow_pairs([(d.doc_id, d.text) for d in docs], items)}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for d in docs:
        if d.doc_id not in bad:
            text = private.masked(d.text, private.base_spans(d.text)[0])
            ids = sp.encode(text)
            sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), sp.decode(ids))]
            yield (d.doc_id, text, d.lang, d.source, len(text), len(ids), *sha)


def test_run(spark):
    docs, labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    scores = {r.doc_id: r.score for r in quality.judge(docs, labels).collect()}
    want = sorted(slow_run(docs.collect(), [(r.item_id, r.text) for r in items.collect()], scores))
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == [*docs.columns, "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 0 < len(want) < docs.count() and sorted(map(tuple, got.collect())) == want


def test_odd_rows_through_every_stage(spark):
    rows = [(1, "Some words stand here. " * 30, None, None, None), (1, "Some words stand here. " * 30, None, None, None),
            (None, None, "en", "s", 3), (2, "", "en", "s", 0), (3, "z " * 100_000, "en", "s", 1)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, kinds).selectExpr("*", "1 AS score", "2 AS n_tokens", "'x' AS fp", "3 AS _h")
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert now.columns == docs.columns
            now = spark.createDataFrame(now.collect(), now.schema)
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "fp", "_h",
                               "n_tokens", "ids_sha256", "decoded_sha256"]
        assert empty == (now.count() == 0)
        assert simhash.keep_one(docs.limit(0) if empty else docs).count() == (0 if empty else 3)
