"""Fingerprints of edited texts against plain Python."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkprint.llm import multiset


def slow_edits(rows):
    """Pairs of a row and its next one, for distinct ids."""
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for k, (i, text) in enumerate(ordered):
        text, other = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        yield i, text, text[:len(text) - half] + other[:half], other


def bag(text):
    parts = re.split(r"\n+|(?<=[^\w\s,])\s+", text)
    return Counter(p.strip(" ") for p in parts if p.strip(" "))


def cosine(a, b):
    dot = sum(n * b[k] for k, n in a.items())
    return dot / (sum(n * n for n in a.values()) * sum(n * n for n in b.values())) ** 0.5 if a and b else float(a == b)


@pytest.mark.parametrize("buckets", [1, 5, None])
def test_documents(spark, buckets):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in multiset.compare_edited(docs, buckets=buckets).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(got) == len(rows)
    prints, gaps = {}, []
    for i, text, edited, other in slow_edits(rows):
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        gaps += [r.near_edited - cosine(bag(text), bag(edited)), r.near_next - cosine(bag(text), bag(other))]
    assert len(set(prints.values())) == len(prints)
    assert max(map(abs, gaps)) < 0.3 and sum(map(abs, gaps)) / len(gaps) < 0.08


def test_order_insertion_and_deletion(spark):
    frame = spark.createDataFrame([("one.\ntwo. three!", "three!\none.\n\ntwo.", "two.\nthree!")], "a string, b string, c string")
    a, b, c = (multiset.vector(multiset.pieces(F.col(x))) for x in "abc")
    one = multiset.vector(F.array(F.lit("one.")))
    got = frame.select(
        (a == b).alias("same"), (a == multiset.added(c, one)).alias("grown"), (c == multiset.removed(a, one)).alias("cut"),
        (a == c).alias("other"), F.size(a).alias("n"),
    ).first()
    assert (got.same, got.grown, got.cut, got.other, got.n) == (True, True, True, False, multiset.WIDTH)


def test_odd_tables(spark):
    rows = [(5, "ab"), (None, "é1"), (7, None), (3, ""), (9, "😀 x. " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS bucket", "'q' AS v")
    got = {r.doc_id: r for r in multiset.compare_edited(docs).collect()}
    for i, text, edited, _ in slow_edits(rows):
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
    assert got[7].near_next == 0 and got[7].near_edited == 1 and got[3].near_edited == 1
    again = spark.createDataFrame([(1, "x. y"), (1, "x. y"), (1, "z")], "doc_id long, text string")
    assert len(multiset.compare_edited(again).collect()) == 3
    one = multiset.compare_edited(again.where("text = 'z'")).first()
    assert one.near_next == 1 and multiset.compare_edited(again.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = multiset.compare_edited(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1
