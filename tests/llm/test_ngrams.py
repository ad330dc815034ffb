"""Counts, sums and probabilities of the trie against plain Python."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from inkprint.llm import ngrams
from inkprint.llm.eliasfano import EliasFano

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("top", [10, 1000, 2**40, 2**64 - 1])
def test_search(top):
    rnd = np.random.default_rng(2)
    for n in (0, 1, 5, 3000):
        have = np.unique(rnd.integers(0, top, n, dtype=np.uint64, endpoint=True))
        have = np.unique(np.concatenate([have, np.arange(min(top, 700), dtype=np.uint64)])) if n > 5 else have
        coded = EliasFano.from_parts(EliasFano.of(have).parts())
        ends = np.array([0, top, 2**64 - 1], dtype=np.uint64)
        ask = np.concatenate([have, rnd.integers(0, top, 2000, dtype=np.uint64, endpoint=True), ends])
        at = {int(v): k for k, v in enumerate(have)}
        assert coded.find(ask).tolist() == [at.get(int(v), -1) for v in ask]


def split(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w] + ["\n"]


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def slow_scores(rows, share, order=3):
    train = [split(t) for i, t in rows if not is_held(i)]
    counts = [Counter(tuple(w[k:k + n]) for w in train for k in range(len(w) - n + 1)) for n in range(1, order + 1)]
    total = sum(counts[0].values())
    least = max(1, math.ceil(share * total))
    kept = [{g: n for g, n in c.items() if n >= least} for c in counts]
    for n in range(1, order):  # n-grams behind frequent contexts with frequent words only
        kept[n] = {g: c for g, c in kept[n].items() if g[:-1] in kept[n - 1] and g[-1:] in kept[0]}
    left = [{} for _ in range(order)]
    for n in range(1, order):
        for g, c in kept[n].items():
            left[n][g[:-1]] = left[n].get(g[:-1], 1) - (c - ngrams.DISCOUNT) / kept[n - 1][g[:-1]]

    def base(w):
        return (counts[0][(w,)] + 0.1) / (total + 0.1 * (len(counts[0]) + 1))

    def prob(context, w):
        if not context:
            return base(w)
        lower = prob(context[1:], w)
        n = len(context)
        if context not in kept[n - 1]:
            return lower
        own = kept[n].get((*context, w))
        return left[n].get(context, 1) * lower + ((own - ngrams.DISCOUNT) / kept[n - 1][context] if own else 0)

    for i, text in rows:
        words = split(text)
        known = sum(counts[0][(w,)] > 0 for w in words)
        score = sum(math.log10(prob(tuple(words[max(0, k - order + 1):k]), w)) for k, w in enumerate(words))
        yield i, is_held(i), len(words), known, total, sum(math.log10(base(w)) for w in words), score


@pytest.mark.parametrize("share", [ngrams.SHARE, 1e-3])
def test_scores(spark, share):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r for r in ngrams.score_texts(docs, share=share).collect()}
    assert len(got) == len(rows)
    for i, held, n, known, total, base, score in slow_scores(rows, share):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, abs_tol=1e-3 * n)


def test_probabilities_of_a_context_sum_to_one(spark):
    texts = spark.createDataFrame([("a b a c a b d",), ("a b a",), ("e f g h",)], "text string")
    trie = ngrams.build(texts, ngrams.count_words(texts), share=0.12)
    words = np.arange(trie.words.size)
    own = trie.unigram(trie.count)
    for before in words:
        flat = np.column_stack([np.full(len(words), before), words]).reshape(-1)
        said = trie.score(flat, np.arange(0, len(flat), 2), own[flat])[1::2]
        rest = 1 - (10**own).sum()  # words outside the trie and the one never seen
        gone = 10 ** trie.books[0][2][trie.books[0][3][before]]
        assert math.isclose((10**said).sum() + gone * rest, 1, rel_tol=1e-6)


def test_odd_tables(spark):
    rows = [(1, "A b a"), (1, "A b a"), (2, None), (3, ""), (None, "b c"), (10, "é " * 30_000), (4, "\x0b\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS n_tokens")
    got = sorted((tuple(r) for r in ngrams.score_texts(docs).collect()), key=str)
    want = sorted(slow_scores(rows, ngrams.SHARE), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-6)
    assert ngrams.score_texts(docs.limit(0)).count() == 0
    held = next(k for k in range(99) if is_held(k))
    only = spark.createDataFrame([(held, "x y")], "doc_id long, text string")
    assert tuple(ngrams.score_texts(only).first()) == (held, True, 3, 0, 0, 0.0, 0.0)


def test_rare_ngrams_count_in_a_large_corpus(spark):
    large = spark.range(1300).selectExpr("id + 10000 AS doc_id", "repeat('a ', 4000) AS text")
    own = next(k for k in range(99) if not is_held(k))
    docs = large.union(spark.createDataFrame([(own, "x y z")], "doc_id long, text string")).repartition(5)
    ends = 1 + sum(not is_held(k + 10000) for k in range(1300))
    total = 4001 * (ends - 1) + 4
    assert total > 2**22
    got = ngrams.score_texts(docs).where(f"doc_id = {own}").first()
    x, end = ((n + 0.1) / (total + 0.1 * 6) for n in (1, ends))
    half = lambda p: 0.5 + 0.5 * p
    want = [x, half(x), half(half(x)), half(half(end))]
    assert got.train_tokens == total
    assert math.isclose(got.score, sum(map(math.log10, want)), rel_tol=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_orders(spark, order):
    rows = [(k, " ".join("abcd"[k * j % 4] + "ef"[j % 5 % 2] for j in range(k % 9 + 20))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.score for r in ngrams.score_texts(docs, order=order).collect()}
    want = {r[0]: r[6] for r in slow_scores(rows, 0, order)}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
