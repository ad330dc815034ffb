"""Ranked search of many items against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from inkprint.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, k=10):
    split = [(d, TERM.findall(t.translate(UPPER))) for d, t in docs if t is not None]
    split = [(d, t) for d, t in split if t]
    big_n, big_l = len(split), sum(len(t) for _, t in split)
    df = Counter(w for _, t in split for w in set(t))
    out = []
    for i, text in items:
        asked = set(TERM.findall((text or "").translate(UPPER)))
        scored = []
        for d, t in split:
            tf, m = Counter(t), 100 - 90 + (90 * len(t) * big_n) // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 8 * m))
                    for w in asked if w in tf)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, **more):
    docs = spark.createDataFrame([(d, t, 1, "x", 5) for d, t in docs], "doc_id long, text string, score long, item_id string, item long")
    items = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    return sorted((tuple(r) for r in lexical.rank(docs, items, **more).collect()), key=str)


def test_ranks_are_those_of_brute_force(spark):
    rnd = random.Random(2)
    words = [f"w{k}" for k in range(80)] + ["Ünï", "été", "ÉTÉ", "the", "The", "a1b2", "漢字"]
    make = lambda n: rnd.choice([" ", ", ", "\n", "\x00-"]).join(rnd.choices(words, k=n))
    docs = [(k, make(rnd.choice([1, 5, 30, 300]))) for k in range(300)]
    docs += [(500 + k, docs[7][1]) for k in range(40)] + [(7, docs[7][1])] * 3  # copies and repeated rows: ties
    docs += [(800, None), (801, ""), (802, " ..!\t"), (None, docs[3][1]), (803, "the " * 60_000)]
    items = [(k, make(rnd.choice([1, 4, 12, 40]))) for k in range(40)]
    items += [(90, None), (91, ""), (92, "nowhere"), (93, "the THE"), (94, docs[7][1])]
    want = brute(docs, items)
    assert run(spark, docs, items) == want
    assert run(spark, docs, items, limit=300) == want  # many blocks of items
    assert run(spark, docs, items * 2) == sorted(want * 2, key=str)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == []
    assert run(spark, [(1, "a")], []) == []
    assert run(spark, [(1, None)], [(1, None)]) == []


def test_items_share_sums():
    items = [(0, "the cat sat"), (1, "the cat ran"), (2, "the dog ran far away"), (3, "cat the"), (4, "")]
    plan = lexical.Plan.of(items)
    separate = sum(len(set(t.split())) for _, t in items)
    assert len(plan.atom) < separate  # "far away" is one atom, prefixes are shared
    assert plan.atom_of[plan.vocabulary.index("far")] == plan.atom_of[plan.vocabulary.index("away")]
    weights = np.arange(1, len(plan.vocabulary) + 1) * 10
    texts = pa.array(["far the cat", "ran", ""])
    got = {i: s.tolist() for some, s in plan.sums(texts, weights, 3, 4) for i in some}
    for i, text in items[:4]:
        for d, words in enumerate(["far the cat", "ran", ""]):
            m = 10 + 90 * len(words.split()) * 3 // 4
            asked = set(text.split()) & set(words.split())
            assert got[i][d] == sum(weights[plan.vocabulary.index(w)] * (10**9 // (1000 + 8 * m)) for w in asked)
