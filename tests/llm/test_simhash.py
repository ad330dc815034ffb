"""Fingerprints and components against brute force."""

import random

import pytest
import xxhash

from inkprint.llm import simhash
from inkprint.llm.common import components


def slow_print(text):
    words = [w for w in "".join(
        c.lower() if "A" <= c <= "Z" else c for c in text or ""
    ).replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    width = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + width]), 42) for i in range(len(words) - width + 1)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(prints, radius=2):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= radius:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in prints}


@pytest.mark.parametrize("text", ["", None, " \t\n", "One", "a b", "A b\tc  d e É\n", "x " * 500])
def test_fingerprint(text):
    made = simhash.fingerprint((text or "").encode())
    assert made & (2**64 - 1) == slow_print(text)


def test_queries_rule_over_documents(spark):
    rows = [(1, "a b c d"), (2, None), (3, ""), (None, "q r s"), (4, "A B\nC d"), (4, "A B\nC d"), (0, "q r s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS component")
    got = sorted(
        ((r.id, r.component) for r in simhash.near_duplicates(docs).collect()), key=str
    )
    assert got == sorted([(1, 1), (2, 2), (3, 2), (None, 0), (4, 1), (4, 1), (0, 0)], key=str)
    kept = simhash.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept) == [0, 1, 2] and set(kept[0].asDict()) == set(docs.columns)
    again = spark.createDataFrame([(7, "m n o")] * 3, "doc_id long, text string")
    assert [r.doc_id for r in simhash.keep_one(again).collect()] == [7]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [1, 3, 1000])
@pytest.mark.parametrize("radius", [1, 2])
def test_links_reach_every_pair(spark, hot, radius):
    rnd = random.Random(3)
    prints = set()
    for _ in range(12):
        base = rnd.getrandbits(64)
        for _ in range(25):
            base ^= sum(1 << b for b in rnd.sample(range(64), rnd.choice([1, 2, 3, 4])))
            prints.add(base - 2**64 if base >= 2**63 else base)
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    want = slow_components(prints, radius)
    found = simhash.links(frame, radius, hot)
    assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= radius for r in found.collect())
    got = {r.fp: r.root for r in simhash.grouped(frame, radius, hot).collect()}
    assert {p: got.get(p, p) for p in prints} == want


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 200), (139, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {300: 100}
