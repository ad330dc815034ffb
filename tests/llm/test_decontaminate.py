"""Containment search against brute force."""

import random

from inkprint.llm import decontaminate


def slow_words(text):
    return "".join(c if c.isdigit() or c.isalpha() or ord(c) > 127 else " " for c in (text or "").lower()).split(" ")


def slow_pairs(docs, items):
    out = []
    for i, text in items:
        words = [w for w in slow_words(text) if w]
        width = min(5, len(words))
        own = {tuple(words[k:k + width]) for k in range(len(words) - width + 1)} if words else set()
        for d, body in docs:
            said = [w for w in slow_words(body) if w]
            have = {tuple(said[k:k + width]) for k in range(len(said) - width + 1)}
            if own and len(own & have) >= 0.8 * len(own) - 1e-9:
                out.append((d, i, len(own & have)))
    return sorted(out, key=str)


def test_pairs_and_kept_documents(spark, monkeypatch):
    rnd = random.Random(1)
    some = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rnd.choices(some, k=rnd.choice([1, 3, 5, 8, 30, 60])))) for k in range(40)]
    items += [(90, None), (91, ""), (92, " .. "), (93, items[0][1])]
    docs = []
    for k in range(120):
        words = rnd.choices(some, k=rnd.choice([0, 4, 200, 3000]))
        item = rnd.choice(items)[1]
        if item and k % 2:
            piece = item.upper().split(" ")
            for _ in range(rnd.choice([0, 0, 1, 2])):
                piece[rnd.randrange(len(piece))] = "other"
            words[5:5] = piece
        docs.append((k, ", ".join(words)))
    docs += [(500, None), (501, ""), (3, docs[3][1])]
    left = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS item_id")
    right = spark.createDataFrame(items, "item_id long, text string")
    want = slow_pairs(docs, items)
    assert want
    for limit in (1 << 24, 1000):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", limit)
        monkeypatch.setattr(decontaminate.blocks, "__defaults__", (limit,))
        got = decontaminate.find_passages(left, right).collect()
        assert sorted(((r.doc_id, r.item_id, r.n_shared) for r in got), key=str) == want
        kept = decontaminate.drop_contaminated(left, right)
        bad = {d for d, _, _ in want}
        assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d not in bad)
        assert kept.columns == left.columns
    assert decontaminate.find_passages(left, right.limit(0)).count() == 0
    assert decontaminate.find_passages(left.limit(0), right).count() == 0


def test_items_of_any_kind_of_id(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    for kind in ("smallint", "int", "string", "decimal(5,0)"):
        items = spark.createDataFrame([("7", "b c d e f")], "i string, text string").selectExpr(f"CAST(i AS {kind}) AS item_id", "text")
        got = decontaminate.find_passages(docs, items)
        assert got.schema["item_id"].dataType.simpleString() == kind and [str(r.item_id) for r in got.collect()] == ["7"]
