"""Counts after edits against encoding the edited text from scratch."""

import random

import public_tokenizers

from inkprint.llm import counts

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_random_edits():
    counter, rnd = counts.load(PATH, PATTERN), random.Random(8)
    parts = ["word", " ", "  ", "\n", "\n\n", "It's", "'ll", "123", "é字", "😀", " a", "!!", "\t", "x" * 40, "don't ", " "]
    for _ in range(400):
        text = "".join(rnd.choices(parts, k=rnd.choice([0, 1, 5, 60, 700])))
        tree = counts.Tree.plant(text, counter)
        assert tree.tokens[1] == len(counter.encoding.encode_ordinary(text)) and tree.chars[1] == len(text)
        for _ in range(6):
            start = rnd.randint(0, len(text))
            end = rnd.choice([start, min(len(text), start + rnd.randint(0, 30)), len(text)])
            put = "".join(rnd.choices(parts, k=rnd.choice([0, 1, 4, 300])))
            want = text[:start] + put + text[end:]
            text, _ = tree.edit(text, start, end, put, counter)
            assert text == want and tree.chars[1] == len(text)
            assert tree.tokens[1] == len(counter.encoding.encode_ordinary(text))
            for k in range(1, tree.width):
                assert tree.tokens[k] == tree.tokens[2 * k] + tree.tokens[2 * k + 1]
                assert tree.chars[k] == tree.chars[2 * k] + tree.chars[2 * k + 1]


def test_small_edits_encode_little():
    counter = counts.load(PATH, PATTERN)
    text = "some words and more words, " * 5000
    tree = counts.Tree.plant(text, counter)
    _, encoded = tree.edit(text, 60_000, 60_004, "other", counter)
    assert encoded <= 3 and tree.width > 500


def test_rows(spark):
    rows = [(1, "one two three", [(4, 7, "2"), (0, 3, None)]), (1, "one two three", None), (None, None, [(5, 9, "new")]),
            (3, "", []), (4, "word " * 60_000, [(9, 2, "!"), (10**6, 2 * 10**6, " end")]), (5, "abcdef", [(1, 4, "X"), (2, 3, "Y")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:int,end:int,put:string>>")
    docs = docs.selectExpr("*", "1 AS n_tokens")
    planted = counts.plant(docs, PATH, PATTERN, ["doc_id", "text", "edits"])
    got = counts.revise(planted, PATH, PATTERN).collect()
    enc = counts.load(PATH, PATTERN).encoding
    texts = {"one two three": 3, None: 0, "": 0}
    assert sorted(r.text for r in got) == sorted([" 2 three", "one two three", "new", "", "word word!" + " word" * 59_998 + "  end", "aXYdef"])
    for r in got:
        assert r.edited_tokens == len(enc.encode_ordinary(r.text)) == r.tree_tokens[1]
    assert counts.revise(planted.limit(0), PATH, PATTERN).count() == 0 and texts
