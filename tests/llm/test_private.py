"""Base spans against the plain patterns, discovered spans on a corpus with cue words."""

import hashlib
import random
import re

from inkprint.llm import private

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def slow_base(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    for m in private.IP.finditer(text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in private.CARD.finditer(text):
        d = [int(c) for c in m.group() if c.isdigit()]
        odd = sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])
        if 12 <= len(d) <= 19 and odd % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in private.PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_of_random_texts():
    rnd = random.Random(2)
    parts = ["a.b@c.de", "x@y", "@", "@@", "10.0.0.1", "999.1.1.1", "4111 1111 1111 1111", "4111-1111", "+1 (654) 555-4136",
             "+", "++49 30 1234567", "1.2.3.4.5.6.7.8", "é", " ", "\n", ".", "-", "(", "0", "7", "a@b.c.d@e.f", "٣٣٣", "000010.0.0.255"]
    for _ in range(6000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert private.base_spans(text)[0] == slow_base(text), text
    assert private.base_spans("a" * 300_000 + "@")[0] == []


def corpus():
    rnd, rows = random.Random(4), []
    for k in range(60):
        phone = f"+1 ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}"
        rows.append((k, f"words here {k % 7}, please phone office {phone} during the day"))
    rows += [(100, "so please phone office 654-555-4136 during the day"), (101, "in the year 19870 again"),
             (102, "please phone office tomorrow during the day"), (103, None), (104, ""), (None, "mail a@b.co now")]
    return rows


def test_cue_words_find_more(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' AS kind", "1L AS n_chars")
    got = {r.doc_id: r for r in private.find_private(docs).collect()}
    assert got[100].spans == "phone:23:35" and got[100].n_added == 1 and got[100].n_phone == 0
    assert [got[k].spans for k in (101, 102, 103, 104)] == [""] * 4
    assert got[None].spans == "email:5:11" and got[None].n_email == 1
    for i, text in rows:
        said = ",".join(f"{private.KINDS[k]}:{a}:{b}" for a, k, b in slow_base(text or ""))
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
    kept = {r.doc_id: r for r in private.redact(docs).collect()}
    assert kept[100].text == "so please phone office [PHONE] during the day" and kept[100].n_chars == len(kept[100].text)
    assert kept[103].text is None and kept[103].n_chars == 1 and kept[104].text == ""
    assert private.find_private(docs.limit(0)).count() == 0 and private.redact(docs.limit(0)).count() == 0


def test_overlapping_spans_become_one():
    assert private.masked("abcdefgh", [(1, 0, 4), (3, 2, 6), (7, 3, 8)]) == "a[EMAIL]g[PHONE]"


def test_numbers_in_groups_are_found_whole(spark):
    texts = [f"so please phone office {x} during the day" for x in ("654 555 4136", "(654) 555-4136", "654 5554136", "65455 4136")]
    docs = spark.createDataFrame(corpus() + [(200 + k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in private.find_private(docs).collect()}
    assert [got[200 + k] for k in range(4)] == [f"phone:23:{len(t) - 15}" for t in texts]
    kept = {r.doc_id: r.text for r in private.redact(docs).collect()}
    assert {kept[200 + k] for k in range(4)} == {"so please phone office [PHONE] during the day"}


def test_patterns_of_small_sources_count_in_a_large_corpus(spark):
    large = spark.range(50_000).selectExpr("id + 1000 AS doc_id", "repeat('a@b.co ', 26) AS text")
    rows = corpus()
    docs = large.union(spark.createDataFrame(rows[:12] + rows[60:], "doc_id long, text string"))
    assert private.find_private(docs).where("doc_id = 100").first().spans == "phone:23:35"


def test_joined_patterns_mark_the_same(spark):
    rows = corpus() + [(100, "so please phone office 654-555-4136 during the day"), (300, "please phone office 654 555 4136 during the day")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole, joined = (sorted(map(str, private.find_private(docs, limit=n).collect())) for n in (private.SENT_BYTES, 0))
    assert whole == joined and sum("n_added=1" in r for r in joined) == 3
    whole, joined = (sorted(map(str, private.redact(docs, limit=n).collect())) for n in (private.SENT_BYTES, 0))
    assert whole == joined
