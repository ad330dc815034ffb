"""Personal data: fixed base patterns and bootstrapped contextual extraction.

Base matches are the seeds. The words around them are lexical patterns; patterns and the things
found in them form a graph whose scores Spark refines from both sides. Patterns that nearly only
hold known identifiers of one kind then mark further identifiers, which no base pattern matches.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.llm.common import plain, slices
from inkprint.operators.common import join_dimension
from inkprint.session import materialize

KINDS = ["email", "ip", "card", "phone"]
# The base patterns of the contract.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Every match of the last three begins at a digit, or a plus sign before one, and stays in such a run.
NUMBERS = re.compile(r"\+?[0-9][0-9 ().+-]*")
LOCALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: A pattern counts from this confidence on, and with so many different known identifiers.
CONFIDENCE = 0.9
SUPPORT = 5
#: Accepted patterns are sent to all tasks up to so many bytes, and joined with the places beyond.
SENT_BYTES = 8 << 20
ROUNDS = 3
MIN_DIGITS = 5
TOKEN = re.compile(r"\S*[0-9@]\S*")
#: Numbers written in groups: one separator between two groups, besides brackets around one.
SPACED = re.compile(r"\+?\(?[0-9](?:(?:\)?[-. /\xa0\u202f]?\(?)[0-9])*")
MAX_DIGITS = 19
EDGES = ".,;:!?()[]{}<>\"'«»*#$%&|=“”„"


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in LOCALS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            after = domain.end()
            yield start, after
        at = text.find("@", max(at + 1, after))


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of base matches by start and kind, and of near misses: numbers of a card's
    length or an address's form that fail their check, so that they are known to be none."""
    good, failed = [(a, 0, b) for a, b in _emails(text)], []
    for run in NUMBERS.finditer(text):
        start, body = run.start(), run.group()
        if len(body) < 7:
            continue
        for kind, pattern in ((1, IP), (2, CARD), (3, PHONE)):
            for m in pattern.finditer(body):
                digits, missed = "".join(c for c in m.group() if c.isdigit()), True
                if kind == 1:
                    fits = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split("."))
                elif kind == 2:
                    missed = 12 <= len(digits) <= 19
                    fits = missed and _luhn(digits)
                else:
                    fits, missed = 9 <= len(digits) <= 15, False
                if fits or missed:
                    (good if fits else failed).append((start + m.start(), kind, start + m.end()))
    return sorted(good), failed


def _word_before(text: str, end: int) -> tuple[str, int]:
    while end > 0 and text[end - 1].isspace():
        end -= 1
    start = end
    while start > 0 and not text[start - 1].isspace() and end - start < 40:
        start -= 1
    return text[start:end].lower(), start


def _word_after(text: str, start: int) -> tuple[str, int]:
    n = len(text)
    while start < n and text[start].isspace():
        start += 1
    end = start
    while end < n and not text[end].isspace() and end - start < 40:
        end += 1
    return text[start:end].lower(), end


def patterns(text: str, start: int, end: int) -> list[str]:
    """The three lexical patterns of a place: two words before, one on each side, two after."""
    shape = "@" if "@" in text[start:end] else "9"
    one, at = _word_before(text, start)
    two, _ = _word_before(text, at)
    next1, at = _word_after(text, end)
    next2, _ = _word_after(text, at)
    return [f"{shape} {two} {one} _", f"{shape} {one} _ {next1}", f"{shape} _ {next1} {next2}"]


def places(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]], list[tuple[int, int]]]:
    """Base spans, other places of identifier form, and places that are known to be none.

    Others are numbers in groups, counted over all of them, and single tokens. A token inside such a
    number is a place of its own only if it has the form by itself."""
    base, failed = base_spans(text)
    if not base and "@" not in text and not any(c in text for c in "0123456789"):
        return [], [], []
    taken: list[list[int]] = []
    for a, b in sorted([(a, b) for a, _, b in base] + [(a, b) for a, _, b in failed]):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])

    def free(start: int, end: int, of: list) -> bool:
        k = bisect_left(of, end, key=lambda x: x[0]) - 1
        return k < 0 or of[k][1] <= start

    spaced = []
    for m in SPACED.finditer(text):
        start, end = m.span()
        if not (start and text[start - 1].isalnum() or text[end : end + 1].isalnum()) and free(start, end, taken):
            digits = sum(c.isdigit() for c in m.group())
            if MIN_DIGITS <= digits <= MAX_DIGITS and any(c.isspace() for c in m.group()):
                spaced.append((start, end))
    others = set(spaced)
    for m in TOKEN.finditer(text):
        start, end = m.span()
        while start < end and text[start] in EDGES:
            start += 1
        while end > start and text[end - 1] in EDGES:
            end -= 1
        if start < end and free(start, end, taken) and (free(start, end, spaced) or _is_form(text[start:end])):
            others.add((start, end))
    return base, sorted(others), sorted({(a, b) for a, _, b in failed} - {(a, b) for a, _, b in base})


def _is_form(text: str) -> bool:
    return "@" in text or sum(c.isdigit() for c in text) >= MIN_DIGITS


def graph(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(pattern, instance, kind, n): how often a pattern holds an instance. kind is that of a base
    match, -1 without one; instances are hashes of the lower-cased strings."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            rows = []
            for text in plain(part.column(text_col)).to_pylist():
                base, others, failed = places(text)
                spots = [(a, b, k) for a, k, b in base] + [(a, b, -1) for a, b in others + failed]
                for a, b, kind in spots:
                    key = int.from_bytes(hashlib.sha256(text[a:b].lower().encode()).digest()[:8], "big", signed=True)
                    rows += [(p, key, kind) for p in patterns(text, a, b)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int32()))],
                names=["pattern", "instance", "kind"],
            )

    found = docs.select(text_col).mapInArrow(work, "pattern string, instance long, kind int")
    return found.groupBy("pattern", "instance", "kind").agg(F.count("*").alias("n"))


def induce(
    docs: DataFrame, text_col: str = "text", confidence: float = CONFIDENCE, support: int = SUPPORT,
    rounds: int = ROUNDS,
) -> DataFrame:
    """(pattern, kind): accepted patterns and the kind that each marks.

    Seeds score 1 for their kind. A pattern's confidence in a kind is the score of its different
    instances over their number plus one; an instance that no base pattern matches takes the mean
    confidence of its patterns, and so lowers or lifts them in the next round. Only patterns that
    hold a seed matter, so the graph is cut to their neighbourhood at once.
    """
    edges = materialize(graph(docs, text_col))
    own = edges.where("kind >= 0").groupBy("pattern").agg(F.sum("n").alias("n")).where(F.col("n") >= support)
    near = materialize(edges.join(own.select("pattern"), "pattern", "left_semi"))
    known = near.where("kind >= 0").select("instance", "kind", F.lit(1.0).alias("score")).distinct()
    pairs = near.select("pattern", "instance").distinct()
    sizes = pairs.groupBy("pattern").agg(F.count("*").alias("size"))
    unknown = pairs.join(known.select("instance").distinct(), "instance", "left_anti")
    score, belief = known, None
    for _ in range(rounds):
        belief = pairs.join(score, "instance").groupBy("pattern", "kind").agg(
            F.sum("score").alias("weight"), F.sum((F.col("score") >= 1).cast("int")).alias("seeds")
        ).join(sizes, "pattern").select(
            "pattern", "kind", "seeds", (F.col("weight") / (F.col("size") + 1)).alias("belief")
        )
        belief = materialize(belief)
        # patterns that know nothing of a kind count with 0 in the mean
        met = unknown.groupBy("instance").agg(F.count("*").alias("size"))
        guess = unknown.join(belief, "pattern").groupBy("instance", "kind").agg(F.sum("belief").alias("b"))
        guess = guess.join(met, "instance").select("instance", "kind", (F.col("b") / F.col("size")).alias("score"))
        score = known.union(guess)
    best = belief.where((F.col("belief") >= confidence) & (F.col("seeds") >= support))
    # a confidence over a half leaves a pattern one kind
    return materialize(best.groupBy("pattern").agg(F.max_by("kind", "belief").alias("kind")))


def chosen(votes: list[tuple[int, int, list[int]]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of marked places (start, end, kinds its patterns mark). A place gets the kind that
    most of its patterns mark, the first listed among equals; of places that overlap, that with most
    patterns stays, then the longest."""
    out: list[tuple[int, int, int]] = []
    for a, b, kinds in sorted(votes, key=lambda v: (-len(v[2]), v[0] - v[1], v[0])):
        k = bisect_left(out, b, key=lambda x: x[0])
        if k == 0 or out[k - 1][2] <= a:
            out.insert(k, (a, min(kinds, key=lambda x: (-kinds.count(x), x)), b))
    return out


def spans_of(
    text: str, accepted: dict[str, int], votes: list | None = None
) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: (start, kind, end). Places are marked by accepted patterns, or their
    ``votes`` are given; near misses are never added."""
    base, others, _ = places(text)
    if votes is None:
        votes = []
        for a, b in others if accepted else ():
            kinds = [accepted[p] for p in patterns(text, a, b) if p in accepted] if _is_form(text[a:b]) else []
            if kinds:
                votes.append((a, b, kinds))
    return base, sorted(base + chosen(votes))


VOTES = "array<struct<start:int,end:int,kinds:array<int>>>"


def voted(docs: DataFrame, text_col: str, limit: int = SENT_BYTES, **induced) -> tuple[DataFrame, dict[str, int]]:
    """``docs`` with the column _votes, and the accepted patterns if they have at most ``limit`` bytes.

    More patterns stay a table. It is joined with the patterns of all places; the marked places of a
    text are gathered under its digest and joined with the rows, and _votes has them."""
    accepted = induce(docs, text_col, **induced)
    size = accepted.agg(F.sum(F.octet_length("pattern") + 100).alias("n")).first()["n"] or 0
    if size <= limit:
        return docs.withColumn("_votes", F.lit(None).cast(VOTES)), {r.pattern: r.kind for r in accepted.collect()}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = []
            for text, key in zip(plain(part.column("text")).to_pylist(), part.column("key").to_pylist()):
                for a, b in places(text)[1]:
                    if _is_form(text[a:b]):
                        rows += [(key, a, b, k, p) for k, p in enumerate(patterns(text, a, b))]
            kinds = (pa.string(), *[pa.int32()] * 3, pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                names=["key", "start", "end", "nth", "pattern"],
            )

    key = F.sha2(F.col(text_col), 256)
    texts = docs.select(F.col(text_col).alias("text"), key.alias("key")).where("text is not null")
    asked = texts.mapInArrow(ask, "key string, start int, end int, nth int, pattern string")
    # copies of a text ask the same, and once is enough
    marked = join_dimension(asked.distinct(), accepted, ["pattern"], ["key", "start"], materialized=True)
    of_place = marked.groupBy("key", "start", "end").agg(F.array_sort(F.collect_list("kind")).alias("kinds"))
    of_text = of_place.groupBy("key").agg(F.collect_list(F.struct("start", "end", "kinds")).cast(VOTES).alias("_votes"))
    keyed = docs.withColumn("_key", key)
    return keyed.join(of_text, keyed["_key"] == of_text["key"], "left").select(
        *(keyed[f"`{c}`"] for c in docs.columns), F.coalesce("_votes", F.array().cast(VOTES)).alias("_votes")
    ), {}


def _votes(part: pa.RecordBatch) -> list[list | None]:
    return [
        v if v is None else [(x["start"], x["end"], x["kinds"]) for x in v] for v in part.column("_votes").to_pylist()
    ]


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_private(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SENT_BYTES
) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row.

    Counts and digest are those of base spans; ``spans`` adds the discovered ones. Null and empty
    texts have none. Two passes over the texts; only patterns and hashes are shuffled, unless the accepted
    patterns are over ``limit`` bytes.
    """
    given, accepted = voted(docs.select(*dict.fromkeys([id_col, text_col])), text_col, limit)
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            rows = []
            for text, votes in zip(plain(part.column(text_col)).to_pylist(), _votes(part)):
                base, spans = spans_of(text, accepted, votes)
                counts = [sum(s[1] == k for s in base) for k in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(_said(base).encode()).hexdigest(), _said(spans), len(spans) - len(base)))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([part.column(id_col), *made], names=names)

    names = [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
    schema = f"`{id_col}` {kind}, " + ", ".join(f"n_{k} long" for k in KINDS)
    return given.mapInArrow(
        work, f"{schema}, base_sha256 string, spans string, n_added long"
    )


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with the kind's name in place of each span; spans that overlap become one."""
    out, after = [], 0
    for a, kind, b in spans:
        if a >= after:
            out += [text[after:a], f"[{KINDS[kind].upper()}]"]
        after = max(after, b)
    return "".join([*out, text[after:]])


def redact(
    docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars", limit: int = SENT_BYTES
) -> DataFrame:
    """All rows and columns, with personal data masked in the texts and the size column made anew.
    A null text stays null, with its size."""
    given, accepted = voted(docs, text_col, limit)
    names = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            texts = part.column(text_col).to_pylist()
            texts = [t and masked(t, spans_of(t, accepted, v)[1]) for t, v in zip(texts, _votes(part))]
            columns = {c: part.column(c) for c in names}
            columns[text_col] = pa.array(texts, part.column(text_col).type)
            if size_col in columns:
                old = columns[size_col].to_pylist()
                columns[size_col] = pa.array(
                    [n if t is None else len(t) for t, n in zip(texts, old)], columns[size_col].type
                )
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return given.mapInArrow(work, docs.schema)
