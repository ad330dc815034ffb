"""Main text of web pages by wrappers, inferred per host as union-free regular expressions.

A page's stream of tags and texts becomes a nested expression of elements and text slots. The
expressions of a host are aligned pairwise until one is left: where two don't match, the part that
one of them lacks becomes optional, and elements or runs of elements that follow each other become
repeated groups. So a wrapper has no alternatives, and every page of the host matches it. Its
text slots are labelled once; a page's texts take the labels of the slots they match. What the
pages of a host hold in a slot decides with the words of elements: texts that stand on most pages are
the host's own, and an element that holds nearly all other text isn't dropped for its name.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.llm.common import row_hash, slices
from inkprint.operators.common import join_dimension
from inkprint.session import materialize

# Elements of HTML by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg math".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr img".split()
)
DROPPED = RAW | set("head nav header footer aside form button select menu dialog object video audio canvas map".split())
MAIN = {"article", "main"}
WORDS = set(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "footer header menu modal nav navbar navigation newsletter notice notices popup promo related share sharing "
    "sidebar social sponsor sponsored subscribe toolbar widget".split()
)
# Words that name a part's shape or place and say nothing about what it holds.
SHAPES = set(
    "area bar bars block box btn button buttons col column container content count counter entry form group head holder icon icons "
    "inner item items label left line link links list main message meta module outer panel part post posts reader right row "
    "section site slot stories text this thread title top bottom unit user wrap wrapper zone".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("ul ol dl table body html article main section div".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SLOT = "#"
DEPTH = 60
PERIOD = 4
SALTS = 16
#: A text outside main regions is the host's own if its slot holds it on this share of the different pages, and on so many.
CONSTANT = 0.5
MIN_PAGES = 4
#: An element that holds this share of the host's other text is not dropped for its name or words.
HOLDS = 0.9


def stream(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, value): open with the words of class, id and role; close; and text, decoded."""
    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            yield "text", "", html.unescape(text)
        if not m:
            return
        at = m.end()
        name = (m[2] or "").lower()
        if m[1]:
            yield "close", name, ""
        elif name:
            words = " ".join("".join(g) for g in NAMED.findall(m[3])) if m[3] else ""
            yield "open", name, words.lower()
            if name in RAW and not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else n
                yield "close", name, ""


def symbol(name: str, words: str) -> str:
    """Element name, with the telling words of its class, id and role: behind a dot where they stand for
    themselves or with words of shape, behind a tilde where they are part of another name."""
    if not words or name in ("html", "body") or name in MAIN:
        return name
    parts = [[w for w in re.split(r"[^a-z0-9]+", token) if w] for token in words.split()]
    told = {w for own in parts if all(w in WORDS or w in SHAPES or w.isdigit() for w in own) for w in own} & WORDS
    if told:
        return ".".join([name, *sorted(told)])
    hinted = sorted({w for own in parts for w in own} & WORDS)
    return "~".join([name, *hinted]) if hinted else name


def is_dropped(sym: str, state: int = 0) -> bool:
    """Whether an element and all in it goes; inside the main region (``state`` 1) a mere hint isn't enough."""
    name, _, hint = sym.partition("~")
    return "." in sym or name in DROPPED or bool(hint) and state < 1


def walk(page: str) -> Iterator[tuple[str, str]]:
    """Events of the element tree: ("in", symbol), ("out", symbol), ("text", text), ("break", "").

    Inline elements only carry text, unless their words tell more. Elements that HTML closes by itself are closed;
    closing tags without an open element are skipped."""
    open_: list[tuple[str, str]] = []

    def close_to(depth: int) -> Iterator[tuple[str, str]]:
        while len(open_) > depth:
            yield "out", open_.pop()[1]

    for kind, name, value in stream(page):
        if kind == "text":
            yield "text", value
        elif kind == "open":
            sym = symbol(name, value)
            if name in VOID:
                if name in ("br", "hr"):
                    yield "break", ""
                continue
            if name in INLINE and sym == name:
                continue
            if name not in INLINE and open_ and open_[-1][0] == "p":
                yield from close_to(len(open_) - 1)
            if name in CLOSES:
                for k in range(len(open_) - 1, -1, -1):
                    if open_[k][0] in CLOSES[name]:
                        yield from close_to(k)
                        break
                    if open_[k][0] in SCOPES:
                        break
            open_.append((name, sym))
            yield "in", sym
        else:
            found = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == name), None)
            if found is not None:
                yield from close_to(found)
    yield from close_to(0)


# An expression is [symbol, items]; an item is [expression, optional, repeated]. "()" groups a run.


def expression(page: str) -> list:
    """The nested expression of a page. Elements below ``DEPTH`` levels count as their texts."""
    root: list = ["", []]
    stack, over = [root], 0
    for kind, value in walk(page):
        if kind == "in":
            if len(stack) > DEPTH:
                over += 1
                continue
            node: list = [value, []]
            stack[-1][1].append([node, False, False])
            stack.append(node)
        elif kind == "out":
            if over:
                over -= 1
            else:
                node = stack.pop()
                node[1] = folded(node[1])
        elif kind == "text" and value.strip():
            items = stack[-1][1]
            if not items or items[-1][0][0] != SLOT:
                items.append([[SLOT, []], False, False])
    root[1] = folded(root[1])
    return root


def folded(items: list) -> list:
    """Runs of up to ``PERIOD`` elements that follow each other become one repeated group."""
    out: list = []
    for item in items:
        out.append(item)
        again = True
        while again:
            again = False
            for p in range(1, PERIOD + 1):
                left, right = out[-2 * p : -p], out[-p:]
                if p > 1 and len(left) == p and all(a[0][0] == b[0][0] for a, b in zip(left, right)):
                    group = ["()", [[merged(a[0], b[0]), a[1] or b[1], a[2] or b[2]] for a, b in zip(left, right)]]
                    out[-2 * p :] = [[group, False, True]]
                    again = True
                    break
                if p == 1 and len(left) == 1 and left[0][0][0] == right[0][0][0] != "()":
                    out[-2:] = [[merged(left[0][0], right[0][0]), left[0][1] and right[0][1], True]]
                    again = True
                    break
                # one more round of the group that stands in front
                front = out[-p - 1] if len(out) > p else None
                if p > 1 and front and front[0][0] == "()" and len(front[0][1]) == p and all(
                    a[0][0] == b[0][0] for a, b in zip(front[0][1], right)
                ):
                    group = ["()", [[merged(a[0], b[0]), a[1] or b[1], a[2] or b[2]] for a, b in zip(front[0][1], right)]]
                    out[-p - 1 :] = [[group, front[1], True]]
                    again = True
                    break
    return out


def merged(a: list, b: list) -> list:
    """The expression that both match. Items are aligned by their longest common subsequence of symbols;
    those that one side lacks become optional."""
    if a == b:
        return a
    x, y = a[1], b[1]
    n, m = len(x), len(y)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            same = x[i][0][0] == y[j][0][0]
            best[i][j] = 1 + best[i + 1][j + 1] if same else max(best[i + 1][j], best[i][j + 1])
    items, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and x[i][0][0] == y[j][0][0]:
            items.append([merged(x[i][0], y[j][0]), x[i][1] or y[j][1], x[i][2] or y[j][2]])
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            items.append([x[i][0], True, x[i][2]])
            i += 1
        else:
            items.append([y[j][0], True, y[j][2]])
            j += 1
    return [a[0], folded(items)]


def shown(node: list) -> str:
    """The wrapper as a regular expression, for people."""
    inner = "".join(shown(e) + ("+" if r else "") + ("?" if o else "") for e, o, r in node[1])
    return SLOT if node[0] == SLOT else f"({inner})" if node[0] == "()" else f"<{node[0]}>({inner})"


def labelled(wrapper: list, held: frozenset = frozenset()) -> dict:
    """Per element of the wrapper: does its text belong to the article? Nested dicts by symbol, with the
    label at the empty key: 1 inside the main region, 0 outside, -1 in what is dropped. ``held`` are the
    paths of elements that hold nearly all text: outside the main region they aren't dropped."""

    def label(node: list, state: int, path: str, into: dict) -> None:
        for child, _, _ in node[1]:
            if child[0] == "()":
                label(child, state, path, into)
            elif child[0] != SLOT:
                here = f"{path}>{child[0]}"
                dropped = is_dropped(child[0], state) and not (state == 0 and here in held)
                own = -1 if state < 0 or dropped else 1 if state or child[0] in MAIN else 0
                label(child, own, here, into.setdefault(child[0], {"": own}))

    root: dict = {"": 0}
    label(wrapper, 0, "", root)
    return root


def blocks(page: str) -> Iterator[tuple[list[str], str]]:
    """The symbols above each block of text, outermost first, and the text."""
    run: list[str] = []
    path: list[str] = []
    for kind, value in walk(page):
        if kind == "text":
            run.append(value)
            continue
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            yield path, text
        if kind == "in":
            path.append(value)
        elif kind == "out":
            path.pop()
    text = " ".join("".join(run).split())
    if text:
        yield path, text


def slot_key(path: list[str], text: str) -> int:
    """Signed hash of a text in its slot. Slots below ``DEPTH`` levels count as one."""
    key = xxhash.xxh64_intdigest("\n".join([*path[:DEPTH], "", text]))
    return key - 2**64 if key >= 2**63 else key


def extract(page: str, labels: dict, constant: frozenset = frozenset()) -> str:
    """Texts of the page's main region, one line per block; of the whole body if the page has none.

    Inside a main region nothing goes for being constant. In a page without one the texts of ``constant`` slots
    go, unless they are over half of the page: then pages are copies of each other rather than filled into
    one frame."""
    inside: list[tuple[str, bool]] = []
    outside: list[tuple[str, bool]] = []
    run: list[str] = []
    path: list[str] = []
    stack = [labels]

    def flush() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text and stack[-1][""] >= 0:
            own = bool(constant) and slot_key(path, text) in constant
            (inside if stack[-1][""] else outside).append((text, own))

    found = False
    for kind, value in walk(page):
        if kind == "text":
            run.append(value)
            continue
        flush()
        if kind == "in":
            here = stack[-1]
            below = here.get(value)
            if below is None:  # below the depth that wrappers describe
                state = here[""]
                below = {"": -1 if state < 0 or is_dropped(value, state) else 1 if state or value in MAIN else 0}
            found = found or below[""] == 1
            stack.append(below)
            path.append(value)
        elif kind == "out":
            stack.pop()
            path.pop()
    flush()
    kept = inside if found else outside
    if not found and 2 * sum(len(t) for t, own in kept if own) <= sum(len(t) for t, _ in kept):
        kept = [x for x in kept if not x[1]]
    return "\n".join(t for t, _ in kept)


def host_of(url: str) -> object:
    """Host of a url column: what stands between // and the next /, lower case; empty without one."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[^/]*//([^/?#]*)", 1), F.lit("")))


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper): the aligned expression of all pages of each host, as JSON.

    Pages are reduced to their expressions and equal ones of a host counted once before anything is
    shuffled by host; those of one host are aligned in salted groups first, then across them.
    """

    def expressions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_html"):
            made = [json.dumps(expression(t or "")) for t in part.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("host"), pa.array(made, pa.string())], names=["host", "e"])

    def align(group: pd.DataFrame) -> pd.DataFrame:
        parts = [json.loads(e) for e in sorted(group["e"])]
        while len(parts) > 1:
            parts = [merged(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return pd.DataFrame({"host": [group["host"].iloc[0]], "e": [json.dumps(parts[0])]})

    kinds = "host string, e string"
    rows = pages.select(host_of(url_col).alias("host"), F.col(html_col).alias("_html"))
    rows = rows.mapInArrow(expressions, kinds).distinct()
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("e"), F.lit(SALTS)))
    once = salted.groupBy("host", "salt").applyInPandas(align, kinds)
    return once.groupBy("host").applyInPandas(align, kinds).select("host", F.col("e").alias("wrapper"))


def evidence(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, constant, held): keys of the texts that stand in one slot of most pages, and paths of the
    dropped elements that hold nearly all other text.

    Copies of a page count once. Texts are counted per slot and hash; what is gathered by host is at most
    1 / CONSTANT times the blocks of a page, and a chain of elements."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_html"):
            rows = []
            for host, page in zip(part.column("host").to_pylist(), part.column("_html").to_pylist()):
                key = xxhash.xxh64_intdigest(page or "") >> 1
                seen = {}
                for path, text in blocks(page or ""):
                    slot = slot_key(path, text)
                    if slot not in seen:
                        above = [k + 1 for k, sym in enumerate(path[:DEPTH]) if is_dropped(sym)]
                        seen[slot] = (host, key, slot, len(text), ["".join(f">{x}" for x in path[:k]) for k in above])
                rows += seen.values()
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                names=["host", "page", "slot", "chars", "above"],
            )

    rows = pages.select(host_of(url_col).alias("host"), F.col(html_col).alias("_html")).mapInArrow(
        texts, "host string, page long, slot long, chars long, above array<string>"
    )
    # a slot's key stands for its text and path, so that these are the same in all of its rows
    once = rows.groupBy("host", "slot", "page").agg(F.first("chars").alias("chars"), F.first("above").alias("above"))
    counted = once.groupBy("host", "slot").agg(
        F.count("*").alias("n"), F.first("chars").alias("chars"), F.first("above").alias("above")
    )
    # slots of fewer pages only add to the text of the elements above them
    slot = F.when(F.col("n") >= MIN_PAGES, F.col("slot")).alias("slot")
    counted = materialize(counted.groupBy("host", slot, "above").agg(
        F.max("n").alias("n"), F.sum(F.col("n") * F.col("chars")).alias("mass")
    ))
    different = pages.select(host_of(url_col).alias("host"), F.xxhash64(F.col(html_col)).alias("page")).distinct()
    size = materialize(different.groupBy("host").agg(F.count("*").alias("pages")))
    often = F.col("n") >= F.greatest(F.lit(MIN_PAGES), F.col("pages") * CONSTANT)
    told = join_dimension(counted, size, ["host"], ["slot"], materialized=True)
    constant = told.where(often).groupBy("host").agg(F.collect_list("slot").alias("constant"))
    other = told.where(~often)
    whole = other.groupBy("host").agg(F.sum("mass").alias("whole"))
    held = other.select("host", "mass", F.explode("above").alias("path")).groupBy("host", "path").agg(
        F.sum("mass").alias("mass")
    ).join(whole, "host").where(F.col("mass") >= F.col("whole") * HOLDS)
    held = held.groupBy("host").agg(F.collect_list("path").alias("held"))
    return size.select("host").join(constant, "host", "left").join(held, "host", "left")


def main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(id, url, text, n_chars) of every page: blocks in page order, one per line.

    Null html is empty, null urls are one host without name; repeated pages stay. Wrappers are joined
    by host and salt, so that a host with many pages is spread.
    """
    wrappers = infer(pages, url_col, html_col).join(evidence(pages, url_col, html_col), "host", "left")
    wrappers = wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
        host_of(url_col).alias("host"), F.pmod(row_hash(pages, [id_col, url_col]), F.lit(SALTS)).cast("int").alias("salt"),
    ).join(wrappers, ["host", "salt"]).select("id", "url", "html", "wrapper", "constant", "held")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, dict] = {}
        for part in slices(batches, "html"):
            texts = []
            columns = (part.column(c).to_pylist() for c in ("html", "wrapper", "constant", "held"))
            for page, wrapper, constant, held in zip(*columns):
                key = (wrapper, frozenset(constant or ()), frozenset(held or ()))
                if key not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[key] = labelled(json.loads(wrapper), key[2])
                texts.append(extract(page or "", known[key], key[1]))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"],
            )

    return rows.mapInArrow(work, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
