"""Token counts that follow edits.

A document's text is split into pre-tokens, which byte-pair encoding never joins. Runs of them are
the leaves of a segment tree that sums characters and tokens. An edit encodes only the leaves that
it touches, with some characters before it, on to the next leaf where the old and the new
split meet again; then the sums above those leaves are put right.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from inkprint.llm.common import slices

LEAF = 32
#: A leaf that edits have made larger than this has its tree laid out anew.
LARGE = 4 * LEAF
#: A pre-token looks at most two characters past its end: one that stops it, and behind white space the
#: next word. A split can change from two characters before an edit on.
REACH = 2
CACHE = 1_000_000


class Counter:
    """Splits texts into pre-tokens and counts the tokens of each."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            n = self.known[piece] = len(self.encoding.encode_ordinary(piece))
        return n


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


class Tree:
    """Heap of sums: node 1 is the whole text, the last ``width`` nodes are the leaves."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.chars, self.tokens, self.width = chars, tokens, len(chars) // 2

    @staticmethod
    def of(leaf_chars: list[int], leaf_tokens: list[int]) -> Tree:
        width = 1
        while width < len(leaf_chars):
            width *= 2
        spare = [0] * (width - len(leaf_chars))
        chars, tokens = [0] * width + leaf_chars + spare, [0] * width + leaf_tokens + spare
        for k in range(width - 1, 0, -1):
            chars[k] = chars[2 * k] + chars[2 * k + 1]
            tokens[k] = tokens[2 * k] + tokens[2 * k + 1]
        return Tree(chars, tokens)

    @staticmethod
    def plant(text: str, counter: Counter) -> Tree:
        return Tree.of(*_leaves(counter.pattern.findall(text), counter, LEAF))

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and where the leaf begins."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if place >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.width, start

    def edit(self, old: str, start: int, end: int, put: str, counter: Counter) -> tuple[str, int]:
        """Replace ``old[start:end]``. The new text, and how many leaves were encoded."""
        new, delta = old[:start] + put + old[end:], len(put) - (end - start)
        first, begin = self.leaf_at(max(0, start - REACH))
        last, stop = first, begin + self.chars[self.width + first]
        pieces, place = [], begin
        for m in counter.pattern.finditer(new, begin):
            place = m.start()
            while last + 1 < self.width and (stop < end or stop + delta < place):
                last += 1
                stop += self.chars[self.width + last]
            if stop >= end and place == stop + delta:
                break
            pieces.append(m.group())
        else:  # no split is met again: everything up to the end is new
            last = self.width - 1
        share = max(1, -(-len(pieces) // (last - first + 1)))
        chars, tokens = _leaves(pieces, counter, share)
        if share > LARGE:
            near = slice(self.width + first, self.width + last + 1)
            every = [self.chars[self.width :], self.tokens[self.width :]]
            chars, tokens = _leaves(pieces, counter, LEAF)
            for whole, part in zip(every, (chars, tokens)):
                whole[near.start - self.width : near.stop - self.width] = part
            fresh = Tree.of(*map(list, zip(*[x for x in zip(*every) if x[0]] or [(0, 0)])))
            self.chars, self.tokens, self.width = fresh.chars, fresh.tokens, fresh.width
            return new, len(chars)
        nodes = range(self.width + first, self.width + last + 1)
        for k, node in enumerate(nodes):
            self.chars[node] = chars[k] if k < len(chars) else 0
            self.tokens[node] = tokens[k] if k < len(tokens) else 0
        low, high = nodes[0] // 2, nodes[-1] // 2
        while low:
            for node in range(low, high + 1):
                self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
                self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
            low, high = low // 2, high // 2
        return new, len(nodes)


def _leaves(pieces: list[str], counter: Counter, size: int) -> tuple[list[int], list[int]]:
    known = counter.known
    counts = [known[p] if p in known else counter.count(p) for p in pieces]
    lengths = list(map(len, pieces))
    at = range(0, len(pieces), size) if pieces else [0]
    return [sum(lengths[k : k + size]) for k in at], [sum(counts[k : k + size]) for k in at]


def plant(
    docs: DataFrame, path: str, pattern: str, keep: list[str], text_col: str = "text"
) -> DataFrame:
    """``keep`` columns of every row with the segment tree of its whole text: sums of characters and
    tokens, as heaps (``tree_chars``, ``tree_tokens``). Element 1 of the latter is the count. Null texts
    are empty."""
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path, pattern)
        for part in slices(batches, text_col):
            trees = [Tree.plant(t or "", counter) for t in part.column(text_col).to_pylist()]
            lists = [pa.array([getattr(t, f) for t in trees], pa.list_(pa.int32())) for f in ("chars", "tokens")]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in keep), *lists], names=[*keep, "tree_chars", "tree_tokens"]
            )

    columns = list(dict.fromkeys([*keep, text_col]))
    return docs.select(*columns).mapInArrow(work, f"{kept}, tree_chars array<int>, tree_tokens array<int>")


def revise(
    planted: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    edits_col: str = "edits",
) -> DataFrame:
    """Apply edits to texts with planted trees: (id, n_tokens, edited_tokens, n_leaves, n_encoded, text,
    tree_chars, tree_tokens), the last three after the edits.

    ``edits`` are (start, end, put) in code points of the old text, applied from the last start to the
    first; places beyond the text are moved to its end, and an edit ends where the one behind it begins
    at the latest. No edits, or null: nothing changes.
    """
    kind = planted.schema[id_col].dataType.simpleString()
    names = ["n_tokens", "edited_tokens", "n_leaves", "n_encoded", "text", "tree_chars", "tree_tokens"]
    types = [*[pa.int64()] * 4, pa.string(), *[pa.list_(pa.int32())] * 2]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path, pattern)
        for part in slices(batches, text_col):
            rows = []
            inputs = (part.column(c).to_pylist() for c in (text_col, edits_col, "tree_chars", "tree_tokens"))
            for text, edits, chars, tokens in zip(*inputs):
                text, tree, before, encoded = text or "", Tree(chars, tokens), tokens[1], 0
                leaves, bound = sum(c > 0 for c in chars[len(chars) // 2 :]), len(text)
                for e in sorted(edits or [], key=lambda e: (e["start"], e["end"]), reverse=True):
                    start = max(0, min(e["start"], bound))
                    end = max(start, min(e["end"], bound))
                    text, n = tree.edit(text, start, end, e["put"] or "", counter)
                    bound, encoded = start, encoded + n
                rows.append((before, tree.tokens[1], leaves, encoded, text, tree.chars, tree.tokens))
            made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([part.column(id_col), *made], names=[id_col, *names])

    schema = f"`{id_col}` {kind}, " + ", ".join(f"{n} long" for n in names[:4])
    return planted.select(id_col, text_col, edits_col, "tree_chars", "tree_tokens").mapInArrow(
        work, f"{schema}, text string, tree_chars array<int>, tree_tokens array<int>"
    )
