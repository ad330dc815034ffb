"""Benchmark passages inside documents: MinHash containment search and exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil, floor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.llm.common import buffers, bounds, plain, slices
from inkprint.llm.vectors import arrow_schema

SHINGLE = 5
SIMILARITY = 0.8
#: Items are searched in blocks of about so many bytes of text, the size of what is broadcast.
BLOCK_BYTES = 16 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
LETTERS = np.array(
    [c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)],
    dtype=np.uint8,
)


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words, split at white space and punctuation of ASCII, and their number per text."""
    lower = pc.utf8_lower(plain(texts))
    data, at = buffers(lower)
    folded = pa.LargeStringArray.from_buffers(
        len(lower), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(LETTERS[data])
    )
    lists = pc.ascii_split_whitespace(folded)
    flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    keep = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(keep), np.bincount(np.asarray(parents.filter(keep)), minlength=len(texts))


def word_hashes(flat: pa.Array) -> np.ndarray:
    coded = flat.dictionary_encode()
    own = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    return own[np.asarray(coded.indices)] if len(own) else np.zeros(0, dtype=np.uint64)


def shingle_hashes(hashes: np.ndarray, per: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside a text, and the text of each."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = (out ^ hashes[k : k + n]) * MIX
        out ^= out >> np.uint64(29)
    owner = np.repeat(np.arange(len(per)), per)
    inside = owner[:n] == owner[width - 1 :]
    return out[inside], owner[:n][inside]


def exact_shingles(tokens: list[str], width: int) -> set[tuple[str, ...]]:
    return set(zip(*(tokens[k:] for k in range(width))))


@dataclass
class Block:
    """Some benchmark items, ready to be looked up.

    Items are partitioned by their number of distinct shingles n, up to 2, 4, 8, ... An item is
    sketched by its smallest hashes, as many as the largest item of its partition may lack plus one:
    a document that holds the asked share of its shingles then holds at least one of the sketch,
    whatever its length, so the search misses nothing.
    """

    ids: list
    shingles: list[set[tuple[str, ...]]]
    widths: np.ndarray
    sketch: dict[int, tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of(rows: list[tuple], width: int, similarity: float) -> Block:
        ids, shingles, widths, found = [], [], [], []
        for item, text in rows:
            flat, per = words(pa.array([text], pa.string()))
            if not len(flat):
                continue
            w = min(width, len(flat))
            hashes = np.unique(shingle_hashes(word_hashes(flat), per, w)[0])
            # a share of a text equal to the largest size of the partition may be missing
            largest = 1 << max(0, ceil(np.log2(len(hashes))))
            lack = floor((1 - similarity) * largest + 1e-9)
            smallest = hashes[np.argsort(hashes * MIX)[: lack + 1]]
            found += [(w, int(h), len(ids)) for h in smallest]
            ids.append(item)
            widths.append(w)
            shingles.append(exact_shingles(flat.to_pylist(), w))
        sketch = {}
        for w in sorted(set(widths)):
            own = sorted((h, i) for v, h, i in found if v == w)
            sketch[w] = (np.array([h for h, _ in own], np.uint64), np.array([i for _, i in own], np.int64))
        return Block(ids, shingles, np.array(widths, dtype=np.int64), sketch)

    def search(self, texts: pa.Array, similarity: float) -> list[tuple[int, int, int]]:
        """(text, item, shared shingles) of all pairs with the asked containment."""
        flat, per = words(texts)
        hashes = word_hashes(flat)
        pairs = []
        for w, (keys, items) in self.sketch.items():
            own, owner = shingle_hashes(hashes, per, w)
            low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            for p in np.flatnonzero(high > low).tolist():
                pairs += [(int(owner[p]), i) for i in items[low[p] : high[p]].tolist()]
        at, out, seen = bounds(per), [], {}
        for text, item in sorted(set(pairs)):
            w = int(self.widths[item])
            if (text, w) not in seen:
                seen = {(text, w): exact_shingles(flat[at[text] : at[text + 1]].to_pylist(), w)} | {
                    k: v for k, v in seen.items() if k[0] == text}
            shared = len(self.shingles[item] & seen[text, w])
            if shared >= similarity * len(self.shingles[item]) - 1e-9:
                out.append((text, item, shared))
        return out


def blocks(
    items: DataFrame, id_col: str, text_col: str, width: int, similarity: float, limit: int = BLOCK_BYTES
) -> Iterator[Block]:
    """The items in blocks of bounded size, by the hash of their text."""
    some = items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null")
    total = some.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    count = max(1, ceil(total / limit))
    for k in range(count):
        rows = some.where(F.pmod(F.xxhash64("t", "i"), F.lit(count)) == k).collect()
        yield Block.of([tuple(r) for r in rows], width, similarity)


def find_passages(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", width: int = SHINGLE, similarity: float = SIMILARITY,
) -> DataFrame:
    """(id, item, n_shared, containment) for every document that holds at least ``similarity`` of the
    distinct word shingles of an item.

    Case and punctuation don't count. Items of fewer words than a shingle are one shingle; items
    without words, null texts and empty texts match nothing. Repeated rows give repeated pairs.
    Documents are read once per block of items and never shuffled.
    """
    kinds = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {kinds[0]}, `{item_col}` {kinds[1]}, n_shared long, containment double"

    def search(block: Block) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, text_col):
                hits = block.search(part.column(text_col), similarity)
                ids = part.column(id_col).take(pa.array([t for t, _, _ in hits], pa.int64()))
                item = pa.array([block.ids[i] for _, i, _ in hits]).cast(item_type)
                shared = [s for _, _, s in hits]
                share = [s / len(block.shingles[i]) for _, i, s in hits]
                yield pa.RecordBatch.from_arrays(
                    [ids, item, pa.array(shared, pa.int64()), pa.array(share, pa.float64())],
                    names=[id_col, item_col, "n_shared", "containment"],
                )

        return docs.select(id_col, text_col).mapInArrow(work, schema)

    item_type = arrow_schema(docs, schema).field(item_col).type
    found = [search(b) for b in blocks(items, item_col, item_text, width, similarity)]
    return reduce(DataFrame.union, found)


def drop_contaminated(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", width: int = SHINGLE, similarity: float = SIMILARITY,
) -> DataFrame:
    """The documents without those that hold an item, all columns kept."""
    schema = docs.schema

    def without(block: Block, rest: DataFrame) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, text_col):
                clean = np.ones(part.num_rows, dtype=bool)
                clean[[t for t, _, _ in block.search(part.column(text_col), similarity)]] = False
                yield part.filter(pa.array(clean))

        return rest.mapInArrow(work, schema)

    for block in blocks(items, item_col, item_text, width, similarity):
        docs = without(block, docs)
    return docs
