"""Ranked lexical search of many items at once: shared partial scores, combined along a graph of items."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.llm.common import bounds, buffers, plain, slices
from inkprint.llm.vectors import arrow_schema
from inkprint.operators.common import top_k
from inkprint.session import materialize

#: Items are planned and searched in blocks of about so many bytes of text, the size of what is broadcast.
BLOCK_BYTES = 4 << 20
#: Rows without a term of their own in the counting pass: documents with a term, and all their terms.
DOCUMENTS, TERMS = -1, -2
#: Letters and digits of ASCII and whatever is beyond it make terms, A-Z lower-cased; the rest parts them.
LETTERS = np.array(
    [c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)],
    dtype=np.uint8,
)


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Terms of all texts, one after the other, and their number per text (null: none)."""
    data, at = buffers(plain(texts))
    folded = pa.LargeStringArray.from_buffers(
        len(texts), pa.py_buffer(np.ascontiguousarray(at, dtype=np.int64)), pa.py_buffer(LETTERS[data])
    )
    lists = pc.ascii_split_whitespace(folded)
    flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    keep = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(keep), np.bincount(np.asarray(parents.filter(keep)), minlength=len(texts)).astype(np.int64)


@dataclass
class Plan:
    """How a block of items shares its work.

    Terms that stand in exactly the same items form an atom, a shared term set whose partial score a
    document gets once. Atoms of an item, those of most items first, are a path in a prefix graph:
    a node is the sum of its parent and one atom, so that items with a common prefix share its sums.
    """

    ids: list
    vocabulary: list[str] = field(default_factory=list)
    atom_of: np.ndarray = None  # atom of each term
    depth: list[int] = field(default_factory=list)  # nodes, every parent before its children
    atom: list[int] = field(default_factory=list)
    ends: list[list[int]] = field(default_factory=list)  # items whose sum a node is

    @staticmethod
    def of(rows: list[tuple]) -> Plan:
        flat, per = terms(pa.array([t for _, t in rows], pa.string()))
        words, at = flat.to_pylist(), bounds(per)
        holders: dict[str, list[int]] = {}
        for item in range(len(rows)):
            for word in set(words[at[item] : at[item + 1]]):
                holders.setdefault(word, []).append(item)
        sets: dict[tuple[int, ...], list[str]] = {}
        for word in sorted(holders):
            sets.setdefault(tuple(holders[word]), []).append(word)
        shared = sorted(sets, key=lambda items: (-len(items), items))
        plan = Plan([i for i, _ in rows], sorted(holders))
        atom_of = {word: a for a, items in enumerate(shared) for word in sets[items]}
        plan.atom_of = np.array([atom_of[w] for w in plan.vocabulary], dtype=np.int64)
        paths: list[list[int]] = [[] for _ in rows]
        for a, items in enumerate(shared):
            for item in items:
                paths[item].append(a)
        before: list[int] = []
        for item in sorted((k for k in range(len(rows)) if paths[k]), key=paths.__getitem__):
            path = paths[item]
            same = next((k for k, (x, y) in enumerate(zip(path, before)) if x != y), min(len(path), len(before)))
            for k in range(same, len(path)):
                plan.depth.append(k)
                plan.atom.append(path[k])
                plan.ends.append([])
            plan.ends[-1].append(item)
            before = path
        return plan

    def count(self, batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
        """(term, n): documents that hold each term of the block; sums of a whole partition."""
        values = pa.array(self.vocabulary, pa.large_string())
        held, documents, total = np.zeros(len(self.vocabulary), dtype=np.int64), 0, 0
        for part in slices(batches, text_col):
            flat, per = terms(part.column(text_col))
            doc, term = _inside(flat, per, values)
            held += np.bincount(np.unique(doc * len(values) + term) % max(1, len(values)), minlength=len(values))
            documents += int((per > 0).sum())
            total += int(per.sum())
        seen = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array([DOCUMENTS, TERMS, *seen.tolist()], pa.int64()),
             pa.array([documents, total, *held[seen].tolist()], pa.int64())], names=["term", "n"],
        )

    def sums(self, texts: pa.Array, weights: np.ndarray, documents: int, total: int):
        """(node's items, score of each text) of every node that ends an item."""
        flat, per = terms(texts)
        doc, term = _inside(flat, per, pa.array(self.vocabulary, pa.large_string()))
        key, tf = np.unique(doc * max(1, len(self.vocabulary)) + term, return_counts=True)
        doc, term = np.divmod(key, max(1, len(self.vocabulary)))
        big = int(per.max(initial=0)) * 90 * documents >= 1 << 63
        grown = per.astype(object) if big else per
        m = (10 + grown * (90 * documents) // max(total, 1)).astype(np.int64)
        own = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        # one partial score per atom and text
        place = self.atom_of[term] * len(per) + doc
        order = np.argsort(place, kind="stable")
        place, first = np.unique(place[order], return_index=True)
        parts = np.add.reduceat(own[order], first) if len(first) else own
        atoms, where = np.divmod(place, max(1, len(per)))
        at = np.searchsorted(atoms, np.arange(int(self.atom_of.max(initial=-1)) + 2))
        nothing = np.zeros(len(per), dtype=np.int64)
        path: list[np.ndarray] = []
        for depth, atom, items in zip(self.depth, self.atom, self.ends):
            del path[depth:]
            score = path[-1] if path else nothing
            if at[atom] < at[atom + 1]:
                score = score.copy()
                score[where[at[atom] : at[atom + 1]]] += parts[at[atom] : at[atom + 1]]
            path.append(score)
            if items:
                yield items, score


def _inside(flat: pa.Array, per: np.ndarray, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text and number of each term that the block's items hold."""
    found = pc.index_in(flat.cast(pa.large_string()), value_set=values)
    here = np.asarray(found.is_valid())
    return np.repeat(np.arange(len(per)), per)[here], np.asarray(found.drop_null(), dtype=np.int64)


def _blocks(items: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple]]:
    """Rows of the items that have a text, in blocks of bounded size."""
    some = items.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).where("t is not null")
    total = some.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    count = max(1, ceil(total / limit))
    for k in range(count):
        rows = some.where(F.pmod(F.xxhash64("t", "i"), F.lit(count)) == k)
        yield [tuple(r) for r in rows.orderBy("i", "t").collect()]


def weight(documents: int, holding: int) -> int:
    return floor(1000 * log((2 * documents + 2) / (2 * holding + 1)))


def rank(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", limit: int = BLOCK_BYTES,
) -> DataFrame:
    """(item, rank, id, score): the ``k`` documents of the highest score above 0 for each item, equal
    scores by rising id.

    Terms are runs of letters, digits and whatever is beyond ASCII, A-Z lower-cased. With N documents
    that have a term, L terms in them and n in one document, a term held by df of them weighs
    floor(1000 ln((2N + 2) / (2df + 1))), and a document gets weight * (10^9 tf div (1000 tf + 8 m)) for
    each of the item's terms it holds, with m = 10 + 90 n N div L; all but the weight is whole.

    Null and empty texts hold nothing; items without terms have no rows. Repeated documents are ranked
    each (a null id after the others), repeated items have their rows again. Other columns don't matter.

    Items are planned in blocks of bounded text. Documents are never shuffled: a task keeps the first k of
    each item over its whole partition, and those are ranked in two steps.
    """
    kinds = [items.schema[item_col].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()]
    schema = f"item long, `{item_col}` {kinds[0]}, `{id_col}` {kinds[1]}, score long"
    form = arrow_schema(docs, schema)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def search(rows: list[tuple]) -> DataFrame:
        plan = Plan.of(rows)
        counted = texts.select("text").mapInArrow(lambda b: plan.count(b, "text"), "term long, n long")
        counts = {r["term"]: r["n"] for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        documents, total = counts.get(DOCUMENTS, 0), counts.get(TERMS, 0)
        weights = np.array(
            [weight(documents, counts.get(t, 0)) for t in range(len(plan.vocabulary))], dtype=np.int64
        )

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, list[tuple]] = {}
            for part in slices(batches, "text"):
                ids = part.column("id")
                order = np.empty(len(ids), dtype=np.int64)
                order[np.asarray(pc.array_sort_indices(ids, null_placement="at_end"))] = np.arange(len(ids))
                for found, score in plan.sums(part.column("text"), weights, documents, total):
                    mine = best.get(found[0], [])
                    least = -mine[-1][0] if len(mine) >= k else 1
                    hits = np.flatnonzero(score >= least)
                    if not len(hits):
                        continue
                    hits = hits[np.lexsort((order[hits], -score[hits]))[:k]]
                    more = zip((-score[hits]).tolist(), ids.take(pa.array(hits)).to_pylist())
                    mine = sorted([*mine, *((s, i is None, i) for s, i in more)], key=_order)[:k]
                    best.update((item, mine) for item in found)
            out = [(i, plan.ids[i], doc, -s) for i, mine in best.items() for s, _, doc in mine]
            columns = [[r[c] for r in out] for c in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, form)], schema=form)

        found = texts.mapInArrow(work, schema)
        ranked = top_k(found, ["item"], [F.desc("score"), F.asc_nulls_last(id_col)], k, [id_col, "score"])
        return materialize(ranked.select(item_col, "rank", id_col, "score"))

    return reduce(DataFrame.union, [search(rows) for rows in _blocks(items, item_col, item_text, limit)])


def _order(row: tuple) -> tuple:
    score, late, doc = row
    return (score, late, 0 if late else doc)
