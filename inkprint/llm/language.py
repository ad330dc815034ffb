"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts with the counts of what followed them. A byte costs what
its longest known context says; where the context doesn't know it, an escape is paid and the next
shorter context is asked, down to all 256 bytes alike. The statistics are frozen, so the cost of a
byte depends on the bytes before it only, and a text's code length is a sum of table entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.llm.common import bounds, buffers, held_out, plain, slices
from inkprint.operators.common import top_k

ORDER = 3
#: The trees of a language are fitted on at most so many whole texts, those with the smallest hash of
#: their id.
MAX_TEXTS = 1500
FOLDS, FOLD = 3, 1
UNKNOWN = "und"
CELLS = 4 << 20


def grams(texts: pa.Array, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of the lower-cased texts with the ``order`` bytes before it, as one number, and the
    offsets of the texts. Before a text there are spaces."""
    data, at = buffers(plain(pc.utf8_lower(plain(texts))))
    size = np.diff(at)
    # every text gets its own spaces in front
    wide = np.full(len(data) + order * len(size), 32, dtype=np.uint64)
    place = np.arange(len(data)) + order * (np.repeat(np.arange(len(size)), size) + 1)
    wide[place] = data
    key = np.zeros(len(data), dtype=np.uint64)
    for back in range(order, -1, -1):
        key = (key << np.uint64(8)) | wide[place - back]
    return key, at


@dataclass
class ContextTrees:
    """Per order: known contexts with escape costs, known grams with costs, in bits per language."""

    languages: list[str]
    order: int
    contexts: list[tuple[np.ndarray, np.ndarray]]
    known: list[tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of(rows: list[tuple[str, int, int]], order: int = ORDER) -> ContextTrees:
        """From (language, gram, count)."""
        languages = sorted({r[0] for r in rows})
        at = {name: k for k, name in enumerate(languages)}
        keys = np.array([r[1] for r in rows], dtype=np.uint64)
        of = np.array([at[r[0]] for r in rows], dtype=np.int64)
        count = np.array([r[2] for r in rows], dtype=np.float64)
        made = ContextTrees(languages, order, [], [])
        for k in range(order + 1):
            short = keys & np.uint64((1 << 8 * (k + 1)) - 1)
            known, place = np.unique(short, return_inverse=True)
            seen = np.zeros((len(known), len(languages)))
            np.add.at(seen, (place, of), count)
            contexts, above = np.unique(known >> np.uint64(8), return_inverse=True)
            total = np.zeros((len(contexts), len(languages)))
            kinds = np.zeros_like(total)
            np.add.at(total, above, seen)
            np.add.at(kinds, above, seen > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, np.log2((total + kinds) / kinds), 0)
                own = np.log2((total + kinds)[above] / seen)
            shorter = made.costs(known, k - 1)
            cost = np.where(seen > 0, own, escape[above] + shorter)
            made.contexts.append((contexts, escape.astype(np.float32)))
            made.known.append((known, cost.astype(np.float32)))
        return made

    def costs(self, keys: np.ndarray, k: int | None = None) -> np.ndarray:
        """Bits of each gram in every language, with contexts of ``k`` bytes at most."""
        k = self.order if k is None else k
        if k < 0:
            return np.full((len(keys), len(self.languages)), 8, dtype=np.float32)
        keys = keys & np.uint64((1 << 8 * (k + 1)) - 1)
        known, cost = self.known[k]
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        out = cost[at]
        miss = np.flatnonzero(known[at] != keys)
        if len(miss):
            contexts, escape = self.contexts[k]
            above = keys[miss] >> np.uint64(8)
            at = np.minimum(np.searchsorted(contexts, above), len(contexts) - 1)
            paid = np.where((contexts[at] == above)[:, None], escape[at], 0)
            out[miss] = paid + self.costs(keys[miss], k - 1)
        return out

    def code_lengths(self, texts: pa.Array) -> np.ndarray:
        """Bits of every text in every language."""
        keys, at = grams(texts, self.order)
        total = np.zeros((len(at) - 1, len(self.languages)))
        step = max(1, CELLS // max(1, len(self.languages)))
        for start in range(0, len(keys), step):
            stop = min(len(keys), start + step)
            first = int(np.searchsorted(at, start, "right")) - 1
            last = int(np.searchsorted(at, stop, "left"))
            edges = np.clip(at[first : last + 1], start, stop) - start
            full = np.flatnonzero(np.diff(edges))
            part = np.add.reduceat(self.costs(keys[start:stop]), edges[:-1][full], axis=0, dtype=np.float64)
            total[first + full] += part
        return total

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language of the shortest code, the first by name among equals, and its share when each
        language weighs 2 to the minus code length. Without a letter, or trees: und and 0."""
        letters = np.asarray(pc.match_substring_regex(plain(texts), r"\pL"), dtype=bool)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        bits = self.code_lengths(texts)
        best = bits.argmin(axis=1)
        gap = bits - bits.min(axis=1, keepdims=True)
        share = 1 / np.exp2(-np.minimum(gap, 1000)).sum(axis=1)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist())]
        return names, np.where(letters, share, 0.0)


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    order: int = ORDER, max_texts: int = MAX_TEXTS,
) -> ContextTrees:
    """Trees from documents outside the held-out fold that have an id, a text and a language.

    Grams are counted by Spark; the driver gets those of the bounded sample alone.
    """
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")
    ).where(f"_id IS NOT NULL AND _lang IS NOT NULL AND _text IS NOT NULL")
    rows = rows.where(~held_out("_id", FOLDS, FOLD))
    few = top_k(
        rows.select("_id", "_lang").distinct(), ["_lang"], [F.xxhash64("_id"), F.col("_id")], max_texts, ["_id"]
    ).select("_id", "_lang")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            keys, at = grams(part.column("_text"), order)
            names = part.column("_lang").dictionary_encode()
            of = np.repeat(np.asarray(names.indices), np.diff(at))
            for k, name in enumerate(names.dictionary.to_pylist()):
                gram, count = np.unique(keys[of == k], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(count)],
                    names=["lang", "gram", "n"],
                )

    counted = rows.join(F.broadcast(few), ["_id", "_lang"]).select("_text", "_lang").mapInArrow(
        work, "lang string, gram long, n long"
    )
    counted = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    return ContextTrees.of(list(zip(*(counted.column(c).to_pylist() for c in ("lang", "gram", "n")))), order)


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row, from its whole text, in one pass."""
    trees = train(docs, id_col, text_col, lang_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col, 2 << 20):
            names, share = trees.predict(part.column(text_col))
            yield pa.RecordBatch.from_arrays(
                [part.column(id_col), pa.array(names, pa.string()), pa.array(share)],
                names=[id_col, "lang_pred", "score"],
            )

    found = docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {kind}, lang_pred string, score double")
    return found.select(id_col, held_out(id_col, FOLDS, FOLD).alias("held_out"), "lang_pred", "score")
