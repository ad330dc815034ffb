"""Text quality by a generalised additive model with pairwise interactions.

Cyclic boosting: in every round each feature in turn gets one shallow tree on its bins, fitted to
the gradients that all others have left, and the tree's values are added to the feature's lookup
table. Afterwards the strongest pairs of features get two-dimensional tables in the same way.
A text's score is the logistic of the sum of the table entries of its bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.llm.common import bounds, buffers, held_out, plain, slices, sums, words_of

FEATURES = [
    "log_bytes", "upper_share", "digit_share", "mark_share", "exclaim_share", "stops_per_word",
    "high_share", "space_share", "lines_per_byte", "word_length", "word_spread", "distinct_words",
    "top_word", "distinct_pairs", "repeated_lines", "log_words", "marked_words", "bar_share",
]
#: At most so many labelled rows are fitted on, those with the smallest hash of their id.
MAX_ROWS = 50_000
THRESHOLD = 0.3
FOLDS = 5


def _distinct(owner: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes per owner, and the count of the most frequent one."""
    key = np.sort((owner.astype(np.uint64) << np.uint64(40)) | (code & np.uint64((1 << 40) - 1)))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
    of = (key[first] >> np.uint64(40)).astype(np.int64)
    runs = np.diff(np.append(first, len(key)))
    top = np.zeros(n, dtype=np.int64)
    np.maximum.at(top, of, runs)
    return np.bincount(of, minlength=n), top


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text, from the whole text; null counts as empty. All are finite."""
    texts = plain(texts)
    n = len(texts)
    data, at = buffers(texts)
    size = np.diff(at)
    total = np.maximum(size, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        return sums(mask.astype(np.int64), at)

    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    digit, high, space = (data >= 48) & (data <= 57), data >= 128, data == 32
    white = space | ((data >= 9) & (data <= 13))
    stop = (data == 44) | (data == 46)
    mark = ~(upper | lower | digit | high | white | stop)
    uppers, lowers = share(upper), share(lower)
    marks, stops = share(mark), share(stop)
    words, per = words_of(texts)
    word_at, per1 = bounds(per), np.maximum(per, 1)
    length = np.asarray(pc.binary_length(words), dtype=np.float64)
    mean = sums(length, word_at) / per1
    spread = np.sqrt(np.maximum(sums(length * length, word_at) / per1 - mean * mean, 0))
    owner = np.repeat(np.arange(n), per)
    code = np.asarray(words.dictionary_encode().indices, dtype=np.uint64)
    distinct, top = _distinct(owner, code, n)
    inside = owner[1:] == owner[:-1]
    pair = (code[:-1] * np.uint64(0x9E3779B97F4A7C15) + code[1:]) * np.uint64(0xD6E8FEB86659FD93)
    pairs, _ = _distinct(owner[1:][inside], pair[inside] >> np.uint64(24), n)
    ends = pc.utf8_slice_codeunits(words, -1) if len(words) else words
    marked = np.asarray(pc.match_substring_regex(ends, r"[^\pL\pN.,]"), dtype=np.int64)
    lists = pc.split_pattern(texts, "\n")
    lines, line_of = pc.list_flatten(lists), np.asarray(pc.list_parent_indices(lists))
    line_code = np.asarray(lines.dictionary_encode().indices, dtype=np.uint64)
    line_count = np.bincount(line_of, minlength=n)
    lines_once, _ = _distinct(line_of, line_code, n)
    return np.column_stack([
        np.log1p(size), uppers / np.maximum(uppers + lowers, 1), share(digit) / total,
        marks / total, share(data == 33) / total, stops / per1, share(high) / total,
        share(space) / total, (line_count - 1) / total, mean, spread, distinct / per1, top / per1,
        pairs / np.maximum(per - 1, 1), 1 - lines_once / np.maximum(line_count, 1), np.log1p(per),
        sums(marked, word_at) / per1, share(data == 124) / total,
    ])


@dataclass
class AdditiveModel:
    """Cut points and lookup tables; ``pairs`` are (feature, feature, table)."""

    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cuts, x[:, j], "right")]
        for i, j, table in self.pairs:
            total += table[
                np.searchsorted(self.pair_cuts[i], x[:, i], "right"),
                np.searchsorted(self.pair_cuts[j], x[:, j], "right"),
            ]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def _best_cut(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[float, int]:
    """Gain and place of the best split of consecutive bins."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + penalty) + gr**2 / (hr + penalty) - g.sum() ** 2 / (h.sum() + penalty)
    gain[(hl <= 0) | (hr <= 0)] = 0
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int, penalty: float) -> np.ndarray:
    """Values per bin of a shallow tree over consecutive bins."""
    gain, k = _best_cut(g, h, penalty) if depth else (0.0, 0)
    if gain <= 0:
        return np.full(len(g), g.sum() / (h.sum() + penalty))
    return np.concatenate([
        _tree(g[:k], h[:k], depth - 1, penalty), _tree(g[k:], h[k:], depth - 1, penalty)
    ])


def _pair_tree(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts one side and then, on both parts, the other."""
    best, values = 0.0, np.zeros_like(g)
    whole = g.sum() ** 2 / (h.sum() + penalty)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for k in range(1, len(a)):
            parts, gain = [], -whole
            for p, q in ((a[:k], b[:k]), (a[k:], b[k:])):
                v = _tree(p.sum(axis=0), q.sum(axis=0), 1, penalty)
                gain += float((v * (2 * p.sum(axis=0) - v * (q.sum(axis=0)))).sum()) - penalty * float(
                    (np.unique(v) ** 2).sum()
                )
                parts.append(np.repeat(v[None, :], len(p), axis=0))
            if gain > best:
                best, made = gain, np.concatenate(parts)
                values = made.T if turned else made
    return best, values


def fit(
    x: np.ndarray, y: np.ndarray, bins: int = 32, pair_bins: int = 8, rounds: int = 150,
    pair_count: int = 6, pair_rounds: int = 40, rate: float = 0.1, depth: int = 2,
    penalty: float = 5.0,
) -> AdditiveModel:
    """Fit on rows of features and labels 0/1. Without rows or with one label the score is constant:
    the smoothed share of label 1."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(intercept=float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    width = x.shape[1]
    model.cuts = [_cuts(x[:, j], bins) for j in range(width)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    binned = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(model.cuts)]
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, b in enumerate(binned):
            g, h = slopes()
            m = len(model.tables[j])
            step = rate * _tree(np.bincount(b, g, m), np.bincount(b, h, m), depth, penalty)
            model.tables[j] += step
            total += step[b]
    model.pair_cuts = [_cuts(x[:, j], pair_bins) for j in range(width)]
    coarse = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(model.pair_cuts)]
    sizes = [len(c) + 1 for c in model.pair_cuts]

    def histogram(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        cell, shape = coarse[i] * sizes[j] + coarse[j], (sizes[i], sizes[j])
        return (np.bincount(cell, v, sizes[i] * sizes[j]).reshape(shape) for v in (g, h))

    gains = sorted(
        ((_pair_tree(*histogram(i, j), penalty)[0], i, j) for i, j in combinations(range(width), 2)),
        reverse=True,
    )
    model.pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for gain, i, j in gains[:pair_count] if gain > 0]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            step = rate * _pair_tree(*histogram(i, j), penalty)[1]
            table += step
            total += step[coarse[i], coarse[j]]
    return model


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", max_rows: int = MAX_ROWS, folds: int = FOLDS,
) -> AdditiveModel:
    """Fit on labelled documents outside the held-out fold.

    Rows without id or label, and labels without a document, don't count; repeated rows count each
    time. Beyond ``max_rows`` labels those with the smallest hash of the id are taken, so at
    most that many small rows of features reach the driver.
    """
    known = labels.where(
        F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col, folds)
    ).select(F.col(id_col).alias("_id"), (F.col(label_col) > 0).cast("int").alias("_y"))
    sample = known.orderBy(F.xxhash64("_id"), "_id", "_y").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(
        F.broadcast(sample), "_id"
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            x = features(part.column("_text"))
            flat = pa.array(x.reshape(-1))
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], flat)
            yield pa.RecordBatch.from_arrays(
                [part.column("_id").cast(pa.string()), part.column("_y"), lists], names=["k", "y", "x"]
            )

    seen = rows.mapInArrow(work, "k string, y int, x array<double>")
    seen = seen.orderBy(F.xxhash64("k"), "k", "y", "x").limit(max_rows).toArrow()
    x = np.asarray(pc.list_flatten(seen.column("x").combine_chunks()), dtype=np.float64)
    return fit(x.reshape(-1, len(FEATURES)), np.asarray(seen.column("y"), dtype=np.float64))


def score_texts(
    docs: DataFrame, model: AdditiveModel, keep: list[str], text_col: str = "text",
    score_col: str = "score", at_least: float | None = None,
) -> DataFrame:
    """``keep`` columns of every row, with the score of the whole text (null: as empty).

    One pass without a shuffle. With ``at_least`` only rows of that score or more are returned,
    without the score.
    """
    kept = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    named = [*keep] if at_least is not None else [*keep, score_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            score = model.score(features(part.column(text_col)))
            columns = [part.column(c) for c in keep]
            if at_least is None:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(score)], names=named)
            else:
                yield pa.RecordBatch.from_arrays(columns, names=named).filter(pa.array(score >= at_least))

    schema = ", ".join(kept if at_least is not None else [*kept, f"`{score_col}` double"])
    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(work, schema)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = score_texts(docs.select("doc_id", "text"), train(docs, labels), ["doc_id"])
    return scored.select(
        "doc_id", held_out("doc_id", FOLDS).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
