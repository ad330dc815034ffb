"""One-vs-rest gradient-boosted trees whose classes are fitted in a task each.

Features are cut into at most 32 bins. The bins of 64 features are made in a task, from all rows; a class is
fitted in one task that holds a byte per row and feature. Trees, losses and weights are those of Spark's classifier, which takes
the data with more cells or features than a task holds.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import OneVsRest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.session import let_go, materialize

#: Rows times features, and features, that are fitted in tasks.
IN_PLACE_CELLS, IN_PLACE_FEATURES = 200_000_000, 10_000
GROUP_FEATURES = 64
# Those of the library's trees.
BINS, DEPTH, STEP = 32, 5, 0.1
NODES = 2 ** (DEPTH + 1)
PACKED = "g int, batch string, n int, labels binary, cells binary"
BINNED = "g int, labels binary, bins binary, cuts array<array<double>>"
TREES = "k int, feature binary, cut binary, value binary"


def _form(df: DataFrame, schema: str) -> pa.Schema:
    return df.sparkSession.createDataFrame([], schema).toArrow().schema


def cuts_of(values: np.ndarray) -> np.ndarray:
    """Thresholds between the values of a feature: all, or those nearest to equal shares of the rows."""
    known, n = np.unique(values, return_counts=True)
    between, most = (known[:-1] + known[1:]) / 2, min(BINS, len(values)) - 1
    if len(between) <= most:
        return between
    upto, share, at = np.cumsum(n), len(values) / (most + 1), -1
    middle, found, target = (upto[:-1] + upto[1:]) / 2, [], share
    while (at := max(at + 1, int(np.searchsorted(middle, target, side="right")))) < len(between):
        found.append(between[at])
        target += share
    return np.array(found)


def _histograms(bins: list[np.ndarray], rows: np.ndarray | None, slot: np.ndarray, target: np.ndarray, slots: int) -> np.ndarray:
    """(2, slot, feature, bin): rows and sum of the target; ``slot`` and ``target`` are those of ``rows``."""
    out, base = np.empty((2, slots, len(bins), BINS)), slot * BINS
    for f, column in enumerate(bins):
        key = base + (column if rows is None else column[rows])
        out[0, :, f] = np.bincount(key, minlength=slots * BINS).reshape(slots, BINS)
        out[1, :, f] = np.bincount(key, weights=target, minlength=slots * BINS).reshape(slots, BINS)
    return out


def _tree(bins: list[np.ndarray], splits: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature, last bin on the left and value of each node of a regression tree, children of i at 2i and 2i + 1 (feature -1:
    a leaf), and the node of each row. The smaller of two children is counted, the other is what is left."""
    feature, cut, value = np.full(NODES, -1, np.int32), np.zeros(NODES, np.int32), np.zeros(NODES)
    node, active = np.ones(len(target), dtype=np.int64), np.array([1])
    table = _histograms(bins, None, np.zeros(len(target), dtype=np.int64), target, 1)
    allowed = np.arange(BINS - 1) < splits[:, None]
    value[1] = target.mean()
    for level in range(DEPTH):
        left = np.cumsum(table, axis=3)
        whole, left = left[..., -1:], left[..., :-1]
        right = whole - left
        fine = allowed & (left[0] > 0.5) & (right[0] > 0.5)
        score = left[1] ** 2 / np.where(fine, left[0], 1) + right[1] ** 2 / np.where(fine, right[0], 1) - whole[1] ** 2 / whole[0]
        score = np.where(fine, score, -np.inf).reshape(len(active), -1)
        best = score.argmax(axis=1)
        squares = np.bincount(node, weights=target * target, minlength=NODES)[active]
        split = np.take_along_axis(score, best[:, None], 1)[:, 0] > 1e-12 * squares
        if not split.any():
            break
        chosen, at = np.divmod(best, BINS - 1)
        feature[active[split]], cut[active[split]] = chosen[split], at[split]
        own, counts = np.flatnonzero(split), np.zeros((len(active), 2))
        for s in own:
            counts[s] = left[0, s, chosen[s], at[s]], right[0, s, chosen[s], at[s]]
            i, (a, b) = active[s], (left[1, s, chosen[s], at[s]], right[1, s, chosen[s], at[s]])
            value[2 * i], value[2 * i + 1] = a / counts[s, 0], b / counts[s, 1]
            rows = np.flatnonzero(node == i)
            node[rows] = 2 * i + (bins[chosen[s]][rows] > at[s])
        if level == DEPTH - 1:
            break
        small = np.where(counts[own, 0] <= counts[own, 1], 0, 1)
        slot_of = np.full(NODES, -1)
        slot_of[2 * active[own] + small] = np.arange(len(own))
        slot = slot_of[node]
        rows = np.flatnonzero(slot >= 0)
        counted = _histograms(bins, rows, slot[rows], target[rows], len(own))
        both = np.stack([counted, table[:, own] - counted], axis=2)
        both[:, small == 1] = both[:, small == 1][:, :, ::-1]
        table = both.reshape(2, 2 * len(own), len(bins), BINS)
        active = np.stack([2 * active[own], 2 * active[own] + 1], axis=1).reshape(-1)
    return feature, cut, value, node


def fitted(bins: list[np.ndarray], splits: np.ndarray, hit: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trees (round, node) of one class, their values weighted; ``hit`` tells the rows of the class."""
    sign, total, trees = np.where(hit, 1.0, -1.0), np.zeros(len(hit)), []
    for k in range(rounds):
        target = sign if k == 0 else 4 * sign / (1 + np.exp(2 * sign * total))
        feature, cut, value, node = _tree(bins, splits, target)
        value *= 1.0 if k == 0 else STEP
        total += value[node]
        trees.append((feature, cut, value))
    return tuple(np.array(x) for x in zip(*trees))


class BoostedModel(Model):
    """Trees of all classes; ``rawPrediction`` is their sum per class."""

    def __init__(self, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        super().__init__()
        self.trees = trees

    def _transform(self, dataset: DataFrame) -> DataFrame:
        trees = self.trees

        @F.arrow_udf("array<double>")
        def raw(features: pa.Array) -> pa.Array:
            x = np.asarray(features.flatten()).reshape(len(features), -1)
            out, every = np.zeros((len(x), len(trees))), np.arange(len(x))
            for k, (feature, cut, value) in enumerate(trees):
                for f, c, v in zip(feature, cut, value):
                    node = np.ones(len(x), dtype=np.int64)
                    for _ in range(DEPTH):
                        inner = f[node] >= 0
                        node = np.where(inner, 2 * node + (x[every, np.maximum(f[node], 0)] > c[node]), node)
                    out[:, k] += v[node]
            ends = pa.array(np.arange(len(x) + 1) * len(trees), pa.int32())
            return pa.ListArray.from_arrays(ends, pa.array(out.reshape(-1)))

        return dataset.withColumn("rawPrediction", array_to_vector(raw(vector_to_array("features"))))


class Boosted(OneVsRest):
    """Data of bounded size are fitted in tasks, a class each; others by the library, classes side by side."""

    def _fit(self, dataset: DataFrame) -> Model:
        found = dataset.agg(F.count("*").alias("n"), F.max("label").alias("last")).first()
        size = dataset.select("features").first()[0].size if found["n"] else 0
        if not found["n"] or not size or size > IN_PLACE_FEATURES or found["n"] * size > IN_PLACE_CELLS:
            return super()._fit(dataset)
        rounds = self.getClassifier().getMaxIter()
        let_go(dataset.sparkSession)  # of what made the vectors
        binned = _binned(dataset, size)
        let_go(dataset.sparkSession)  # of the values: their bins are written out
        form = _form(dataset, TREES)

        def fit(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            table = table.sort_by("g")
            labels = np.frombuffer(table["labels"][0].as_buffer())
            cuts = [np.array(c) for row in table["cuts"].to_pylist() for c in row]
            bins = [column for b in table["bins"] for column in
                    np.frombuffer(b.as_buffer(), np.uint8).reshape(-1, len(labels))]
            feature, cut, value = fitted(bins, np.array([len(c) for c in cuts]), labels == key[0].as_py(), rounds)
            at = np.array([[cuts[f][c] if f >= 0 else 0.0 for f, c in zip(*tree)] for tree in zip(feature, cut)])
            return pa.Table.from_pylist([{"k": key[0].as_py(), "feature": feature.tobytes(), "cut": at.tobytes(),
                                          "value": value.tobytes()}], schema=form)

        classes = F.sequence(F.lit(0), F.lit(int(found["last"])))
        done = binned.withColumn("k", F.explode(classes)).repartition(int(found["last"]) + 1, "k").groupBy("k").applyInArrow(
            fit, TREES)
        trees = {row["k"]: tuple(np.frombuffer(row[c], kind).reshape(rounds, NODES) for c, kind in (
            ("feature", np.int32), ("cut", float), ("value", float))) for row in done.collect()}
        return BoostedModel([trees[k] for k in sorted(trees)])


def _binned(dataset: DataFrame, size: int) -> DataFrame:
    """Rows (g, labels, bins, cuts): a group of features each, with the bins of all rows, feature by feature."""
    forms = _form(dataset, PACKED), _form(dataset, BINNED)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, name = np.asarray(batch["x"].flatten()).reshape(-1, size), uuid.uuid4().hex
            labels = np.asarray(batch["label"]).tobytes()
            for g in range(0, size, GROUP_FEATURES):
                cells = np.ascontiguousarray(x[:, g:g + GROUP_FEATURES].T)
                yield pa.RecordBatch.from_pylist([{
                    "g": g, "batch": name, "n": len(x), "labels": labels,
                    "cells": pa.compress(cells.tobytes(), codec="zstd", asbytes=True)}], schema=forms[0])

    def cut(table: pa.Table) -> pa.Table:
        table = table.sort_by("batch")  # so that rows have the same order in all groups
        g = table["g"][0].as_py()
        width = min(GROUP_FEATURES, size - g)
        x = np.concatenate([np.frombuffer(pa.decompress(row["cells"], row["n"] * width * 8, codec="zstd")).reshape(width, -1)
                            for row in table.select(["n", "cells"]).to_pylist()], axis=1)
        cuts = [cuts_of(column) for column in x]
        bins = np.array([np.searchsorted(c, column) for c, column in zip(cuts, x)], dtype=np.uint8)
        labels = b"".join(table["labels"].to_pylist())
        return pa.Table.from_pylist([{"g": g, "labels": labels, "bins": bins.tobytes(), "cuts": cuts}], schema=forms[1])

    rows = dataset.select(F.col("label").cast("double").alias("label"), vector_to_array("features").alias("x"))
    packed = materialize(rows.mapInArrow(pack, PACKED))  # written once: names of batches are drawn
    return materialize(packed.groupBy("g").applyInArrow(cut, BINNED))
