"""Arrow batches as flat arrays, shared tables, and components of a graph."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.session import materialize

SLICE_BYTES = 8 << 20


def slices(
    batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a piece hold at most ``limit`` bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def plain(array: pa.Array) -> pa.Array:
    """Texts with 64-bit offsets that begin at 0, null as the empty text. Some kernels go wrong on
    slices whose offsets begin elsewhere."""
    data, at = buffers(pc.fill_null(array.cast(pa.large_string()), ""))
    return pa.LargeStringArray.from_buffers(
        len(array), pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(data)
    )


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of texts with 64-bit offsets, and their n + 1 offsets from 0."""
    _, offsets, data = array.buffers()
    places = np.frombuffer(offsets, dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    if not len(array):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    return whole[places[0] : places[-1]], places - places[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of the ranges ``starts[i] : starts[i] + lengths[i]``, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def bounds(lengths: np.ndarray) -> np.ndarray:
    """Offsets 0, l0, l0 + l1, ... of consecutive ranges."""
    return np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(lengths, dtype=np.int64)])


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values in each range of offsets; empty ranges give 0."""
    total = np.concatenate([np.zeros(1, dtype=values.dtype), np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased (A-Z only) words between white space of ASCII, and their number per text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    keep = pc.greater(pc.binary_length(words), 0)
    words, parents = words.filter(keep), np.asarray(parents.filter(keep))
    return words, np.bincount(parents, minlength=len(texts)).astype(np.int64)


def held_out(id_col: str, folds: int, fold: int = 0) -> Column:
    """crc32 of the id as text modulo folds; a null id is never held out."""
    rest = F.crc32(F.col(id_col).cast("string")) % folds == fold
    return F.coalesce(rest, F.lit(False))


def row_hash(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in columns or df.columns])


def let_go(spark: SparkSession) -> None:
    """Let Spark remove the shuffles that no table needs any more: it does so when the driver's
    memory is collected, which may be long after a large step is done. What one collection finds
    unused may hold more, so there are a few, with time for the removal."""
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable ``node`` of every node that has a link: (node, root).

    ``links`` has columns a and b of one ordered type. Alternating big-star and small-star steps:
    each round hangs the neighbours of a node on the smallest of them, so that chains shrink
    by a factor per round. Neighbourhoods are only reduced by min(), never gathered, and each
    round is written out, so that a lost executor costs one round at most.
    """
    edges = links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    edges = materialize(edges)
    state = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(
            "a", F.least("a", "low").alias("low")
        )
        # big star: larger neighbours of a node hang on the smallest node around it
        large = (
            both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        )
        large = large.where("a <> b").distinct()
        # small star: a node and its smaller neighbours hang on the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(
            F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"),
            F.col("low").alias("b"),
        )
        edges = materialize(small.where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
