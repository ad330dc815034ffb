"""Compression distances between documents and author profiles.

A profile is compressed as a stream inside a task: its documents arrive sorted and are fed
to the compressor one by one, so the joined text is never held. A profile larger than
``block_chars`` is cut into independent blocks, as parallel compressors do. A following
text can only refer back as far as the compressor's window, so the end of the profile
stands for the whole when pairs are measured.
"""

from __future__ import annotations

import bz2
import lzma
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.operators.common import DOC, bucket_of, join_dimension
from inkprint.operators.vectorize import PROFILE
from inkprint.session import default_partitions, materialize

BLOCK_CHARS = 64_000_000
MAKERS = {"zlib": zlib.compressobj, "bz2": bz2.BZ2Compressor, "lzma": lzma.LZMACompressor}
# How far back each compressor can refer, in bytes.
WINDOWS = {"zlib": 32_768, "bz2": 900_000, "lzma": 8_388_608}


def _size(algo: str, *parts: bytes) -> int:
    machine = MAKERS[algo]()
    return sum(len(machine.compress(p)) for p in parts) + len(machine.flush())


def compressed_size(text: Column, algo: str = "zlib") -> Column:
    """Bytes of the UTF-8 text after compression."""
    @F.pandas_udf("long")
    def size(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _size(algo, t.encode()))

    return size(text)


def _added_size(algo: str):
    """Bytes that a text adds after the end of a profile."""
    @F.pandas_udf("long")
    def added(tails: pd.Series, before: pd.Series, texts: pd.Series) -> pd.Series:
        def one(tail: bytes, base: int, text: str) -> int:
            if algo == "zlib" and tail:
                machine = zlib.compressobj(zdict=tail)
                return len(machine.compress(text.encode())) + len(machine.flush())
            return _size(algo, tail, text.encode()) - base

        return pd.Series([one(bytes(t), b, x) for t, b, x in zip(tails, before, texts)])

    return added


def profile_sizes(known: DataFrame, algo: str = "zlib", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(problem, author, size, tail, tail_size): compressed size and the end of each profile."""
    total = known.groupBy(*PROFILE).agg(
        F.ceil(F.sum(F.length("text") + 1) / F.lit(block_chars)).cast("int").alias("_blocks")
    )
    blocked = join_dimension(known.select(*PROFILE, "doc_name", "text"), total, PROFILE, ["doc_name"])
    bucket = bucket_of("doc_name", 256)
    blocked = blocked.withColumn("_bucket", bucket).withColumn(
        "_block", F.pmod(F.xxhash64("doc_name"), F.greatest("_blocks", F.lit(1))).cast("int")
    )
    n = default_partitions(known.sparkSession)
    ordered = blocked.repartition(n, *PROFILE, "_block").sortWithinPartitions(
        *PROFILE, "_block", "_bucket", "doc_name"
    ).select(*PROFILE, "_block", "text")
    window = WINDOWS[algo]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, machine, size, tail = None, None, 0, b""

        def row() -> pd.DataFrame:
            return pd.DataFrame(
                [(*key, size + len(machine.flush()), tail)],
                columns=["problem", "author", "_block", "size", "tail"],
            )

        for batch in batches:
            for problem, author, block, text in batch.itertuples(index=False):
                part = text.encode()
                if (problem, author, block) != key:
                    if key is not None:
                        yield row()
                    key, machine, size, tail = (problem, author, block), MAKERS[algo](), 0, b""
                else:
                    part = b" " + part
                size += len(machine.compress(part))
                tail = (tail + part)[-window:]
        if key is not None:
            yield row()

    blocks = ordered.mapInPandas(
        stream, "problem string, author string, _block int, size long, tail binary"
    )
    profiles = blocks.groupBy(*PROFILE).agg(
        F.sum("size").alias("size"), F.max_by("tail", "_block").alias("tail")
    )
    tail_size = F.pandas_udf(lambda tails: tails.map(lambda t: _size(algo, bytes(t))), "long")
    return materialize(profiles.withColumn("tail_size", tail_size("tail")))


def pair_compressed_size(docs: DataFrame, profiles: DataFrame, algo: str = "zlib") -> DataFrame:
    """(problem, doc_name, author, x, y, xy): sizes of profile, document and profile + document."""
    sized = docs.select(*DOC, "text", compressed_size(F.col("text"), algo).alias("y"))
    # The end of a profile has a fixed maximal size, so the row bound is a byte bound.
    rows = 64_000_000 // WINDOWS[algo]
    pairs = join_dimension(
        sized, profiles, ["problem"], ["doc_name"], max_rows=rows, materialized=True
    )
    added = _added_size(algo)(F.col("tail"), F.col("tail_size"), F.col("text"))
    return pairs.select(
        *DOC, "author", F.col("size").alias("x"), "y", (F.col("size") + added).alias("xy")
    )


def cbc(x: Column, y: Column, xy: Column) -> Column:
    return F.lit(1.0) - (x + y - xy) / F.sqrt(x * y)


def ncd(x: Column, y: Column, xy: Column) -> Column:
    return (xy - F.least(x, y)) / F.greatest(x, y)


def compression_features(docs: DataFrame, known: DataFrame, algo: str = "zlib") -> DataFrame:
    """(problem, doc_name, author, cbc, ncd) for every document and candidate."""
    sizes = pair_compressed_size(docs, profile_sizes(known, algo), algo)
    x, y, xy = F.col("x"), F.col("y"), F.col("xy")
    return sizes.select(*DOC, "author", cbc(x, y, xy).alias("cbc"), ncd(x, y, xy).alias("ncd"))
