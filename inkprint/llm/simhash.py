"""Near duplicates by SimHash fingerprints and multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.llm.common import buffers, components, plain, row_hash, slices
from inkprint.session import materialize

SEED = 42
BITS = 64
HOT_BUCKET = 32
BLOCK = 100_000
FOLD = bytes(
    32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256)
)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of word shingles, repeats included.

    Words stand between ASCII white space, A-Z in lower case. Fewer words than a shingle: the
    whole sequence is the one shingle. No word: 0. A bit is set if over half the hashes have it.
    """
    text = text.translate(FOLD).strip(b" ")
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    if not text:
        return 0
    gaps = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 32)
    width = min(shingle, len(gaps) + 1)
    starts = np.append(0, gaps + 1)[: len(gaps) + 2 - width]
    ends = np.append(gaps, len(text))[width - 1 :]
    counts = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(starts), BLOCK):
        hashes = np.array(
            [digest(text[a:b], SEED) for a, b in zip(starts[k : k + BLOCK].tolist(), ends[k : k + BLOCK].tolist())],
            dtype="<u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    ones = np.packbits(2 * counts > len(starts), bitorder="little")
    return int(ones.view("<i8")[0])


def fingerprints(
    docs: DataFrame, keep: list[str], text_col: str = "text", out: str = "fingerprint", shingle: int = 3
) -> DataFrame:
    """``keep`` columns of every row and the fingerprint of its whole text (null: 0)."""
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            data, at = buffers(plain(part.column(text_col)))
            raw = data.tobytes()
            made = [fingerprint(raw[a:b], shingle) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in keep), pa.array(made, pa.int64())], names=[*keep, out]
            )

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(work, f"{kept}, `{out}` long")


def _segments(count: int = 2) -> list[tuple[int, int]]:
    """(lowest bit, width) of equal segments: of two fingerprints within three bits, one of two
    segments differs in at most one bit."""
    cuts = [BITS * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _key(fp: Column, segment: int, low: int, width: int) -> Column:
    """The segment's bits, with the segment's number in front."""
    bits = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    return F.lit(segment << 40).cast("long").bitwiseOR(bits)


def _one_bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def _cleared(key: Column, width: int) -> Column:
    """The key and every key with one of its set bits cleared. That is enough of the Hamming ball:
    of two keys that differ in one bit, one has it set."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), _one_bit)
    flips = F.filter(flips, lambda b: key.bitwiseAND(b) != 0)
    return F.concat(F.array(key), F.transform(flips, lambda b: key.bitwiseXOR(b)))


def links(prints: DataFrame, radius: int = 2, hot: int = HOT_BUCKET) -> DataFrame:
    """Links (a, b), a <> b, between distinct fingerprints of column ``fp``: enough of those at
    ``radius`` (1 or 2) or fewer differing bits that the components are those of all of them.

    Each segment of a fingerprint is filed in a table; probes are the segment's small Hamming
    ball; matches are verified on all bits. Buckets with more than ``hot`` fingerprints only tell
    which fingerprints meet there. Those are linked through their neighbours: fingerprints within
    two bits share a neighbour at one bit at most, and all that share a neighbour (65 at most) are
    within two bits of each other, so a link to the smallest of them is enough.
    """
    if radius not in (1, 2):
        raise ValueError("radius 1 or 2")
    fp = F.col("fp")
    keys = [(_key(fp, s, low, width), width) for s, (low, width) in enumerate(_segments())]
    filed = prints.select(F.explode(F.array(*[k for k, _ in keys])).alias("key"), "fp")
    probes = prints.select(F.explode(F.concat(*[_cleared(k, w) for k, w in keys])).alias("key"), "fp")
    sizes = filed.groupBy("key").agg(F.count("*").alias("size"))
    full = materialize(sizes.where(F.col("size") > hot).select("key"))
    shelves = filed.select("key", F.col("fp").alias("b")).join(full, "key", "left_anti").union(
        full.select("key", F.lit(None).cast("long").alias("b"))
    )
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    met = materialize(
        probes.select("key", F.col("fp").alias("a")).join(shelves, "key")
        .where(F.col("b").isNull() | ((F.col("a") != F.col("b")) & (apart <= radius))).select("a", "b")
    )
    near = met.where("b is not null")
    crowd = met.where("b is null").select(F.col("a").alias("fp")).distinct()
    flips = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: fp.bitwiseXOR(_one_bit(i)))
    around = crowd.select("fp", F.explode(F.concat(F.array(fp), flips)).alias("mid"))
    if radius == 1:  # neighbours of one fingerprint may be two bits apart: the middle has to exist
        own = around.join(crowd.select(F.col("fp").alias("mid")), "mid", "left_semi")
        return near.union(own.where("fp <> mid").select(F.col("fp").alias("a"), F.col("mid").alias("b")))
    around = around.repartition("mid")
    hubs = around.groupBy("mid").agg(F.min("fp").alias("hub"), F.max("fp").alias("top")).where("hub <> top")
    hung = around.join(hubs, "mid").where("fp <> hub")
    return near.union(hung.select(F.col("fp").alias("a"), F.col("hub").alias("b")))


def grouped(prints: DataFrame, radius: int = 2, hot: int = HOT_BUCKET) -> DataFrame:
    """(fp, root): the smallest fingerprint of the component of each distinct, linked fingerprint."""
    joined = components(links(prints, radius, hot))
    return joined.select(F.col("node").alias("fp"), "root")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = 3
) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links, itself included.

    Equal texts are one fingerprint, so copies never meet in a join. Rows with a null id keep their
    fingerprint and take part; a component of such rows alone is null. Repeated rows stay.
    """
    own = materialize(
        fingerprints(docs, [id_col], text_col, "fp", shingle).select(F.col(id_col).alias("id"), "fp")
    )
    first = materialize(own.groupBy("fp").agg(F.min("id").alias("first")))
    roots = grouped(first.select("fp"), radius)
    rooted = first.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component")
    return own.join(named, "fp")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = 3
) -> DataFrame:
    """One row per group of near duplicates, with all columns: that with the smallest id (null last),
    then the smallest hash of the row. Of rows equal in every column one stays."""
    names = docs.columns
    keys = fingerprints(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_hash(docs).alias("h")),
        ["id", "h"], "text", "fp", shingle,
    )
    keys = materialize(keys.groupBy("fp", "id", "h").agg(F.count("*").alias("copies")))
    place = F.struct(F.col("id").isNull().alias("late"), "id", "h", "copies")
    first = materialize(keys.groupBy("fp").agg(F.min(place).alias("first")))
    roots = grouped(first.select("fp"), radius)
    kept = first.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(
        F.min("first").alias("first")
    )
    kept = materialize(kept.select(
        F.col("first.id").alias("_id"), F.col("first.h").alias("_h"), F.col("first.copies").alias("_copies")
    ))
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), row_hash(docs).alias("_h"))
    joined = marked.join(
        kept, (marked["_h"] == kept["_h"]) & marked[f"_row.{id_col}"].eqNullSafe(kept["_id"])
    ).select("_row", "_copies")
    once = joined.where("_copies = 1").select("_row.*")
    if kept.where("_copies > 1").isEmpty():
        return once
    return once.union(joined.where("_copies > 1").select("_row.*").dropDuplicates())
