"""Document fingerprints by a homomorphic multiset hash, in DataFrame functions only.

A text is the multiset of its paragraphs (lines, cut once more behind marks). Each paragraph is
hashed to a wide vector of words modulo 2**60: three words are its hashes themselves, the others hold
three counters of 20 bits, to each of which it adds one hash bit. The fingerprint is the sum of
the vectors, so that order doesn't count, and paragraphs can be added and taken away without the text.
Equal sums mean equal multisets; the counters, read as signs, estimate how alike two multisets are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkprint.session import default_partitions

PIECES = r"\n+|(?<=[^\p{L}\p{N}\s,])\s+"
SEEDS = 3
SHIFTS = 16
LANES = 3
LANE_BITS = 20
LANE = (1 << LANE_BITS) - 1
MODULUS = (1 << LANE_BITS * LANES) - 1
ONES = sum(1 << LANE_BITS * k for k in range(LANES))
COUNTERS = SEEDS * SHIFTS
WIDTH = 1 + SEEDS + COUNTERS
MAX_BUCKETS = 4096


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _modulo(x: Column) -> Column:
    return x.bitwiseAND(_long(MODULUS))


def pieces(text: Column) -> Column:
    """The paragraphs of a text that aren't blank, without outer spaces."""
    return F.filter(F.transform(F.split(text, PIECES), F.trim), lambda p: p != "")


def vector(parts: Column) -> Column:
    """Fingerprint of an array of paragraphs: their number, sums of hashes, sums of counters."""

    def hashed(seed: int) -> Column:
        return F.transform(parts, lambda p: F.xxhash64(F.lit(seed), p))

    hashes = [hashed(s) for s in range(SEEDS)]
    shifts = F.array(*[F.lit(k) for k in range(SHIFTS)])

    def counters(own: Column) -> Column:
        return F.aggregate(
            own, F.array_repeat(_long(0), SHIFTS),
            lambda total, h: F.zip_with(total, shifts, lambda t, k: _modulo(
                t + F.call_function("shiftrightunsigned", h, k).bitwiseAND(_long(ONES)))),
        )

    def digest(own: Column) -> Column:
        return F.aggregate(own, _long(0), lambda total, h: _modulo(total + _modulo(h)))

    return F.concat(
        F.array(F.size(parts).cast("long")), F.array(*[digest(h) for h in hashes]),
        *[counters(h) for h in hashes],
    )


def added(one: Column, other: Column) -> Column:
    """Fingerprint of two texts together."""
    return F.zip_with(one, other, lambda a, b: _modulo(a + b))


def removed(one: Column, part: Column) -> Column:
    """Fingerprint of what is left when the paragraphs of ``part`` are taken away."""
    return F.zip_with(one, part, lambda a, b: _modulo(a - b))


def shown(v: Column) -> Column:
    return F.lower(F.array_join(F.transform(v, lambda x: F.lpad(F.hex(x), 15, "0")), ""))


def _signs(x: Column, number: Column, lane: int) -> Column:
    count = F.shiftrightunsigned(x, LANE_BITS * lane).bitwiseAND(_long(LANE))
    return count * _long(2) - number


def _dot(v: Column, w: Column) -> Column:
    a, b = (F.slice(x, 2 + SEEDS, COUNTERS) for x in (v, w))
    n, m = v[0], w[0]
    terms = F.zip_with(a, b, lambda x, y: sum(
        (_signs(x, n, k) * _signs(y, m, k) for k in range(1, LANES)), _signs(x, n, 0) * _signs(y, m, 0)))
    return F.aggregate(terms, _long(0), lambda s, t: s + t).cast("double")


def likeness(v: Column, w: Column) -> Column:
    """Estimated cosine of two multisets, 0 to 1, from 144 signs: the standard error is about 0.08.
    Equal fingerprints give 1, an empty text and another one 0."""
    cosine = _dot(v, w) / F.sqrt(_dot(v, v) * _dot(w, w))
    inner = F.least(F.greatest(cosine, F.lit(0.0)), F.lit(1.0))
    return F.when(v == w, 1.0).when((v[0] == 0) | (w[0] == 0), 0.0).otherwise(F.coalesce(F.nanvl(inner, F.lit(0.0)), F.lit(0.0)))


def _bucket(key: Column, cuts: list) -> Column:
    """How many cuts lie at or below the key, by halving."""

    def place(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < F.lit(cuts[middle]), place(low, middle)).otherwise(place(middle + 1, high))

    return place(0, len(cuts))


def with_next(docs: DataFrame, id_col: str, text_col: str, buckets: int | None = None) -> DataFrame:
    """Rows (id, h, text, bucket, guest) such that in each bucket, ordered by guest, id (descending,
    null last) and hash, every row that is no guest is followed by its next document.

    Buckets are ranges of ids. The first row of each is copied as a guest behind the range that
    precedes it, the very first behind the last range. Only cuts and first rows reach the driver, one
    per bucket, ``MAX_BUCKETS`` at most; texts are shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    count = buckets or min(MAX_BUCKETS, 4 * default_partitions(spark))
    shares = [k / count for k in range(1, count)]
    cuts = rows.agg(F.percentile_approx("id", shares).alias("c")).first()["c"] if shares else []
    cuts = sorted(set(cuts or []))
    placed = F.when(F.col("id").isNull(), -1).otherwise(_bucket(F.col("id"), cuts))
    rows = rows.withColumn("bucket", placed).withColumn("h", F.xxhash64("text"))
    tops = rows.groupBy("bucket").agg(F.max(F.struct("id", "h")).alias("top")).collect()
    order = sorted((r.bucket for r in tops), reverse=True)
    before = {b: order[k - 1] for k, b in enumerate(order)}
    kind = rows.schema["id"].dataType.simpleString()
    first = spark.createDataFrame(
        [(r.bucket, r.top["id"], r.top["h"], before[r.bucket]) for r in tops],
        f"bucket int, first_id {kind}, first_h long, behind int",
    )
    here = F.struct(F.col("bucket"), F.lit(0).alias("guest"))
    there = F.struct(F.col("behind").alias("bucket"), F.lit(1).alias("guest"))
    is_first = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))
    spots = F.when(is_first, F.array(here, there)).otherwise(F.array(here))
    return rows.join(F.broadcast(first), "bucket").select(
        "id", "h", "text", F.explode(spots).alias("spot")
    ).select("id", "h", "text", "spot.bucket", "spot.guest")


def compare_edited(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None
) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last floor(n / 2) code points replaced by the first as many, or all, of
    the next document in descending order of ids; after the last comes the first. Null texts are
    empty; null ids come last; rows of one id follow each other by the hash of their text; repeated
    rows stay. A table of one row is its own next document.
    """
    place = Window.partitionBy("bucket").orderBy("guest", F.col("id").desc_nulls_last(), F.col("h").desc())
    rows = with_next(docs, id_col, text_col, buckets)
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    rows = rows.withColumn("next", F.lead("text").over(place))
    edited = F.concat(
        F.substring("text", F.lit(1), size - half),
        F.substring(F.coalesce("next", F.lit("")), F.lit(1), half),
    )
    made = rows.select(
        "id", "h", "bucket", "guest", size.cast("long").alias("n_chars"), F.col("text"), edited.alias("edited")
    )
    made = made.select(
        "id", "h", "bucket", "guest", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        vector(pieces(F.col("text"))).alias("v"), vector(pieces(F.col("edited"))).alias("w"),
    )
    made = made.withColumn("x", F.lead("v").over(place)).where("guest = 0")
    return made.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", shown(F.col("v")).alias("fingerprint"),
        shown(F.col("w")).alias("edited_fingerprint"),
        likeness(F.col("v"), F.col("w")).alias("near_edited"),
        likeness(F.col("v"), F.col("x")).alias("near_next"),
    )
