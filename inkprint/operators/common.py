"""Joins, rankings and orderings that stay distributed under skew."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import ceil

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkprint.functions.text import computed_once
from inkprint.session import default_partitions, materialize

DOC = ["problem", "doc_name"]
BROADCAST_ROWS = 1_000_000
HOT_ROWS = 1_000_000
SALTS = 64
#: Characters of text in a partition: the sorted n-grams of so many fit into a task's memory.
PARTITION_CHARS = 2_000_000


def text_partitions(df: DataFrame) -> int:
    """As many partitions as the texts need, the session's number at least."""
    chars = df.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    return max(default_partitions(df.sparkSession), ceil(chars / PARTITION_CHARS))


def by_doc(df: DataFrame, n: int | None = None) -> DataFrame:
    """Hash-partition by document, so that every later per-document step needs no shuffle.

    The number is explicit: adaptive execution would otherwise merge the small
    text partitions before they are blown up into n-grams.
    """
    return df.repartition(n or text_partitions(df), *DOC)


def salt_of(columns: Sequence[str], salts: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True if the (already materialized) table has at most ``max_rows`` rows."""
    return df.limit(max_rows + 1).count() <= max_rows


def join_dimension(
    facts: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    salt_by: Sequence[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
    materialized: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """Join facts with a fitted dimension table (inner, left or left_semi).

    The dimension is written out and counted first. Small: broadcast, which keeps the
    partitioning of the facts. Larger: a shuffle join in which the hot keys (a gram found
    in very many documents) carry a salt and so spread over many tasks. ``weight`` names a
    column of the dimension that tells how often a key occurs in the facts; without it the
    facts are counted.
    """
    on = list(on)
    dim = dim if materialized else materialize(dim)
    plain = dim.drop(weight) if weight else dim
    if fits_broadcast(dim, max_rows):
        return facts.join(F.broadcast(plain), on, how)
    sizes = dim.withColumn("_rows", F.col(weight)) if weight else facts.groupBy(*on).agg(
        F.count("*").alias("_rows")
    )
    hot = materialize(sizes.where(F.col("_rows") >= HOT_ROWS).select(*on).distinct())
    if hot.isEmpty():
        return facts.join(plain, on, how)
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    salt = salt_of(salt_by, SALTS)
    if not fits_broadcast(hot):
        left, right = facts.withColumn("_salt", salt), plain.withColumn("_salt", F.explode(every))
    else:
        marked = F.broadcast(hot.withColumn("_hot", F.lit(True)))
        left = facts.join(marked, on, "left").withColumn(
            "_salt", F.when(F.col("_hot"), salt).otherwise(0)
        ).drop("_hot")
        right = plain.join(marked, on, "left").withColumn(
            "_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0))))
        ).drop("_hot")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def replace_tokens(
    docs: DataFrame, tokens: Column, value_of: Callable[[DataFrame], DataFrame],
    by: Sequence[str] = (),
) -> DataFrame:
    """The documents with ``text`` made of the values of their tokens, joined by blanks; NULL gives "".

    ``value_of`` adds the column ``value`` to a table (by, _part, token) and may leave out rows:
    such tokens stay as they are. The texts are dealt to parts of about PARTITION_CHARS characters;
    a part's distinct tokens are looked up once and put into its texts in one task, so that no row
    per occurrence is made, sorted or shuffled.
    """
    kept, keys = [c for c in docs.columns if c != "text"], [*by, "_part"]
    n = text_partitions(docs)
    dealt = docs.withColumn("_part", F.pmod(F.xxhash64("doc_name"), F.lit(n)).cast("int")).repartition(n, *keys)
    texts = computed_once(dealt, "_tokens", tokens).select(*kept, "_part", "_tokens")
    distinct = texts.select(*keys, F.explode("_tokens").alias("token")).distinct()
    values = value_of(distinct).select(*[F.col(c).alias(c) for c in (*keys, "token", "value")])
    out = docs.select(*kept, F.lit("").alias("text"))
    form = docs.sparkSession.createDataFrame([], out.schema).toArrow().schema

    def work(asked: pa.Table, known: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return form.empty_table()
        lists, table = asked["_tokens"].combine_chunks(), known["token"].combine_chunks()
        found = known["value"].combine_chunks().take(pc.index_in(lists.values, value_set=table))
        value = pa.ListArray.from_arrays(lists.offsets, pc.coalesce(found, lists.values))
        text = pc.if_else(pc.is_valid(lists), pc.binary_join(value, " "), "")
        return asked.select(kept).append_column("text", text).select(form.names).cast(form)

    return texts.groupBy(*keys).cogroup(values.groupBy(*keys)).applyInArrow(work, out.schema)


def top_k(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    k: int,
    salt_by: Sequence[str],
    rank: str = "rank",
) -> DataFrame:
    """The k first rows per group, ranked. Two steps: salted groups, then their winners,
    so that the last window sees at most ``SALTS * k`` rows however large the group is."""
    w1 = Window.partitionBy(*group, "_salt").orderBy(*order)
    w2 = Window.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn("_salt", salt_of(salt_by, SALTS))
        .withColumn(rank, F.row_number().over(w1))
        .where(F.col(rank) <= k)
        .drop("_salt")
        .withColumn(rank, F.row_number().over(w2))
        .where(F.col(rank) <= k)
    )


def bucket_of(name: str, buckets: int) -> Column:
    """Bucket number from the first hexadecimal digits of md5, the same in any SQL engine."""
    return F.pmod(F.conv(F.substring(F.md5(F.col(name)), 1, 6), 16, 10).cast("int"), F.lit(buckets))


def ordinal(
    df: DataFrame, group: Sequence[str], name: str, out: str = "ordinal", buckets: int = 256
) -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... in the order (bucket of the name, name).

    Windows run inside one bucket of one group; the offsets come from the table of
    bucket sizes, which has at most ``buckets`` rows per group.
    """
    keyed = df.withColumn("_bucket", bucket_of(name, buckets))
    sizes = keyed.groupBy(*group, "_bucket").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *group, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*group, "_bucket").orderBy(name)
    return (
        keyed.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, [*group, "_bucket"])
        .withColumn(out, F.col("_offset") + F.col("_rank") - 1)
        .drop("_bucket", "_rank", "_offset")
    )
