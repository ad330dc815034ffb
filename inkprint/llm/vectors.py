"""Vectors as integers: checked, dealt to blocks of bounded size, and packed into one row per block."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.session import materialize

#: Scores under 2^53 are exact in doubles, those under 2^63 in 64-bit integers.
EXACT, LARGEST = 1 << 53, 1 << 63


def whole_numbers(rows: DataFrame, vector: Column | str, columns: list[Column], scale: int = 256) -> DataFrame:
    """``columns`` and ``v``, the components floor(scale * x) as integers.

    Rows whose vector is null or holds a null or non-finite component are left out.
    """
    x = F.col(vector) if isinstance(vector, str) else vector
    x = x.cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(x.isNotNull() & F.coalesce(fine, F.lit(False))).select(
        *columns, F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("v")
    )


def matrix(lists: pa.Array) -> np.ndarray:
    """Lists of integers as the rows of a matrix; shorter ones are filled up with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
    out = np.zeros((len(lists), int(sizes.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.asarray(lists.flatten(), dtype=np.int64)
    return out


def ready(*parts: np.ndarray) -> list[np.ndarray]:
    """Matrices of one width, of the kind of number in which their inner products are exact."""
    width = max((p.shape[1] for p in parts), default=0)
    most = max((int(np.abs(p).max(initial=0)) for p in parts), default=0)
    size = most * most * max(width, 1)
    if size >= LARGEST:
        raise ValueError("inner products of these vectors don't fit into 64 bits")
    kind = np.float64 if size < EXACT else np.int64
    return [np.pad(p, ((0, 0), (0, width - p.shape[1]))).astype(kind) for p in parts]


def pack(values: np.ndarray) -> tuple[bytes, str]:
    """Bytes of a matrix of integers in the smallest type that holds them, and the type."""
    most = int(np.abs(values).max(initial=0))
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    return np.ascontiguousarray(values, dtype=kind).tobytes(), kind


def unpack(data: bytes, kind: str, rows: int) -> np.ndarray:
    return np.frombuffer(data, dtype=kind).astype(np.int64).reshape(rows, -1)


def arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    """Arrow's schema for a schema in words."""
    return df.sparkSession.createDataFrame([], schema).toArrow().schema


def dealt(rows: DataFrame, size: int, name: str = "block") -> tuple[DataFrame, int]:
    """Deal rows evenly to blocks 0, 1, ... of about ``size`` rows. Equal rows are dealt apart."""
    rows = materialize(rows)
    count = max(1, ceil(rows.count() / size))
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(count)).cast("int")
    return rows.withColumn(name, place), count


def packed(rows: DataFrame, id_kind: str, block: str = "block") -> DataFrame:
    """One row per block: (block, ids, labels, marks, data, kind) from (block, id, label, mark, v).

    ``label`` and ``mark`` are long and double columns that the caller gives a meaning.
    """
    def work(table: pa.Table) -> pa.Table:
        data, kind = pack(matrix(table["v"]))
        lists = [[table[c].to_pylist()] for c in ("id", "label", "mark")]
        columns = [[table[block][0].as_py()], *lists, [data], [kind]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, form)], schema=form)

    schema = f"{block} int, ids array<{id_kind}>, labels array<long>, marks array<double>, data binary, kind string"
    form = arrow_schema(rows, schema)
    return rows.select(block, "id", F.col("label").cast("long"), F.col("mark").cast("double"), "v").groupBy(
        block
    ).applyInArrow(work, schema)


def each(name: str, count: int) -> Column:
    """Every block number from 0 up to ``count``, to send a row to all of them."""
    return F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
