"""Vectors as the embedding operators take them: which take part, exact copies collapsed, numpy views."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def takes_part(col):
    """Not null, not all zero, no null and no non-finite component."""
    finite = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(col, lambda x: x != 0), F.lit(False))


def keyed(rows: DataFrame, *more: str) -> DataFrame:
    """Rows that take part, with h1 and h2, a 128-bit key of the vector."""
    e = F.col("embedding").cast("array<double>")
    return rows.where(takes_part(F.col("embedding"))).select("vec_id", *more, "embedding", F.xxhash64(e).alias("h1"), F.xxhash64(F.lit(1), e).alias("h2"))


def matrix(col: pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """A list column whose rows have one length, as a matrix."""
    col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = col.chunk(0)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1).astype(dtype)


def sample(distinct: DataFrame, n: int) -> DataFrame:
    """n rows of distinct vectors for each length, by hash of their key: the same rows at every run.

    Rows are taken by a limit of their hash that follows from the number of vectors, so
    the task that ranks a length sees about 2 n rows however large the table is.
    """
    size, place = F.size("embedding"), F.pmod(F.xxhash64("h1", "h2"), F.lit(1 << 40))
    counts = distinct.groupBy(size.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()
    limits = distinct.sparkSession.createDataFrame([(r["d"], int(min(1.0, (2 * n + 100) / r["n"]) * (1 << 40))) for r in counts], "d int, upto long")
    near = distinct.join(F.broadcast(limits), size == F.col("d")).where(place < F.col("upto")).drop("d", "upto")
    w = Window.partitionBy(size).orderBy(place, "h1", "h2")
    return near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")
