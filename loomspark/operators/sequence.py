"""Ordered analysis by windows: gaps, runs, blocks, carried values.

Every function partitions by a session key, so work of different sessions is
independent; order columns must be unique within a session for stable results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds_between(a: Column, b: Column) -> Column:
    """b - a in seconds of two timestamps, exact to the microsecond."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(b) - micros(a)) / 1000000


def active_seconds(df: DataFrame, key: str, ts: str, limit_seconds: int = 300) -> DataFrame:
    """(key, active_seconds): consecutive gaps up to the limit, summed; null with fewer than two stamps."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gaps = df.where(F.col(ts).isNotNull()).select(key, (micros - F.lag(micros).over(Window.partitionBy(key).orderBy(micros))).alias("gap"))
    total = F.sum(F.when(F.col("gap") <= limit_seconds * 1000000, F.col("gap")).otherwise(0))
    return gaps.groupBy(key).agg(F.when(F.count(F.lit(1)) >= 2, total / 1000000).alias("active_seconds"))


def number_runs(df: DataFrame, key: str, order: str, same: list[str], max_gap: int | None = None, name: str = "run") -> DataFrame:
    """Adds run: rows of a key in order belong together while `same` stays equal (and order grows by max_gap at most)."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.lag(order).over(w).isNull()
    for c in same:
        new = new | ~F.lag(c).over(w).eqNullSafe(F.col(c))
    if max_gap is not None:
        new = new | (F.col(order) - F.lag(order).over(w) > max_gap)
    flagged = df.withColumn("_new", F.when(new, 1).otherwise(0))
    return flagged.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def number_blocks(df: DataFrame, key: str, order: str, starts: Column, name: str = "block") -> DataFrame:
    """Adds block: how many rows where `starts` holds lie at or before the row."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w).cast("long"))


def carry_last(df: DataFrame, key: str, order: list[str], value: Column, name: str, include_row: bool = True) -> DataFrame:
    """Adds the last non-null value at or before the row (before it, without include_row): an as-of lookup in one pass."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if include_row else -1)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def as_of(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, values: list[str]) -> DataFrame:
    """left with the values of the latest right row of its key with right_at <= left_at.

    Union and carry: one shuffle by key, no range join, and a key's rows are only
    sorted, never crossed.  Right rows with equal right_at: the largest values win.
    """
    r = right.select(F.col(key), F.col(right_at).alias("_at"), F.struct(*values).alias("_v"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_row"))
    l = left.select(F.col(key), F.col(left_at).alias("_at"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v"), F.lit(1).alias("_side"), F.struct("*").alias("_row"))
    both = carry_last(r.unionByName(l), key, ["_at", "_side", "_v"], F.col("_v"), "_last")
    return both.where("_side = 1").select("_row.*", *[F.col("_last")[v].alias(v) for v in values])


def upper_median(value: str) -> Column:
    """Element n div 2 of the sorted values (aggregate)."""
    xs = F.array_sort(F.collect_list(value))
    return F.get(xs, F.floor(F.size(xs) / 2).cast("int"))


def truncated_ratio(a: Column, b: Column) -> Column:
    """a / b cut to three decimals; null if b is 0."""
    return F.floor(a * 1000 / F.nullif(b, F.lit(0))) / 1000


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; rows with an empty or null last key all stay."""
    w = Window.partitionBy(*keys).orderBy(*order)
    blank = F.col(keys[-1]).isNull() | (F.col(keys[-1]) == "")
    return df.withColumn("_r", F.row_number().over(w)).where((F.col("_r") == 1) | blank).drop("_r")


def pairs_within(df: DataFrame, key: str, item: str) -> DataFrame:
    """(item_a, item_b, n): in how many keys two different items occur together."""
    d = df.select(key, item).where(F.col(item).isNotNull()).distinct()
    a, b = d.select(key, F.col(item).alias(f"{item}_a")), d.select(key, F.col(item).alias(f"{item}_b"))
    return a.join(b, key).where(F.col(f"{item}_a") < F.col(f"{item}_b")).groupBy(f"{item}_a", f"{item}_b").agg(F.count(F.lit(1)).alias("n"))
