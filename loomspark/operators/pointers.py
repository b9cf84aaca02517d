"""Pointer jumping: what rows inherit along chains of references, in as many joins as the depth has bits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.sources.cache import stored


def climb(state: DataFrame, merged: dict[str, Callable[[Column, Column], Column]], levels: list[DataFrame] | None = None, keep_going: Callable[[Column], Column] | None = None) -> DataFrame:
    """state (path, line_no, ptr, values) with each value merged with those of all rows that ptr leads to.

    merged: for each value, a function of (own, above) that may be applied in any grouping.  ptr is a line_no of the
    same path, or null.  levels gets the state before each jump.  keep_going says by the first value for which
    rows to go on at all.
    """
    while state.where("ptr is not null").limit(1).count():
        if levels is not None:
            levels.append(state)
        above = state.select("path", F.col("line_no").alias("ptr"), F.col("ptr").alias("_ptr"), *[F.col(c).alias(f"_{c}") for c in merged])
        put = [F.when(F.col("ptr").isNotNull(), f(F.col(c), F.col(f"_{c}"))).otherwise(F.col(c)).alias(c) for c, f in merged.items()]
        pointer = F.col("_ptr") if keep_going is None else F.when(keep_going(put[0]), F.col("_ptr"))
        rest = [c for c in state.columns if c not in ("path", "line_no", "ptr", *merged)]
        state = stored(state.join(above, ["path", "ptr"], "left").select("path", "line_no", pointer.alias("ptr"), *put, *rest).select(*state.columns), "jump")
    return state
