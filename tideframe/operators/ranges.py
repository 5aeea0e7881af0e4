"""What went before, of rows in one long order: kept by range of that order, so that no task holds a whole key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS = 1 << 16  # of a key that a range should hold
RANGES = 4096  # of a block


def range_size(df: DataFrame, at: Column, rows: int | None = None) -> int:
    """How long ranges of the whole numbers `at` are to be to hold about `rows` rows each, from their extremes and count: one pass over one column.

    By default ROWS, or more where there are so many that a range should hold as many rows as there are ranges.
    """
    found = df.agg(F.min(at).alias("low"), F.max(at).alias("high"), F.count(at).alias("n")).first()
    if not found.n:
        return 1
    held = rows or max(ROWS, int(found.n**0.5))
    return max(1, (int(found.high) - int(found.low) + 1) * held // found.n)


def _same(keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for i, k in enumerate(keys):
        out = out & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return out


def before_each(parts: DataFrame, keys: Sequence[str], at: str, value: str, order: str, ranges: int | None = None) -> DataFrame:
    """parts, a row for each key and range `at`, with `before`: the value of the largest order among the key's earlier ranges, null if none has an order.

    Ranges go by blocks. A block's own earlier ranges come from a window over the block, earlier blocks from a join of the few
    blocks of a key with each other.
    """
    side = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    rows = parts.withColumn("_block", F.floor(F.col(at) / F.lit(ranges or RANGES)))
    best = F.max_by(F.struct(F.col(value).alias("v"), F.col(order).alias("o")), F.col(order))
    blocks = rows.groupBy(*keys, "_block").agg(best.alias("_best"))
    earlier = blocks.select(*side, F.col("_block").alias("_other"), F.col("_best").alias("_far"))
    past = blocks.select(*keys, "_block").join(earlier, _same(keys) & (F.col("_other") < F.col("_block")))
    past = past.groupBy(*keys, "_block").agg(F.max_by("_far", F.col("_far.o")).alias("_past"))
    past = past.select(*side, F.col("_block").alias("_other"), "_past")
    window = Window.partitionBy(*keys, "_block").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("_near", best.over(window)).join(past, _same(keys) & (F.col("_other") == F.col("_block")), "left")
    chosen = F.when(F.col("_past.o").isNull() | (F.col("_near.o") >= F.col("_past.o")), F.col("_near.v")).otherwise(F.col("_past.v"))
    return near.withColumn("before", chosen).select(*parts.columns, "before")


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], slices: Column, name: str = "position") -> DataFrame:
    """rows with their place among their key's in an order, from 1. slices, not null, must never fall along that order.

    Slices are counted, and a row is numbered within its own, after all rows of the slices before it.
    """
    cut = rows.withColumn("_slice", slices)
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    starts = counts.select(*keys, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order))
    return cut.join(starts, [*keys, "_slice"]).withColumn(name, F.col("_start") + place).drop("_slice", "_start")
