"""Exact quantiles by refinement: a histogram finds the bucket that holds a rank, and only that bucket's values are ordered.

`percentile` keeps all distinct values of a group in one buffer.  Here equal values are counted first, spread over tasks by value;
buckets follow a fixed scale (the sign and the binary logarithm in steps of 1/32), so that they need no pass of their own; a group has
few thousand of them however many rows it has; and values of the bucket with the rank are ordered by a sort that spills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets for each doubling of the value.
STEPS = 32


def bucket(x: Column) -> Column:
    """A whole number that does not fall where x grows; NaN is the largest."""
    size = F.abs(x)
    place = F.floor(F.log2(size) * STEPS) + 1100 * STEPS  # above 0 for the smallest numbers, too
    place = F.when(size == float("inf"), 4000 * STEPS).otherwise(place)
    return F.when(F.isnan(x), 8000 * STEPS).when(x == 0, 0).when(x > 0, place).otherwise(-place).cast("int")


def quantiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str], share: float) -> DataFrame:
    """(*keys, q_<column> ...) of each group: the value at `share` of the way through the column's values, neighbours interpolated.  Null
    values are left out; a column without values is NULL; a group without any, or with a null key, gives no row."""
    keys = list(keys)
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns)]))
    d = df.select(*keys, cells.alias("_v")).select(*keys, F.col("_v.c").alias("_c"), F.col("_v.x").alias("_x"))
    d = d.withColumn("_b", bucket(F.col("_x"))).dropna(subset=[*keys, "_x", "_b"])
    by = [*keys, "_c"]
    # Equal values together, whose counts both the histogram and the buckets' values come from: all that joins ask of them is known
    # above, so that Spark sees the same table in both places and makes it once.
    counts = d.groupBy(*by, "_b", "_x").agg(F.count("*").alias("_n"))
    bars = counts.groupBy(*by, "_b").agg(F.sum("_n").alias("_n"))
    w = Window.partitionBy(*by)
    bars = bars.withColumn("_end", F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_rank", (F.sum("_n").over(w) - 1) * share)
    # Ranks count from 0: the one below and the one above, which may stand in two buckets.
    low, high = F.floor("_rank"), F.ceil("_rank")
    first = F.col("_end") - F.col("_n")
    held = bars.filter(((first <= low) & (low < F.col("_end"))) | ((first <= high) & (high < F.col("_end")))).select(*by, "_b", first.alias("_first"), "_rank")
    values = counts.join(held, [*by, "_b"])
    end = F.col("_first") + F.sum("_n").over(Window.partitionBy(*by, "_b").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    values = values.withColumn("_end", end).withColumn("_begin", F.col("_end") - F.col("_n"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_begin") <= rank) & (rank < F.col("_end")), F.col("_x")))

    found = values.groupBy(*by, "_rank").agg(at(low).alias("_lo"), at(high).alias("_hi"))
    exact = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_rank") - F.floor("_rank")))
    return found.withColumn("_q", exact).groupBy(*keys).agg(*[F.max(F.when(F.col("_c") == i, F.col("_q"))).alias(f"q_{c}") for i, c in enumerate(columns)])
