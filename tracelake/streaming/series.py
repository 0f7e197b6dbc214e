"""Counter and system-activity series as streams: the operators' means over event-time windows, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators import CID


def windowed(rows: DataFrame, at: str, size: str, late: str, *keys: str):
    """rows grouped by collection, window of the timestamp column and keys; rows later than `late` are dropped."""
    return rows.withWatermark(at, late).groupBy(CID, F.window(at, size), *keys)


def cpi_stream(rows: DataFrame, at: str = "ts", size: str = "10 seconds", late: str = "30 seconds") -> DataFrame:
    """Ratio of the sums of cycles and instructions in each window; rows: (collection_id, ts, metric_type, value)."""
    sums = {n: F.coalesce(F.sum(F.when(F.col("metric_type").startswith(n), F.col("value"))), F.lit(0)).alias(n) for n in ("cycles", "instructions")}
    d = windowed(rows, at, size, late).agg(*sums.values())
    return d.select(CID, F.col("window.start").alias("start"), "cycles", "instructions", F.try_divide(F.col("cycles").cast("double"), F.col("instructions").cast("double")).alias("CPI"))


def mean_stream(rows: DataFrame, *columns: str, at: str = "ts", size: str = "10 seconds", late: str = "30 seconds", keys: tuple[str, ...] = ()) -> DataFrame:
    """Means of the columns in each window."""
    d = windowed(rows, at, size, late, *keys).agg(*[F.avg(c).alias(f"avg_{c}") for c in columns])
    return d.select(CID, F.col("window.start").alias("start"), *keys, *[f"avg_{c}" for c in columns])
