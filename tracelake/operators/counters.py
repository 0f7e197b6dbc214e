"""Operators over counter rows: (collection_id, ord, timestamp, cpu_id, value, metric_type[, run_pct]), cpu_id -1 for all CPUs.

An event is named by the beginning of its metric_type: `cycles` takes cycles:D, not ref-cycles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators import CID

AT = ["timestamp", "cpu_id"]


def normalise(rows: DataFrame) -> DataFrame:
    """One row for each timestamp, CPU and event: the first in file order."""
    return rows.filter(F.col("value").isNotNull()).groupBy(CID, *AT, "metric_type").agg(F.min_by("value", "ord").alias("value"))


def event(rows: DataFrame, name: str) -> DataFrame:
    return rows.filter(F.col("metric_type").startswith(name))


def on_threads(rows: DataFrame, threads: Sequence[int] | None) -> DataFrame:
    return rows if threads is None else rows.filter(F.col("cpu_id").isin(*threads))


def cpi(rows: DataFrame) -> DataFrame:
    """Cycles by instructions at each timestamp and CPU; several event names of one kind multiply the rows."""
    c = event(rows, "cycles").select(CID, *AT, F.col("value").alias("cycles"))
    i = event(rows, "instructions").select(CID, *AT, F.col("value").alias("instructions"))
    return c.join(i, [CID, *AT]).withColumn("CPI", F.try_divide(F.col("cycles").cast("double"), F.col("instructions").cast("double")))


def cpi_time(rows: DataFrame, threads: Sequence[int] | None = None) -> DataFrame:
    """Unweighted mean over CPUs; with threads, those CPUs' rows as they are."""
    return cpi(rows).groupBy(CID, "timestamp").agg(F.avg("CPI").alias("CPI")) if threads is None else on_threads(cpi(rows), threads)


def _sums(rows: DataFrame, keys: list[str], **events: str) -> DataFrame:
    wanted = [F.coalesce(F.sum(F.when(F.col("metric_type").startswith(e), F.col("value"))), F.lit(0)).alias(n) for n, e in events.items()]
    return rows.groupBy(CID, *keys).agg(*wanted)


def cpi_overall(rows: DataFrame, data_type: str = "thread") -> DataFrame:
    """Ratio of the sums, by CPU or for the whole system."""
    if data_type not in ("thread", "system"):
        raise ValueError("data_type is thread or system")
    d = _sums(rows, ["cpu_id"] if data_type == "thread" else [], cycles="cycles", instructions="instructions")
    return d.withColumn("CPI", F.try_divide(F.col("cycles").cast("double"), F.col("instructions").cast("double")))


def cpi_by_threads(rows: DataFrame, threads: Sequence[int]) -> DataFrame:
    return cpi_overall(on_threads(rows, threads), "system")


def cpi_average_by_threads(rows: DataFrame, threads: Sequence[int]) -> DataFrame:
    return on_threads(cpi_overall(rows), threads).groupBy(CID).agg(F.avg("CPI").alias("CPI"))


def events_overall(rows: DataFrame, name: str, data_type: str = "thread") -> DataFrame:
    if data_type not in ("thread", "system"):
        raise ValueError("data_type is thread or system")
    return _sums(rows, ["cpu_id"] if data_type == "thread" else [], value=name)


def event_by_threads(rows: DataFrame, name: str, threads: Sequence[int] | None) -> DataFrame:
    return _sums(on_threads(rows, threads), [], value=name)


def path_length(rows: DataFrame, transactions: float, threads: Sequence[int] | None = None) -> DataFrame:
    """Instructions a transaction."""
    return event_by_threads(rows, "instructions", threads).select(CID, (F.col("value") / transactions).alias("path_length"))


def per_second(rows: DataFrame, name: str, threads: Sequence[int] | None = None, seconds: float = 120) -> DataFrame:
    return event_by_threads(rows, name, threads).select(CID, (F.col("value") / seconds).alias("per_second"))


def time_range(rows: DataFrame) -> DataFrame:
    low, high = F.min("timestamp"), F.max("timestamp")
    return rows.groupBy(CID).agg(low.alias("start"), high.alias("end"), (high - low).alias("total"))


def time_delta(rows: DataFrame, raw: bool = False) -> DataFrame:
    """Mean step between distinct timestamps; raw: the span over the number of rows less one."""
    span = F.max("timestamp") - F.min("timestamp")
    n = F.count("*") if raw else F.count_distinct("timestamp")
    return rows.groupBy(CID).agg(F.try_divide(span, (n - 1).cast("double")).alias("delta"))


def is_multiplexing(rows: DataFrame) -> DataFrame:
    """Whether a counter didn't run all the time."""
    return rows.groupBy(CID).agg(F.coalesce(F.bool_or(F.col("run_pct") != 100), F.lit(False)).alias("multiplexing"))


def wide(rows: DataFrame, events: Sequence[str]) -> DataFrame:
    """A column for each event; naming them saves the job that would look for them."""
    return rows.groupBy(CID, *AT).pivot("metric_type", list(events)).agg(F.min_by("value", "ord"))


def tidy(rows: DataFrame, events: Sequence[str], threads: Sequence[int]) -> DataFrame:
    """A column {event}_{cpu} for each event and CPU (the mean); of one CPU the wide rows."""
    d = on_threads(wide(rows, events), threads)
    if len(threads) == 1:
        return d
    cells = [F.avg(F.when(F.col("cpu_id") == t, F.col(e))).alias(f"{e}_{t}") for e in events for t in threads]
    return d.groupBy(CID, "timestamp").agg(*cells)


def available_events(rows: DataFrame) -> DataFrame:
    return rows.select(CID, "metric_type").distinct()


def combined_wide(events: DataFrame, metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """Events and metrics (with ' (%)' behind their names) side by side; an empty or missing cpu is all."""
    e = events.select(CID, "timestamp", "cpu", F.col("event_name").alias("name"), "value")
    m = metrics.select(CID, "timestamp", "cpu", F.concat("metric_name", F.lit(" (%)")).alias("name"), "value")
    cpu = F.when(F.coalesce("cpu", F.lit("")) == "", "all").otherwise(F.col("cpu"))
    return e.unionByName(m).groupBy(CID, "timestamp", cpu.alias("cpu")).pivot("name", list(names)).agg(F.avg("value"))


def mean_step(rows: DataFrame) -> Column:
    """The step before each timestamp of a series, for time_delta's callers that want the steps themselves."""
    return F.col("timestamp") - F.lag("timestamp").over(Window.partitionBy(CID).orderBy("timestamp"))
