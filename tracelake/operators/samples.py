"""Operators over samples: flat ones (one address each) and those with a call chain.

A sample is (collection_id, ord, command, pid, cpu, time, value, event) with `calls`, an array of (addr, symbol, dso), leaf first;
a flat one has addr, symbol and dso_short_name instead.  time is text; its exact number is decimal(20,9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.text import after_last_plus, before_last_plus
from tracelake.operators import CID

PLACE = ["time", "cpu", "command", "pid", "addr", "symbol", "dso_short_name"]
SIDE, BLOCK = 1024, 512


def seconds(time: Column) -> Column:
    return time.try_cast("decimal(20,9)")


def flat_wide(flat: DataFrame, place: Sequence[str] = PLACE, pair: str = "all", digits: int | None = None) -> DataFrame:
    """Cycles beside instructions of the same place, with their CPI.

    pair says what becomes of several samples of a place.  "all": each beside each, so that n and m of a place make n * m rows - as
    the wide form is defined, fit for places that hold few samples, such as the full key with its time.  "order": the k-th beside the
    k-th by `ord` (of one `ord` by value), as many as both have.  "sum": the sums of both, one row for a place.  The latter two grow with the samples only.  "all" counts the equal
    values of a place, at most SIDE of them in a row, joins and divides them once, deals these rows into all parts of a shuffle, wherever
    their place is, and then repeats them for each pair: BLOCK rows at a time in a cross join, the rest of a block from an array.

    digits: the CPI is rounded to so many before rows are repeated."""
    if pair not in ("all", "order", "sum"):
        raise ValueError("pair is all, order or sum")
    both = F.col("event").isin("cycles", "instructions")
    ratio = F.try_divide(F.col("cycles").cast("double"), F.col("instructions").cast("double"))
    ratio = (ratio if digits is None else F.round(ratio, digits) + 0.0).alias("CPI")
    if pair == "sum":
        cells = [F.sum(F.when(F.col("event") == e, F.col("value"))).alias(e) for e in ("cycles", "instructions")]
        d = flat.filter(both).dropna(subset=list(place)).groupBy(CID, *place).agg(*cells)
        return d.filter("cycles is not null and instructions is not null").select("*", ratio)
    key = [CID, *place]
    if pair == "order":
        key.append("k")
        d = flat.filter(both).withColumn("k", F.row_number().over(Window.partitionBy(CID, *place, "event").orderBy("ord", "value")))
        c = d.filter(F.col("event") == "cycles").select(*key, F.col("value").alias("cycles"))
        i = d.filter(F.col("event") == "instructions").select(*key, F.col("value").alias("instructions"))
        return c.join(i, key).drop("k").select("*", ratio)
    sides = []
    for event, n, part in (("cycles", "n", "c"), ("instructions", "m", "i")):
        counted = flat.filter(F.col("event") == event).groupBy(*key, F.col("value").alias(event)).agg(F.count("*").alias(n))
        cut = counted.select(*key, event, n, F.explode(F.sequence(F.lit(1), n, F.lit(SIDE))).alias(part))
        sides.append(cut.withColumn(n, F.least(F.lit(SIDE), F.col(n) - F.col(part) + 1)))
    spark = flat.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = sides[0].join(sides[1], key).repartition(parts, *key, "cycles", "instructions", "c", "i")
    out = out.select(*key, "cycles", "instructions", ratio, (F.col("n") * F.col("m")).cast("int").alias("pairs"))
    repeated = lambda times: out.select(*key, "cycles", "instructions", F.explode(F.array_repeat("CPI", times.cast("int"))).alias("CPI"))
    block = spark.range(0, BLOCK, 1, 1).select().hint("shuffle_replicate_nl")
    return repeated(F.col("pairs") % BLOCK).unionByName(repeated(F.floor(F.col("pairs") / BLOCK)).crossJoin(block))


def flat_tidy(d: DataFrame, threads: Sequence[int], columns: Sequence[str] = ("cycles", "instructions", "CPI"), key: Sequence[str] = ("time",)) -> DataFrame:
    """A column {column}_{cpu} for each (the first by time and address); of one CPU the rows as they are."""
    d = d.filter(F.col("cpu").isin(*threads))
    if len(threads) == 1:
        return d
    order = F.struct(*[F.col(c) for c in PLACE if c in d.columns and c not in key], *[F.col(c) for c in columns])
    cells = [F.min_by(F.when(F.col("cpu") == t, F.col(c)), F.when(F.col("cpu") == t, order)).alias(f"{c}_{t}") for c in columns for t in threads]
    return d.groupBy(CID, *key).agg(*cells)


def commands(samples: DataFrame) -> DataFrame:
    """CPUs and modules of each command."""
    d = samples.select(CID, "command", "cpu", F.explode_outer("calls.dso").alias("dso"))
    return d.groupBy(CID, "command").agg(F.sort_array(F.collect_set("cpu")).alias("cpus"), F.sort_array(F.collect_set("dso")).alias("dsos"))


def in_window(samples: DataFrame, start: str | float | None = None, end: str | float | None = None, delta: str | float | None = None) -> DataFrame:
    """Samples between start and end, both inclusive; missing bounds are the first and last sample in file order.

    A delta counts back from an end alone, else on from the start.  0 and text that is no number count as missing; a collection
    with fewer than two samples stays as it is."""

    def number(x):
        try:
            return float(x) or None if x is not None else None
        except (TypeError, ValueError):
            return None

    s, e, d = (str(x) if number(x) is not None else None for x in (start, end, delta))
    if s is None and e is None and d is None:
        return samples
    at = seconds(F.col("time"))
    edges = samples.groupBy(CID).agg(F.min_by(at, "ord").alias("first"), F.max_by(at, "ord").alias("last"), F.count("*").alias("n"))
    low = F.lit(s).cast("decimal(20,9)") if s else F.col("first")
    high = F.lit(e).cast("decimal(20,9)") if e else F.col("last")
    if d:
        step = F.lit(d).cast("decimal(20,9)")
        low, high = (high - step, high) if e and not s else (low, low + step)
    return samples.join(edges, CID).filter((F.col("n") < 2) | ((at >= low) & (at <= high))).drop("first", "last", "n")


def of_commands(samples: DataFrame, *names: str) -> DataFrame:
    return samples.filter(F.col("command").isin(*names))


def of_pids(samples: DataFrame, *pids: int) -> DataFrame:
    return samples.filter(F.col("pid").isin(*pids))


def of_cpus(samples: DataFrame, *cpus: int) -> DataFrame:
    return samples.filter(F.col("cpu").isin(*cpus))


def raw_rows(samples: DataFrame) -> DataFrame:
    """The chain as one text a call: 'addr symbol (dso)'."""
    return samples.withColumn("calls", F.transform("calls", lambda c: F.concat(c["addr"], F.lit(" "), c["symbol"], F.lit(" ("), c["dso"], F.lit(")"))))


def flat_rows(samples: DataFrame) -> DataFrame:
    """A row for each call; a sample without calls gives one with NULL."""
    return raw_rows(samples).withColumn("calls", F.explode_outer("calls"))


def leaf_rows(samples: DataFrame) -> DataFrame:
    """The leaf call beside the header, its symbol cut from its offset."""
    leaf = F.get("calls", F.lit(0))
    symbol = leaf["symbol"]
    return samples.select("*", leaf["addr"].alias("addr"), before_last_plus(symbol).alias("symbol"), after_last_plus(symbol).alias("offset"), leaf["dso"].alias("dso")).drop("calls")


def metric_by_symbol(samples: DataFrame, numerator: str, denominator: str, name: str | None = None) -> DataFrame:
    """Ratio of two events by leaf symbol: the mean at each time, symbol and CPU, summed over those where either occurs."""
    d = leaf_rows(samples).filter(F.col("event").isin(numerator, denominator))
    mean = d.groupBy(CID, "time", "symbol", "cpu", "event").agg(F.avg("value").alias("v"))
    sums = [F.sum(F.when(F.col("event") == e, F.col("v"))).alias(e) for e in (numerator, denominator)]
    out = mean.groupBy(CID, "symbol").agg(*sums)
    return out.withColumn(name or f"{numerator}_ratio", F.try_divide(F.col(numerator), F.col(denominator)))


def top_metric(metric: DataFrame, column: str, k: int) -> DataFrame:
    w = Window.partitionBy(CID).orderBy(F.desc_nulls_last(column), "symbol")
    return metric.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
