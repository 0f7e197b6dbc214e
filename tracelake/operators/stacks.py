"""Statistics over folded stacks: (collection_id, stack, weight), stack being 'process;frame;...;leaf'.

Costs count every occurrence of a symbol, so the inclusive cost of a recursive one can exceed the total; `once` counts each stack once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators import CID



def framed(stacks: DataFrame) -> DataFrame:
    """stacks with proc and frames (root first)."""
    parts = F.split("stack", ";")
    return stacks.withColumn("proc", parts[0]).withColumn("frames", F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))))


def ranked(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k first rows of each collection; k <= 0 gives none.  The limit reaches the map side."""
    w = Window.partitionBy(CID).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(k, 0))


def total_weight(stacks: DataFrame) -> DataFrame:
    return stacks.groupBy(CID).agg(F.sum("weight").alias("total"))


def topk_stacks(stacks: DataFrame, k: int = 10, key: Column | None = None) -> DataFrame:
    return ranked(stacks, k, (F.col("weight") if key is None else key).desc(), F.col("stack"))


def symbol_filter(name: Column, prefixes: Sequence[str] = (), suffixes: Sequence[str] = (), excludes: Sequence[str] = ()) -> Column:
    """Begins with one of the prefixes or ends with one of the suffixes (if any are given), and isn't excluded."""
    wanted = [name.startswith(p) for p in prefixes] + [name.endswith(s) for s in suffixes]
    out = reduce(lambda a, b: a | b, wanted) if wanted else F.lit(True)
    return out & ~name.isin(*excludes) if excludes else out


def process_filter(stacks: DataFrame, prefix: str | None = None, regex: str | None = None) -> DataFrame:
    d = framed(stacks)
    if prefix:
        d = d.filter(F.col("proc").startswith(prefix))
    return d.filter(F.col("proc").rlike(regex)) if regex else d


def _costs(rows: DataFrame, name: str) -> DataFrame:
    """From (collection_id, name, weight, leaf): inclusive and leaf cost."""
    return rows.groupBy(CID, name).agg(F.sum("weight").alias("inclusive"), F.sum(F.when(F.col("leaf"), F.col("weight")).otherwise(0)).alias("leaf"))


def symbol_hotspots(stacks: DataFrame, prefix: str | None = None, regex: str | None = None, once: bool = False, **names: Sequence[str]) -> DataFrame:
    """once: a stack counts once for each of its symbols, so that no inclusive cost exceeds the total."""
    d = process_filter(stacks, prefix, regex)
    if once:
        rows = d.select(CID, "weight", F.try_element_at("frames", F.lit(-1)).alias("last"), F.explode(F.array_distinct("frames")).alias("symbol"))
        leaf = F.col("symbol") == F.col("last")
    else:
        rows = d.select(CID, "weight", F.size("frames").alias("n"), F.posexplode("frames").alias("pos", "symbol"))
        leaf = F.col("pos") == F.col("n") - 1
    if names:
        rows = rows.filter(symbol_filter(F.col("symbol"), **names))
    return _costs(rows.withColumn("leaf", leaf), "symbol")


def topk_symbols(stacks: DataFrame, k: int = 10, by: str = "inclusive", once: bool = False) -> DataFrame:
    """Equal costs are ranked by the other cost (with once not), then by name."""
    if by not in ("inclusive", "leaf"):
        raise ValueError("by is inclusive or leaf")
    other = [] if once else [F.desc("leaf" if by == "inclusive" else "inclusive")]
    return ranked(symbol_hotspots(stacks, once=once), k, F.desc(by), *other, F.col("symbol"))


def symbol_share(stacks: DataFrame, symbol: str, by: str = "inclusive") -> DataFrame:
    """Share in [0, 1] (more for recursion) of the unfiltered total; 0 if the symbol is absent."""
    own = symbol_hotspots(stacks).filter(F.col("symbol") == symbol)
    share = F.coalesce(F.try_divide(F.col(by), F.col("total")), F.lit(0.0))
    return total_weight(stacks).join(own, CID, "left").select(CID, share.alias("share"))


def children_hotspots(stacks: DataFrame, parent: str, **names: Sequence[str]) -> DataFrame:
    """Costs of the frames right below the parent."""
    d = framed(stacks)
    n = F.size("frames")
    pairs = F.arrays_zip(F.slice("frames", 1, F.greatest(n - 1, F.lit(0))).alias("up"), F.slice("frames", 2, F.greatest(n - 1, F.lit(0))).alias("down"))
    rows = d.select(CID, "weight", n.alias("n"), F.posexplode(pairs).alias("pos", "p")).filter(F.col("p.up") == parent)
    rows = rows.select(CID, "weight", F.col("p.down").alias("symbol"), (F.col("pos") == F.col("n") - 2).alias("leaf"))
    if names:
        rows = rows.filter(symbol_filter(F.col("symbol"), **names))
    return _costs(rows, "symbol")


def dso_hotspots(stacks: DataFrame, resolver: DataFrame | Column) -> DataFrame:
    """Costs by module; resolver is a (symbol, dso) table or a Column over `symbol`.  Symbols without one are '[unknown]'."""
    d = framed(stacks)
    rows = d.select(CID, "weight", F.size("frames").alias("n"), F.posexplode("frames").alias("pos", "symbol"))
    rows = rows.groupBy(CID, "symbol").agg(F.sum("weight").alias("weight"), F.sum(F.when(F.col("pos") == F.col("n") - 1, F.col("weight")).otherwise(0)).alias("own"))
    rows = rows.withColumn("dso", resolver) if isinstance(resolver, Column) else rows.join(resolver.select("symbol", "dso"), "symbol", "left")
    return rows.groupBy(CID, F.coalesce("dso", F.lit("[unknown]")).alias("dso")).agg(F.sum("weight").alias("inclusive"), F.sum("own").alias("leaf"))


def subset_by_symbol(stacks: DataFrame, symbol: str, frames_only: bool = False) -> DataFrame:
    """Stacks with that frame, or with the text anywhere; frames_only leaves out stacks without frames."""
    d = framed(stacks).filter(F.array_contains("frames", symbol) | F.col("stack").contains(symbol))
    return d.filter(F.size("frames") > 0) if frames_only else d


def subset_by_path(stacks: DataFrame, path: Sequence[str], suffix: bool = False) -> DataFrame:
    """Stacks whose frames begin (or end) with the path."""
    if not path:
        raise ValueError("the path is empty")
    n, want = len(path), F.array(*map(F.lit, path))
    d = framed(stacks).filter(F.size("frames") >= n)
    return d.filter(F.slice("frames", -n if suffix else 1, n) == want)


def stacks_with_prefixes(stacks: DataFrame, prefixes: Sequence[str], k: int = 1000) -> DataFrame:
    """Of the k heaviest stacks those in which a frame begins with one of the prefixes."""
    return framed(topk_stacks(stacks, k)).filter(F.exists("frames", lambda f: symbol_filter(f, prefixes=prefixes)))


def percent_of(df: DataFrame, totals: DataFrame, *costs: str) -> DataFrame:
    """df with a percentage of the collection's total for each cost; a total of 0 or less counts as 1."""
    safe = F.when(F.col("total") > 0, F.col("total")).otherwise(1)
    d = df.join(totals, CID)
    return d.select(*df.columns, *[(F.col(c) * 100.0 / safe).alias(f"{c}_pct") for c in costs])


def symbol_shares(stacks: DataFrame) -> DataFrame:
    return percent_of(symbol_hotspots(stacks), total_weight(stacks), "inclusive", "leaf")


def stack_shares(stacks: DataFrame, k: int = 10) -> DataFrame:
    return percent_of(topk_stacks(stacks, k), total_weight(stacks), "weight")


def summary(stacks: DataFrame, k: int = 10, by: str = "inclusive", proc_prefix: str | None = None, once: bool = False) -> dict[str, DataFrame]:
    """Top symbols and top stacks with shares, and the total; the process filter applies to the stacks after the top k."""
    if k < 0:
        raise ValueError("k is negative")
    total = total_weight(stacks)
    top = framed(topk_stacks(stacks, k))
    if proc_prefix:
        top = top.filter(F.col("proc").startswith(proc_prefix))
    symbols = percent_of(topk_symbols(stacks, k, by, once), total, "inclusive", "leaf")
    return {"symbols": symbols, "stacks": percent_of(top.drop("frames", "proc"), total, "weight"), "total": total}


def subset_summary(stacks: DataFrame, symbol: str, k: int = 10, once: bool = False) -> dict[str, DataFrame]:
    """The summary of the subset, with shares of the subset's total."""
    return summary(subset_by_symbol(stacks, symbol).select(CID, "stack", "weight"), k, once=once)


def cooccurrence(stacks: DataFrame, a: str, b: str) -> DataFrame:
    """Weights of the stacks in which a frame contains a, b, or both somewhere, with percentages rounded half to even."""
    d = framed(stacks)
    has = {"a": F.exists("frames", lambda f: f.contains(a)), "b": F.exists("frames", lambda f: f.contains(b))}
    has["both"] = has["a"] & has["b"]
    sums = d.groupBy(CID).agg(F.sum("weight").alias("total"), *[F.sum(F.when(c, F.col("weight")).otherwise(0)).alias(n) for n, c in has.items()])
    return sums.select("*", *[F.bround(F.col(n) * 100.0 / F.col("total"), 2).alias(f"{n}_pct") for n in has])


def process_stacks_among_top(stacks: DataFrame, proc: str, k: int = 100) -> DataFrame:
    return framed(topk_stacks(stacks, k)).filter(F.col("proc") == proc)
