"""The call tree of folded stacks as a table: one row for each path of frames from the root (the process is left out)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators import CID
from tracelake.operators.stacks import framed


def leaf_paths(stacks: DataFrame) -> DataFrame:
    """(collection_id, path, count): weights by the frames alone, summed before anything is exploded."""
    d = framed(stacks).filter(F.size("frames") > 0)
    return d.groupBy(CID, F.col("frames").alias("path")).agg(F.sum("weight").alias("count"))


def build_tree(stacks: DataFrame) -> DataFrame:
    """(collection_id, path, depth, name, count, leaf_count), count being inclusive."""
    size = F.size("path")
    prefixes = F.transform(F.sequence(F.lit(1), size), lambda i: F.slice("path", 1, i))
    rows = leaf_paths(stacks).select(CID, "count", size.alias("n"), F.explode(prefixes).alias("path"))
    own = F.when(F.size("path") == F.col("n"), F.col("count")).otherwise(0)
    tree = rows.groupBy(CID, "path").agg(F.sum("count").alias("count"), F.sum(own).alias("leaf_count"))
    return tree.select(CID, "path", F.size("path").alias("depth"), F.element_at("path", -1).alias("name"), "count", "leaf_count")


def path_stats(stacks: DataFrame, limit: int = 0) -> DataFrame:
    """Leaf paths with their percentage, heaviest first; limit 0 is all; truncated tells whether more were there."""
    if limit < 0:
        raise ValueError("limit is negative")
    paths = leaf_paths(stacks)
    totals = paths.groupBy(CID).agg(F.sum("count").alias("total"), F.count("*").alias("n"))
    d = paths.join(totals, CID).withColumn("percent", F.col("count") * 100.0 / F.when(F.col("total") > 0, F.col("total")).otherwise(1))
    d = d.withColumn("truncated", (F.col("n") > limit) & F.lit(limit > 0)).drop("n", "total")
    if not limit:
        return d
    w = Window.partitionBy(CID).orderBy(F.desc("count"), F.array_join("path", ";"))
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def tree_symbols(stacks: DataFrame) -> DataFrame:
    return build_tree(stacks).groupBy(CID, F.col("name").alias("symbol")).agg(F.sum("count").alias("inclusive"), F.sum("leaf_count").alias("leaf"))


def symbol_overhead(stacks: DataFrame, symbol: str, k: int | None = None, fuzzy: bool = False) -> DataFrame:
    """One row for each tree node of the symbol: the weight that ends at most k frames below it (None: any depth, 0: there)."""
    if not symbol:
        raise ValueError("the symbol is empty")
    paths = leaf_paths(stacks)
    rows = paths.select(CID, "count", "path", F.posexplode("path").alias("pos", "name"))
    rows = rows.filter(F.col("name").contains(symbol) if fuzzy else F.col("name") == symbol)
    counted = F.lit(True) if k is None else F.size("path") - F.col("pos") - 1 <= k
    nodes = rows.groupBy(CID, F.slice("path", F.lit(1), F.col("pos") + 1).alias("path")).agg(F.sum(F.when(counted, F.col("count")).otherwise(0)).alias("overhead"))
    total = paths.groupBy(CID).agg(F.sum("count").alias("total"))
    return nodes.join(total, CID).select(CID, "path", "overhead", (F.col("overhead") * 100.0 / F.col("total")).alias("percent"))


def sorted_tree(stacks: DataFrame, start: str | None = None, fuzzy: bool = False, k: int | None = None, max_children: int | None = None) -> DataFrame:
    """Tree rows with their rank among siblings (heaviest first, then by name); below nodes named `start`, down to k levels.

    With max_children a node of a higher rank goes, with all below it."""
    tree = build_tree(stacks)
    w = Window.partitionBy(CID, F.slice("path", F.lit(1), F.col("depth") - 1)).orderBy(F.desc("count"), "name")
    d = tree.withColumn("rank", F.row_number().over(w))
    if max_children is not None:
        cut = d.filter(F.col("rank") > max_children).select(CID, F.col("path").alias("cut"))
        d = d.withColumn("up", F.explode(F.transform(F.sequence(F.lit(1), "depth"), lambda i: F.slice("path", 1, i))))
        low = d.join(cut.withColumnRenamed("cut", "up"), [CID, "up"], "left_semi").select(CID, "path").distinct()
        d = tree.withColumn("rank", F.row_number().over(w)).join(low, [CID, "path"], "left_anti")
    if start is None:
        return d.withColumn("root", F.slice("path", 1, 1)) if k is None else d.filter(F.col("depth") <= k + 1).withColumn("root", F.slice("path", 1, 1))
    hit = F.transform("path", lambda x, i: F.struct((i + 1).alias("at"), (x.contains(start) if fuzzy else x == start).alias("ok")))
    at = F.transform(F.filter(hit, lambda x: x["ok"]), lambda x: x["at"])
    d = d.select("*", F.explode(at).alias("at"))
    if k is not None:
        d = d.filter(F.col("depth") - F.col("at") <= k)
    return d.withColumn("root", F.slice("path", F.lit(1), F.col("at"))).drop("at")
