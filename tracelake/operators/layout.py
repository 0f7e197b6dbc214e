"""The table behind a flame graph: for each block its depth, its extent on the x axis and, for two weights, its change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.shared import checkpointed
from tracelake.operators import CID


def layout(stacks: DataFrame, flamechart: bool = False, reverse: bool = False, second: str | None = None) -> DataFrame:
    """(collection_id, name, depth, x_start, x_end[, delta]).  Stacks stand side by side in the order of their text (or, for a
    flame chart, of `ord` from last to first); equal prefixes of neighbours merge.

    With a second weight the extents come from it and delta is the change on the leaf blocks."""
    parts = F.split("stack", ";")
    change = (F.col(second) - F.col("weight")) if second else F.lit(0)
    d = stacks.withColumn("parts", F.reverse(parts) if reverse else parts).withColumn("width", F.col(second or "weight")).withColumn("change", change)
    out = in_given_order(d) if flamechart else in_text_order(d)
    keep = [CID, "name", "depth", "x_start", "x_end"]
    return out.select(*keep, F.coalesce("delta", F.lit(0)).alias("delta")) if second else out.select(*keep)


def in_text_order(d: DataFrame) -> DataFrame:
    """Blocks of stacks (parts, width, change) by their text, with no window over more than the frames below one prefix.

    Below a prefix the stacks that end with a frame stand where its name does, and those that go on where its name and a ; do; so
    names may come between the two.  Each frame's place below its prefix is a running sum there, and its place in the drawing adds
    up those of the prefixes above."""
    lines = d.groupBy(CID, "parts").agg(F.sum("width").alias("width"), F.sum("change").alias("change"))
    at = lines.select(CID, "parts", "width", "change", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"))
    ends = F.col("depth") == F.size("parts")
    frames = at.select(CID, "depth", F.slice("parts", F.lit(1), F.col("depth") - 1).alias("above"), F.get("parts", F.col("depth") - 1).alias("name"), ends.alias("ends"), "width", F.when(ends, F.col("change")).alias("change"))
    frames = frames.groupBy(CID, "depth", "above", "name", "ends").agg(F.sum("width").alias("width"), F.sum("change").alias("change"))
    w = Window.partitionBy(CID, "depth", "above").orderBy(F.when(F.col("ends"), F.col("name")).otherwise(F.concat("name", F.lit(";"))))
    x1 = F.sum("width").over(w.rowsBetween(Window.unboundedPreceding, 0))
    frames = frames.select("*", (x1 - F.col("width")).alias("x0"), x1.alias("x1"), (~F.col("ends") & ~F.coalesce(F.lag("name").over(w) == F.col("name"), F.lit(False))).alias("apart"))
    on = frames.filter(~F.col("ends")).select(CID, F.concat("above", F.array("name")).alias("path"), "x0")
    prefixes = on.select(CID, "path", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice("path", F.lit(1), i))).alias("prefix"))
    base = prefixes.join(on.select(CID, F.col("path").alias("prefix"), "x0"), [CID, "prefix"]).groupBy(CID, F.col("path").alias("above")).agg(F.sum("x0").alias("base"))
    blocks = frames.groupBy(CID, "depth", "above", "name", "apart").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.sum("change").alias("delta"))
    placed = blocks.join(base, [CID, "above"], "left").withColumn("base", F.coalesce("base", F.lit(0)))
    whole = lines.groupBy(CID).agg(F.sum("width").alias("x1")).select(CID, F.lit("").alias("name"), F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("x_start"), F.col("x1").alias("x_end"), F.lit(None).cast("bigint").alias("delta"))
    return whole.unionByName(placed.select(CID, "name", "depth", (F.col("base") + F.col("x0")).alias("x_start"), (F.col("base") + F.col("x1")).alias("x_end"), "delta"))


def in_given_order(d: DataFrame) -> DataFrame:
    """Blocks of stacks (parts, width, change) by `ord`, from last to first, stacks of one `ord` by their text.

    Stacks are sorted over all tasks by ranges; sums and counts run inside a range, and those of the ranges before are added, of
    which each collection has as many as there are tasks.  A stack opens the frames in which it differs from the one before it, and
    closes that one's: at each depth the k-th block runs from the k-th opening to the k-th closing."""
    text = F.array_join("parts", ";")
    sorted_ = d.select(CID, F.concat(F.array(F.lit("")), "parts").alias("full"), "width", "change", F.col("ord").alias("_ord"), text.alias("_text")).orderBy(CID, F.desc("_ord"), F.desc("_text"))
    d = checkpointed(sorted_.select(CID, "full", "width", "change", F.monotonically_increasing_id().alias("at")))
    d = d.withColumn("part", F.shiftright("at", 33))
    inside, parts = Window.partitionBy(CID, "part").orderBy("at"), Window.partitionBy(CID).orderBy("part")
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    ranges = d.groupBy(CID, "part").agg(F.sum("width").alias("held"), F.max_by("full", "at").alias("last"), F.max("at").alias("top"))
    ranges = ranges.select(CID, "part", "top", "last", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"), F.lag("last").over(parts).alias("earlier"), F.sum("held").over(Window.partitionBy(CID)).alias("whole"), F.lead("part").over(parts).isNull().alias("final"))
    d = d.join(ranges.select(CID, "part", "base", "earlier"), [CID, "part"])
    d = d.withColumn("x1", F.col("base") + F.sum("width").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.select(CID, "part", "at", "full", "change", (F.col("x1") - F.col("width")).alias("x0"), F.coalesce(F.lag("full").over(inside), "earlier").alias("previous"))
    # How many frames of both are the same from the root on, the root being one.
    alike = F.zip_with("full", "previous", lambda a, b: F.coalesce(a == b, F.lit(False)))
    first = F.array_position(alike, False)
    same = F.when(F.col("previous").isNull(), 0).when(first == 0, F.size("full")).otherwise(first - 1).cast("int")
    d = d.select(CID, "part", "at", "x0", "change", "full", F.size("full").alias("size"), same.alias("same"), F.coalesce(F.size("previous"), F.lit(0)).alias("size_before"))
    leaf = F.col("size") - 1
    opened = d.withColumn("depth", F.explode(F.sequence(F.least("same", leaf), leaf)))
    opened = opened.select(CID, "part", "at", "depth", "x0", (F.col("depth") >= F.col("same")).alias("opens"), F.get("full", F.col("depth")).alias("name"), F.when(F.col("depth") == leaf, F.col("change")).alias("change"))
    closed = d.filter(F.col("same") < F.col("size_before")).select(CID, "part", "at", "x0", F.explode(F.sequence(F.col("same"), F.col("size_before") - 1)).alias("depth"))
    ends = ranges.filter("final").select(CID, "part", (F.col("top") + 1).alias("at"), F.col("whole").alias("x0"), F.explode(F.sequence(F.lit(0), F.size("last") - 1)).alias("depth"))
    starts = numbered(opened)
    stops = numbered(closed.unionByName(ends).withColumn("opens", F.lit(True))).select(CID, "depth", "k", F.lit(None).cast("string").alias("name"), F.lit(None).cast("bigint").alias("x0"), F.col("x0").alias("x1"), F.lit(None).cast("bigint").alias("change"))
    both = starts.select(CID, "depth", "k", F.when(F.col("opens"), F.col("name")).alias("name"), F.when(F.col("opens"), F.col("x0")).alias("x0"), F.lit(None).cast("bigint").alias("x1"), "change").unionByName(stops)
    return both.groupBy(CID, "depth", "k").agg(F.max("name").alias("name"), F.min("x0").alias("x_start"), F.max("x1").alias("x_end"), F.sum("change").alias("delta"))


def numbered(events: DataFrame) -> DataFrame:
    """events (collection_id, depth, part, at, opens, ...) with k, the number of openings at their depth up to them."""
    count = F.sum(F.col("opens").cast("bigint"))
    w = Window.partitionBy(CID, "depth").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = events.groupBy(CID, "depth", "part").agg(count.alias("n")).select(CID, "depth", "part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    inside = Window.partitionBy(CID, "depth", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return events.join(base, [CID, "depth", "part"]).withColumn("k", F.col("base") + count.over(inside)).drop("base")


def largest_change(blocks: DataFrame) -> DataFrame:
    """Of each collection the largest absolute delta, 1 at least: the end of the colour scale."""
    return blocks.groupBy(CID).agg(F.greatest(F.max(F.abs("delta")), F.lit(1)).alias("max_delta"))


def prune(blocks: DataFrame, least: float, percent: bool = False, image_width: float = 1200.0) -> DataFrame:
    """Blocks of at least that width: in pixels of the image, or as a percentage of the whole."""
    total = blocks.filter(F.col("depth") == 0).groupBy(CID).agg(F.max("x_end").alias("total"))
    share = (F.col("x_end") - F.col("x_start")) / F.col("total")
    size = share * 100 if percent else share * image_width
    return blocks.join(total, CID).filter(size >= least).drop("total")
