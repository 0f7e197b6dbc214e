"""Samples with call chains to folded stacks.

Frames are cleaned one by one with column functions: the address offset goes, an unknown symbol gets its module's name, inlined
parts become frames of their own, and kernel and JIT frames can carry a mark."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.operators import CID


@dataclass(frozen=True)
class Options:
    include_pid: bool = False
    include_tid: bool = False
    event: str | None = None  # None: each collection's first event; samples without event always pass
    annotate_kernel: bool = False
    annotate_jit: bool = False
    addrs: bool = False
    srcline: bool = False
    #: DataFrame functions on the samples before the stacks are built and on (collection_id, stack, weight) rows before the sum.
    before: Callable[[DataFrame], DataFrame] | None = None
    after: Callable[[DataFrame], DataFrame] | None = None


def process_label(o: Options) -> Column:
    """comm, 'comm pid' or 'comm pid/tid'; blanks in comm become _, a missing tid is the pid."""
    comm = F.coalesce(F.regexp_replace("command", " ", "_"), F.lit("unknown"))
    pid = F.col("pid").cast("string")
    if o.include_tid:
        with_tid = F.concat(comm, F.lit(" "), pid, F.lit("/"), F.coalesce(F.col("tid").cast("string"), pid))
        return F.coalesce(with_tid, comm)
    return F.coalesce(F.concat(comm, F.lit(" "), pid), comm) if o.include_pid else comm


def clean_symbol(symbol: Column) -> Column:
    """; becomes :, quotes go, and so does all from the first bracket that opens no anonymous namespace, but in names with a
    bracket between two dots, as methods of Go types have."""
    s = F.translate(symbol, ";\"'", ":")
    anonymous = "(anonymous namespace)"
    held = F.replace(s, F.lit(anonymous), F.lit("\u0001"))
    cut = F.replace(F.substring_index(held, "(", 1), F.lit("\u0001"), F.lit(anonymous))
    opening = F.locate(".(", s)
    of_go = (opening > 0) & (F.locate(").", s, 1) > 0) & F.substring(s, opening + 2, F.length(s)).contains(").")
    return F.when(of_go, s).otherwise(cut)


def frame_texts(call: Column, o: Options) -> Column:
    """The frames that one call stands for, outermost first."""
    dso, ip = F.trim(F.coalesce(call["dso"], F.lit(""))), F.coalesce(call["addr"], F.lit(""))
    bare = F.regexp_replace(F.coalesce(call["symbol"], F.lit("")), r"\+0x[0-9A-Fa-f]+$", "")
    symbol = F.when(F.trim(bare).isin("", "?"), "[unknown]").otherwise(bare)
    if o.srcline:
        line = call["srcline"]
        symbol = F.when(line.isNotNull() & (line != ""), F.concat(symbol, F.lit(":"), line)).otherwise(symbol)
    inner = F.when(dso.isin("", "[unknown]"), "unknown").otherwise(F.element_at(F.split(dso, "/"), -1))
    place = F.when(ip != "", F.concat(F.lit(" <"), ip, F.lit(">"))).otherwise("") if o.addrs else F.lit("")
    unknown = F.concat(F.lit("["), inner, place, F.lit("]"))
    kernel = (dso.startswith("[") | dso.endswith("vmlinux")) & ~dso.contains("unknown")
    jit = dso.rlike(r"/tmp/perf-\d+\.map")

    def text(part: Column) -> Column:
        name = clean_symbol(F.when(F.trim(part) == "[unknown]", unknown).otherwise(part))
        for wanted, of, mark in ((o.annotate_kernel, kernel, "_[k]"), (o.annotate_jit, jit, "_[j]")):
            if wanted:
                name = F.when(of & ~name.endswith(mark), F.concat(name, F.lit(mark))).otherwise(name)
        return name

    parts = F.filter(F.split(symbol, "->"), lambda p: p != "")
    return F.transform(F.reverse(parts), text)


def of_event(samples: DataFrame, name: str | None) -> DataFrame:
    if name:
        return samples.filter(F.col("event").isNull() | (F.col("event") == name))
    first = samples.filter(F.col("event").isNotNull()).groupBy(CID).agg(F.min_by("event", "ord").alias("__first"))
    d = samples.join(first, CID, "left")
    return d.filter(F.col("event").isNull() | (F.col("event") == F.col("__first"))).drop("__first")


def collapse(samples: DataFrame, options: Options = Options()) -> DataFrame:
    """(collection_id, stack, weight); a sample without frames counts under its process alone, a missing value counts 1."""
    d = of_event(samples, options.event)
    if options.before:
        d = d.transform(options.before)
    frames = F.flatten(F.transform(F.reverse("calls"), lambda c: frame_texts(c, options)))
    stack = F.array_join(F.concat(F.array(process_label(options)), F.coalesce(frames, F.array().cast("array<string>"))), ";")
    rows = d.select(CID, stack.alias("stack"), F.coalesce("value", F.lit(1)).cast("bigint").alias("weight"))
    if options.after:
        rows = rows.transform(options.after)
    return rows.groupBy(CID, "stack").agg(F.sum("weight").alias("weight"))


def expand_inlined(samples: DataFrame, inlined: DataFrame, context: bool = False) -> DataFrame:
    """Calls replaced by the frames that an inline table (dso, addr, seq, func, loc) has for them, innermost first by seq; with
    context the location stands behind the name."""
    calls = samples.select("*", F.posexplode_outer("calls").alias("__pos", "__c"))
    name = F.concat("func", F.lit(":"), "loc") if context else F.col("func")
    table = inlined.groupBy(F.col("dso").alias("__dso"), F.col("addr").alias("__addr")).agg(F.sort_array(F.collect_list(F.struct("seq", name.alias("f")))).alias("__in"))
    d = calls.join(table, (F.col("__c.dso") == F.col("__dso")) & (F.col("__c.addr") == F.col("__addr")), "left")
    c = F.col("__c")
    more = F.transform("__in", lambda x: F.struct(c["addr"].alias("addr"), x["f"].alias("symbol"), c["dso"].alias("dso")))
    one = F.array(F.struct(c["addr"].alias("addr"), c["symbol"].alias("symbol"), c["dso"].alias("dso")))
    d = d.withColumn("__f", F.when(F.col("__in").isNotNull(), more).when(c.isNotNull(), one))
    keep = [x for x in samples.columns if x != "calls"]
    out = d.groupBy(CID, "ord").agg(*[F.any_value(x).alias(x) for x in keep if x not in (CID, "ord")], F.sort_array(F.collect_list(F.struct("__pos", "__f"))).alias("__all"))
    return out.withColumn("calls", F.flatten(F.transform(F.filter("__all", lambda x: x["__f"].isNotNull()), lambda x: x["__f"]))).drop("__all")


def collapse_summary(samples: DataFrame, options: Options = Options(), limit: int = 0) -> dict[str, DataFrame]:
    """The folded lines by text (the first `limit` of each collection, 0 for all) with how many there are, their weight and whether
    more were there.

    Without a limit the lines are sorted over all tasks by ranges of (collection, text); a rank is given only under a limit, where
    each task keeps so many rows of a collection before they come together."""
    if limit < 0:
        raise ValueError("limit is negative")
    from pyspark.sql import Window

    stacks = collapse(samples, options)
    total = stacks.groupBy(CID).agg(F.count("*").alias("stacks"), F.sum("weight").alias("total"), (F.lit(limit > 0) & (F.count("*") > limit)).alias("truncated"))
    lines = stacks
    if limit:
        lines = lines.withColumn("rank", F.row_number().over(Window.partitionBy(CID).orderBy("stack"))).filter(F.col("rank") <= limit).drop("rank")
    lines = lines.select(CID, "stack", "weight", F.concat_ws(" ", "stack", F.col("weight").cast("string")).alias("line")).orderBy(CID, "stack")
    return {"lines": lines, "total": total}
