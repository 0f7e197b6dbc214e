"""Call graphs from samples with call chains: address nodes, functions, edges, and their source lines.

`calls` is an array of (addr, symbol, dso), leaf first; the caller of calls[i] is calls[i + 1]."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.text import after_last_plus, before_last_plus, hex_number
from tracelake.operators import CID


def split_symbol(symbol: Column) -> tuple[Column, Column]:
    """Function name and offset (base 16) of 'name+0x12'."""
    return before_last_plus(symbol), hex_number(after_last_plus(symbol))


def sightings(samples: DataFrame) -> DataFrame:
    """A row for each call, with the header of its sample; pos 0 is the leaf."""
    return samples.select(CID, "ord", "command", "pid", "cpu", "event", "value", F.posexplode("calls").alias("pos", "c")).select(
        "*", F.col("c.addr").alias("addr"), F.col("c.symbol").alias("symbol"), F.col("c.dso").alias("dso")
    )


def address_nodes(samples: DataFrame, pids: Sequence[int] | None = None, cpus: Sequence[int] | None = None) -> DataFrame:
    """(collection_id, addr, symbol, function, offset, dso, command, cycles, instructions, events).

    Costs are those of the leaf; names are those of the first sighting, whose command is NULL if it was as a caller."""
    if pids is not None:
        samples = samples.filter(F.col("pid").isin(*pids))
    if cpus is not None:
        samples = samples.filter(F.col("cpu").isin(*cpus))
    # Counted first by all that a node keeps, in hash tables: the least of a structure would sort every call of a task.
    leaf = F.col("pos") == 0
    kept = [CID, "addr", "event", "pos", "symbol", "dso", "command"]
    d = sightings(samples).withColumn("command", F.when(leaf, F.col("command"))).groupBy(*kept).agg(F.min("ord").alias("ord"), F.sum(F.when(leaf, F.col("value"))).alias("v"))
    d = d.groupBy(CID, "addr", "event").agg(F.min(F.struct("ord", "pos", "symbol", "dso", "command")).alias("f"), F.sum("v").alias("v"), F.max(leaf).alias("leaf"))
    total = lambda e: F.coalesce(F.sum(F.when(F.col("event") == e, F.col("v"))), F.lit(0)).alias(e)
    other = F.when(F.col("leaf") & ~F.col("event").isin("cycles", "instructions"), F.struct("event", "v"))
    d = d.groupBy(CID, "addr").agg(F.min("f").alias("f"), total("cycles"), total("instructions"), F.map_from_entries(F.sort_array(F.collect_list(other))).alias("events"))
    name, offset = split_symbol(F.col("f.symbol"))
    return d.select(
        CID, "addr", F.col("f.symbol").alias("symbol"), name.alias("function"), offset.alias("offset"), F.col("f.dso").alias("dso"), F.col("f.command").alias("command"),
        "cycles", "instructions", "events", F.col("f.ord").alias("first_ord"), F.col("f.pos").alias("first_pos"),
    )


def functions(nodes: DataFrame) -> DataFrame:
    """Address nodes summed by function and module."""
    return nodes.groupBy(CID, "function", "dso").agg(
        F.sum("cycles").alias("cycles"), F.sum("instructions").alias("instructions"), F.count("*").alias("addresses"), F.min(F.struct("first_ord", "first_pos")).alias("first")
    )


def event_values(nodes: DataFrame, event: str) -> DataFrame:
    """A function's sum of one of the further events."""
    return nodes.groupBy(CID, "function", "dso").agg(F.coalesce(F.sum(F.element_at("events", event)), F.lit(0)).alias("value"))


def known(symbol: Column) -> Column:
    return symbol.isNotNull() & ~symbol.isin("", "[unknown]")


def caller_pairs(samples: DataFrame, skip_unknown: bool = False) -> DataFrame:
    """(collection_id, caller, callee) structs of adjacent calls, as often as they occur.

    skip_unknown: the callee is the nearest earlier call with a known symbol; an unknown caller, or none before, gives no pair."""
    n = F.size("calls")
    seq = F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))

    def pair(i: Column) -> Column:
        inner = F.filter(F.slice("calls", F.lit(1), i - 1), lambda c: known(c["symbol"])) if skip_unknown else F.slice("calls", F.lit(1), i - 1)
        return F.struct(F.element_at("calls", i).alias("caller"), F.try_element_at(inner, F.lit(-1)).alias("callee"))

    d = samples.select(CID, F.explode(F.transform(seq, pair)).alias("p")).select(CID, "p.caller", "p.callee")
    return d.filter(F.col("callee").isNotNull() & known(F.col("caller.symbol"))) if skip_unknown else d


def address_edges(samples: DataFrame, skip_unknown: bool = False) -> DataFrame:
    """Caller address -> callee address, each once, with weight 1."""
    d = caller_pairs(samples, skip_unknown)
    return d.select(CID, F.col("caller.addr").alias("src"), F.col("callee.addr").alias("dst")).distinct().withColumn("weight", F.lit(1))


def function_edges(samples: DataFrame, skip_unknown: bool = False) -> DataFrame:
    """Caller function -> callee function ('name module'), with how often it occurs; a function may call itself.

    An address has the names of its first sighting."""
    pairs = caller_pairs(samples, skip_unknown).groupBy(CID, F.col("caller.addr").alias("a"), F.col("callee.addr").alias("b")).count()
    label = address_nodes(samples).select(CID, "addr", F.concat_ws(" ", "function", "dso").alias("f"))
    d = pairs.join(label.withColumnsRenamed({"addr": "a", "f": "src"}), [CID, "a"]).join(label.withColumnsRenamed({"addr": "b", "f": "dst"}), [CID, "b"])
    return d.groupBy(CID, "src", "dst").agg(F.sum("count").alias("weight"))


def module_groups(samples: DataFrame) -> DataFrame:
    """(collection_id, cluster, dso, functions): the functions that occur in an edge by module; clusters count modules by first
    sighting."""
    edges = function_edges(samples)
    used = edges.select(CID, F.col("src").alias("f")).union(edges.select(CID, "dst")).distinct()
    f = functions(address_nodes(samples)).withColumn("f", F.concat_ws(" ", "function", "dso")).join(used, [CID, "f"], "left_semi")
    d = f.groupBy(CID, "dso").agg(F.min("first").alias("first"), F.sort_array(F.collect_set("function")).alias("functions"))
    w = Window.partitionBy(CID).orderBy("first", "dso")
    return d.select(CID, (F.dense_rank().over(w) - 1).alias("cluster"), "dso", "functions")


def union_by_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All keys; the right side's row where both have one."""
    return right.unionByName(left.join(right, list(keys), "left_anti"))


def intersect_by_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "left_semi")


def subtract_by_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "left_anti")


def symmetric_by_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return subtract_by_key(left, right, keys).unionByName(subtract_by_key(right, left, keys))


def line_ranges(lines: DataFrame) -> DataFrame:
    """(module, low, high, file, line) from a line table (module, addr_start, file, line[, end_sequence]): a row holds up to the
    next one's address; empty ranges and the ends of sequences give none."""
    w = Window.partitionBy("module").orderBy("addr_start", "line")
    d = lines.withColumn("high", F.lead("addr_start").over(w))
    if "end_sequence" in lines.columns:
        d = d.filter(~F.coalesce("end_sequence", F.lit(False)))
    return d.filter(F.col("addr_start") < F.col("high")).withColumnRenamed("addr_start", "low")


def cell_level(low: Column, high: Column) -> Column:
    """The least even level whose cells of 2 ** level addresses are as wide as [low, high), so that it touches two at most."""
    last = F.try_subtract(high - 1, low)  # NULL where it is beyond 63 bits
    bits = F.when(last == 0, 0).otherwise(F.coalesce(F.length(F.bin(last)), F.lit(63)))
    return F.least(bits + bits % 2, F.lit(63))


def cell(addr: Column, level: Column) -> Column:
    return F.call_function("shiftright", addr, level)


def resolve_lines(addresses: DataFrame, ranges: DataFrame) -> DataFrame:
    """addresses (module, addr) with file and line of the first range that holds each; those without one are left out.

    A dyadic index: a range stands in at most two cells of the level that fits its width, however wide it is, and an address looks
    into one cell of each level that its module has (33 at most), so that the join has equal keys and no side grows with widths."""
    wide = ranges.select("module", F.col("low").cast("bigint").alias("low"), F.col("high").cast("bigint").alias("high"), "file", "line").filter("low < high")
    wide = wide.withColumn("level", cell_level(F.col("low"), F.col("high")))
    right = wide.withColumn("cell", F.explode(F.array_distinct(F.array(cell(F.col("low"), F.col("level")), cell(F.col("high") - 1, F.col("level"))))))
    levels = wide.groupBy("module").agg(F.collect_set("level").alias("levels"))
    left = addresses.join(levels, "module").select(*addresses.columns, F.explode("levels").alias("level"))
    left = left.withColumn("cell", cell(F.col("addr").cast("bigint"), F.col("level")))
    hit = left.join(right, ["module", "level", "cell"]).filter((F.col("low") <= F.col("addr")) & (F.col("addr") < F.col("high")))
    best = hit.groupBy(*addresses.columns).agg(F.min(F.struct("low", "high", "file", "line")).alias("r"))
    return best.select(*addresses.columns, F.col("r.file").alias("file"), F.col("r.line").alias("line"))


def function_ranges(names: DataFrame, symbols: DataFrame, text_low: int, text_high: int) -> DataFrame:
    """names (module, function) with start and end from a symbol table (module, function, addr, size), inside the text section."""
    d = names.join(symbols, ["module", "function"])
    d = d.select(*names.columns, F.col("addr").alias("start"), (F.col("addr") + F.col("size")).alias("end"))
    return d.filter((F.col("start") >= text_low) & (F.col("end") <= text_high))


def instruction_rollup(instructions: DataFrame, nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """By source line of each function: instructions (module, function, func_addr, offset, text) with the costs of the address
    node at func_addr + offset; instructions without samples count 0, without line info they have file '' and line -1."""
    d = instructions.withColumn("addr", F.col("func_addr") + F.col("offset"))
    costs = nodes.select("module", F.col("address").alias("addr"), "cycles")
    d = d.join(costs, ["module", "addr"], "left").join(lines.select("module", "addr", "file", "line"), ["module", "addr"], "left")
    d = d.withColumn("file", F.coalesce("file", F.lit(""))).withColumn("line", F.coalesce("line", F.lit(-1)))
    return d.groupBy("module", "function", "file", "line").agg(
        F.sum(F.coalesce("cycles", F.lit(0))).alias("cycles"), F.count("*").alias("instructions"), F.sort_array(F.collect_list("addr")).alias("addresses")
    )


def attach_source(rollup: DataFrame, source: DataFrame, root: str | None = None) -> DataFrame:
    """rollup's lines with their text from (file, line, text) and the span of lines of their function in that file."""
    d = rollup.filter(F.col("line") > 0)
    if root:
        d = d.withColumn("file", F.when(F.col("file").startswith("/"), F.col("file")).otherwise(F.concat_ws("/", F.lit(root), "file")))
    span = d.groupBy("module", "function", "file").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"))
    return d.join(span, ["module", "function", "file"]).join(source, ["file", "line"], "left")


def build_id_paths(modules: DataFrame, build_ids: DataFrame, root: str) -> DataFrame:
    """modules (module, ...) with the path of their ELF file in a build-id cache."""
    d = modules.join(build_ids.select("module", "build_id"), "module", "left")
    return d.withColumn("path", F.when(F.col("build_id").isNotNull(), F.concat_ws("/", F.lit(root), F.trim("module", F.lit("/")), "build_id", F.lit("elf"))))
