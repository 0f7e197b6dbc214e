"""Registered queries of the library's own operators over the derived views, each with the SQL that says the same.

A query is added by `add(name, function of the views, SQL)`; results are rounded alike on both sides where sums of fractions may
differ in their last digits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import CID
from tracelake.operators import callgraph as J
from tracelake.operators import collapse as FC
from tracelake.operators import counters as C
from tracelake.operators import layout as I
from tracelake.operators import rules as L
from tracelake.operators import samples as E
from tracelake.operators import stacks as G
from tracelake.operators import system as K
from tracelake.operators import trace as M
from tracelake.operators import tree as H
from tracelake.functions import text as T
from tracelake.plans.views import view, with_views
from tracelake.sources import sinks as B
from tracelake.sources import tables as A
from tracelake.sources import text as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Views:
    """The views by attribute: v.fx_folded."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._at = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(*self._at, name)

    @property
    def chains(self) -> DataFrame:
        """Samples with calls."""
        call = lambda i: F.struct(F.col(f"addr{i}").alias("addr"), F.col(f"symbol{i}").alias("symbol"), F.col(f"dso{i}").alias("dso"))
        return self.fx_samples.withColumn("calls", F.array(call(0), call(1), call(2))).drop(*[f"{n}{i}" for n in ("addr", "symbol", "dso") for i in range(3)])

    @property
    def flat(self) -> DataFrame:
        return self.fx_samples.withColumnsRenamed({"addr0": "addr", "symbol0": "symbol", "dso0": "dso_short_name"}).drop("addr1", "addr2", "symbol1", "symbol2", "dso1", "dso2")

    @property
    def devices(self) -> DataFrame:
        part = F.struct(F.concat("name", F.lit("p1")).alias("name"), F.col("part_size").alias("size_bytes"), F.col("part_percent").alias("fs_percent"), F.concat("mount", F.lit("/1")).alias("mount"))
        d = self.fx_devices.withColumn("partitions", F.when(F.col("parted"), F.array(part)).otherwise(F.array().cast("array<struct<name:string,size_bytes:bigint,fs_percent:double,mount:string>>")))
        return d.select(CID, "name", "rotational", "size_bytes", "fs_percent", "mount", "partitions")


def add(name: str, f: Callable[[Views], DataFrame], sql: str | None = None, digits: int | None = 6) -> None:
    """digits None: the query rounds by itself."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(Views(spark, sf_dir))
        if digits is None:
            return df
        return df.select(*[(F.round(F.col(f"`{c}`").cast("double"), digits) + 0.0).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])

    QUERIES[name] = run
    if sql:
        SQL[name] = with_views(sql)


def rounded(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 as {n}" for n in names)


FRAMES = """frames as (select collection_id, stack, weight, string_split(stack, ';')[1] as proc, string_split(stack, ';')[2:] as frames from fx_folded)"""
SYMBOLS = f"""with {FRAMES}, u as (select collection_id, weight, len(frames) as n, frames, unnest(range(1, len(frames) + 1)) as pos from frames),
hot as (select collection_id, frames[pos] as symbol, cast(sum(weight) as bigint) as inclusive, cast(sum(case when pos = n then weight else 0 end) as bigint) as leaf from u group by 1, 2),
totals as (select collection_id, cast(sum(weight) as bigint) as total from fx_folded group by 1)"""

# Folded stacks ---------------------------------------------------------------------------------------------------------------
add("g1_total_weight", lambda v: G.total_weight(v.fx_folded), "select collection_id, cast(sum(weight) as bigint) as total from fx_folded group by 1")
TOP = "select collection_id, stack, weight, row_number() over (partition by collection_id order by weight desc, stack) as rank from fx_folded"
add("g2_topk_stacks", lambda v: G.topk_stacks(v.fx_folded, 10), f"select collection_id, stack, weight, cast(rank as int) as rank from ({TOP}) where rank <= 10")
add("g3_symbol_hotspots", lambda v: G.symbol_hotspots(v.fx_folded), SYMBOLS + " select * from hot")
add(
    "g4_topk_symbols", lambda v: G.topk_symbols(v.fx_folded, 5, "leaf"),
    SYMBOLS + " select * from (select *, cast(row_number() over (partition by collection_id order by leaf desc, inclusive desc, symbol) as int) as rank from hot) where rank <= 5",
)
add(
    "g5_symbol_share", lambda v: G.symbol_share(v.fx_folded, "NATION_7"),
    SYMBOLS + " select t.collection_id, round(coalesce(cast(h.inclusive as double) / t.total, 0), 6) as share from totals t left join hot h on h.collection_id = t.collection_id and h.symbol = 'NATION_7'",
)
add(
    "g6_children_hotspots", lambda v: G.children_hotspots(v.fx_folded, "NATION_7"),
    f"""with {FRAMES}, u as (select collection_id, weight, len(frames) as n, frames, unnest(range(1, len(frames))) as pos from frames)
select collection_id, frames[pos + 1] as symbol, cast(sum(weight) as bigint) as inclusive, cast(sum(case when pos + 1 = n then weight else 0 end) as bigint) as leaf
from u where frames[pos] = 'NATION_7' group by 1, 2""",
)
add(
    "g7_dso_hotspots", lambda v: G.dso_hotspots(v.fx_folded, v.tr_dsos.select(F.col("short_name").alias("symbol"), F.concat(F.lit("d"), F.col("machine_id").cast("string")).alias("dso"))),
    SYMBOLS + """ select h.collection_id, coalesce('d' || cast(d.machine_id as string), '[unknown]') as dso, cast(sum(h.inclusive) as bigint) as inclusive, cast(sum(h.leaf) as bigint) as leaf
from hot h left join tr_dsos d on d.short_name = h.symbol group by 1, 2""",
)
add(
    "g8_process_filter", lambda v: G.process_filter(v.fx_folded, prefix="B", regex="ING$").select(CID, "stack", "weight"),
    "select collection_id, stack, weight from fx_folded where starts_with(stack, 'B') and regexp_matches(string_split(stack, ';')[1], 'ING$')",
)
add(
    "g9_symbol_filter", lambda v: G.symbol_hotspots(v.fx_folded, prefixes=["NATION_1", "A"], suffixes=["MY"], excludes=["ASIA"]),
    SYMBOLS + " select * from hot where (starts_with(symbol, 'NATION_1') or starts_with(symbol, 'A') or suffix(symbol, 'MY')) and symbol <> 'ASIA'",
)
add(
    "g10_subset_by_symbol", lambda v: G.subset_by_symbol(v.fx_folded, "NATION_7").select(CID, "stack", "weight"),
    f"with {FRAMES} select collection_id, stack, weight from frames where list_contains(frames, 'NATION_7') or contains(stack, 'NATION_7')",
)
add(
    "g11_subset_by_prefix", lambda v: G.subset_by_path(v.fx_folded, ["ASIA", "NATION_7"]).select(CID, "stack", "weight"),
    f"with {FRAMES} select collection_id, stack, weight from frames where len(frames) >= 2 and frames[1] = 'ASIA' and frames[2] = 'NATION_7'",
)
add(
    "g12_subset_by_suffix", lambda v: G.subset_by_path(v.fx_folded, ["Brand#11"], suffix=True).select(CID, "stack", "weight"),
    f"with {FRAMES} select collection_id, stack, weight from frames where frames[len(frames)] = 'Brand#11'",
)
add(
    "g13_stacks_with_prefixes", lambda v: G.stacks_with_prefixes(v.fx_folded, ["NATION_1", "SM"], 200).select(CID, "stack", "weight", "rank"),
    f"select collection_id, stack, weight, cast(rank as int) as rank from ({TOP}) where rank <= 200 and len(list_filter(string_split(stack, ';')[2:], lambda f: starts_with(f, 'NATION_1') or starts_with(f, 'SM'))) > 0",
)
add(
    "g14_symbol_shares", lambda v: G.symbol_shares(v.fx_folded),
    SYMBOLS + " select h.*, round(h.inclusive * 100.0 / t.total, 6) as inclusive_pct, round(h.leaf * 100.0 / t.total, 6) as leaf_pct from hot h join totals t using (collection_id)",
)
add(
    "g15_summary_symbols", lambda v: G.summary(v.fx_folded, 8)["symbols"],
    SYMBOLS + """, r as (select *, cast(row_number() over (partition by collection_id order by inclusive desc, leaf desc, symbol) as int) as rank from hot)
select r.*, round(r.inclusive * 100.0 / t.total, 6) as inclusive_pct, round(r.leaf * 100.0 / t.total, 6) as leaf_pct from r join totals t using (collection_id) where rank <= 8""",
)
add(
    "g15_summary_stacks", lambda v: G.summary(v.fx_folded, 50, proc_prefix="B")["stacks"],
    f"""with t as (select collection_id, cast(sum(weight) as bigint) as total from fx_folded group by 1)
select r.collection_id, r.stack, r.weight, cast(r.rank as int) as rank, round(r.weight * 100.0 / t.total, 6) as weight_pct from ({TOP}) r join t using (collection_id) where rank <= 50 and starts_with(stack, 'B')""",
)
add(
    "g16_subset_summary", lambda v: G.subset_summary(v.fx_folded, "NATION_7", 5)["stacks"],
    """with s as (select * from fx_folded where contains(stack, 'NATION_7')), t as (select collection_id, cast(sum(weight) as bigint) as total from s group by 1),
r as (select *, cast(row_number() over (partition by collection_id order by weight desc, stack) as int) as rank from s)
select r.collection_id, r.stack, r.weight, r.rank, round(r.weight * 100.0 / t.total, 6) as weight_pct from r join t using (collection_id) where rank <= 5""",
)
add(
    "g17_cooccurrence", lambda v: G.cooccurrence(v.fx_folded, "AN", "IA").drop("a_pct", "b_pct", "both_pct"),
    f"""with {FRAMES}, m as (select collection_id, weight, len(list_filter(frames, lambda f: contains(f, 'AN'))) > 0 as x, len(list_filter(frames, lambda f: contains(f, 'IA'))) > 0 as y from frames)
select collection_id, cast(sum(weight) as bigint) as total, cast(sum(case when x then weight else 0 end) as bigint) as a, cast(sum(case when y then weight else 0 end) as bigint) as b,
 cast(sum(case when x and y then weight else 0 end) as bigint) as both from m group by 1""",
)
SUBSET = "sub as (select * from fx_folded where contains(stack, 'NATION_7')), subtotal as (select collection_id, cast(sum(weight) as bigint) as total from sub group by 1)"
add(
    "g16_subset_symbols", lambda v: G.subset_summary(v.fx_folded, "NATION_7", 5, once=True)["symbols"],
    f"""with {SUBSET}, f as (select collection_id, weight, string_split(stack, ';')[2:] as frames from sub where contains(stack, ';')), s as (select collection_id, weight, unnest(list_distinct(frames)) as symbol from f), leaf as (select collection_id, frames[-1] as symbol, sum(weight) as leaf from f group by 1, 2),
hot as (select s.collection_id, s.symbol, cast(sum(weight) as bigint) as inclusive, cast(coalesce(any_value(leaf), 0) as bigint) as leaf from s left join leaf l on l.collection_id = s.collection_id and l.symbol = s.symbol group by 1, 2),
r as (select *, cast(row_number() over (partition by collection_id order by inclusive desc, symbol) as int) as rank from hot)
select r.collection_id, symbol, inclusive, leaf, rank, round(inclusive * 100.0 / total, 6) as inclusive_pct, round(leaf * 100.0 / total, 6) as leaf_pct from r join subtotal using (collection_id) where rank <= 5""",
)
add("g16_subset_total", lambda v: G.subset_summary(v.fx_folded, "NATION_7", 5)["total"], f"with {SUBSET} select * from subtotal")
add(
    "g17_cooccurrence_shares", lambda v: G.cooccurrence(v.fx_folded, "AN", "IA").select(CID, "a_pct", "b_pct", "both_pct"),
    "with x as (" + SQL["g17_cooccurrence"] + ") select collection_id, " + ", ".join(f'round_even("{n}" * 100.0 / total, 2) as {n}_pct' for n in ("a", "b", "both")) + " from x",
)
add(
    "g18_process_among_top", lambda v: G.process_stacks_among_top(v.fx_folded, "BUILDING", 100).select(CID, "stack", "weight", "rank"),
    f"select collection_id, stack, weight, cast(rank as int) as rank from ({TOP}) where rank <= 100 and string_split(stack, ';')[1] = 'BUILDING'",
)

# Trees -----------------------------------------------------------------------------------------------------------------------
PATHS = f"with {FRAMES}, paths as (select collection_id, frames as path, cast(sum(weight) as bigint) as count from frames where len(frames) > 0 group by 1, 2)"
TREE = PATHS + """, e as (select collection_id, count, path as whole, unnest(range(1, len(path) + 1)) as d from paths),
tree as (select collection_id, whole[1:d] as path, cast(max(d) as int) as depth, cast(sum(count) as bigint) as count, cast(sum(case when d = len(whole) then count else 0 end) as bigint) as leaf_count from e group by 1, 2)"""
# Columns are made when a query runs: they need a session.
PATH = lambda: F.array_join("path", ";").alias("path")
add(
    "h1_build_tree", lambda v: H.build_tree(v.fx_folded).select(CID, PATH(), "depth", "name", "count", "leaf_count"),
    TREE + " select collection_id, array_to_string(path, ';') as path, depth, path[depth] as name, count, leaf_count from tree",
)
add("h2_leaf_paths", lambda v: H.leaf_paths(v.fx_folded).select(CID, PATH(), "count"), PATHS + " select collection_id, array_to_string(path, ';') as path, count from paths")
add(
    "h3_path_stats", lambda v: H.path_stats(v.fx_folded, 20).select(CID, PATH(), "count", "percent", "truncated", "rank"),
    PATHS + """, t as (select collection_id, sum(count) as total from paths group by 1), r as (select collection_id, array_to_string(path, ';') as path, count, cast(row_number() over (partition by collection_id order by count desc, array_to_string(path, ';')) as int) as rank from paths)
select r.collection_id, r.path, r.count, round(r.count * 100.0 / t.total, 6) as percent, true as truncated, r.rank from r join t using (collection_id) where rank <= 20""",
)
add("h4_tree_symbols", lambda v: H.tree_symbols(v.fx_folded), TREE + " select collection_id, path[depth] as symbol, cast(sum(count) as bigint) as inclusive, cast(sum(leaf_count) as bigint) as leaf from tree group by 1, 2")
for _k, _name in ((None, "any"), (0, "leaf"), (1, "one")):
    add(
        f"h5_symbol_overhead_{_name}", lambda v, k=_k: H.symbol_overhead(v.fx_folded, "NATION_7", k).select(CID, PATH(), "overhead", "percent"),
        PATHS + f""", e as (select collection_id, count, path as whole, unnest(range(1, len(path) + 1)) as d from paths), t as (select collection_id, sum(count) as total from paths group by 1),
n as (select collection_id, array_to_string(whole[1:d], ';') as path, cast(sum(case when {'true' if _k is None else f'len(whole) - d <= {_k}'} then count else 0 end) as bigint) as overhead from e where whole[d] = 'NATION_7' group by 1, 2)
select n.collection_id, n.path, n.overhead, round(n.overhead * 100.0 / t.total, 6) as percent from n join t using (collection_id)""",
    )
RANK = TREE + ", ranked as (select *, cast(row_number() over (partition by collection_id, path[1:depth - 1] order by count desc, path[depth]) as int) as rank from tree)"
add(
    "h6_sorted_tree", lambda v: H.sorted_tree(v.fx_folded, "NATION_7", k=2).select(CID, PATH(), "depth", "count", "rank", F.array_join("root", ";").alias("root")),
    RANK + """, s as (select *, unnest(range(1, depth + 1)) as lvl from ranked) select collection_id, array_to_string(path, ';') as path, depth, count, rank, array_to_string(path[1:lvl], ';') as root from s where path[lvl] = 'NATION_7' and depth - lvl <= 2""",
)
add(
    "h7_trimmed_tree", lambda v: H.sorted_tree(v.fx_folded, max_children=2).select(CID, PATH(), "depth", "count", "rank"),
    RANK + """, low as (select distinct r.collection_id, r.path from (select *, unnest(range(1, depth + 1)) as lvl from ranked) r join ranked c on c.collection_id = r.collection_id and c.path = r.path[1:r.lvl] where c.rank > 2)
select r.collection_id, array_to_string(r.path, ';') as path, depth, count, rank from ranked r where not exists (select 1 from low l where l.collection_id = r.collection_id and l.path = r.path)""",
)

# Layout: the engine's own statement of the rule, over the heaviest stacks of each collection's process ------------------------
LAY = """with parts as (select collection_id, string_split(stack, ';') as parts, weight, stack from fx_folded),
o as (select *, row_number() over w as n, sum(weight) over (w rows unbounded preceding) as x1 from parts window w as (partition by collection_id order by {order})),
e as (select collection_id, n, x1 - weight as x0, x1, unnest(range(0, len(parts) + 1)) as depth, list_concat([''], parts) as whole from o),
p as (select collection_id, n, x0, x1, depth, whole[1:depth + 1] as prefix from e),
m as (select *, case when lag(n) over w = n - 1 and lag(prefix) over w = prefix then 0 else 1 end as new from p window w as (partition by collection_id, depth order by n)),
i as (select *, sum(new) over (partition by collection_id, depth order by n rows unbounded preceding) as island from m)
select collection_id, min(prefix)[depth + 1] as name, cast(depth as int) as depth, cast(min(x0) as bigint) as x_start, cast(max(x1) as bigint) as x_end from i group by collection_id, depth, island"""
add("i1_layout", lambda v: I.layout(v.fx_folded), LAY.format(order="stack"))
add("i2_layout_reversed", lambda v: I.layout(v.fx_folded, reverse=True), LAY.format(order="array_to_string(list_reverse(string_split(stack, ';')), ';')").replace("string_split(stack, ';') as parts", "list_reverse(string_split(stack, ';')) as parts"))
add(
    "i3_flamechart", lambda v: I.layout(v.fx_folded.withColumn("ord", F.struct("weight", "stack")), flamechart=True), LAY.format(order="weight desc, stack desc"),
)
add(
    "i4_differential", lambda v: I.largest_change(I.layout(v.fx_folded.withColumn("w2", F.col("weight") * 2 - F.length("stack")), second="w2")),
    "select collection_id, cast(max(abs(weight - length(stack))) as bigint) as max_delta from fx_folded group by 1",
)
add("i5_pruned", lambda v: I.prune(I.layout(v.fx_folded), 1.0, percent=True), f"select l.* from ({LAY.format(order='stack')}) l join (select collection_id, sum(weight) as total from fx_folded group by 1) t using (collection_id) where (x_end - x_start) * 100.0 / total >= 1.0".replace("select l.* from (with", "select l.* from (with"))

# Counters --------------------------------------------------------------------------------------------------------------------
NORM = "norm as (select collection_id, timestamp, cpu_id, metric_type, arg_min(value, ord) as value from fx_counters where value is not null group by 1, 2, 3, 4)"
CPI = f"""with {NORM}, c as (select * from norm where starts_with(metric_type, 'cycles')), i as (select * from norm where starts_with(metric_type, 'instructions')),
cpi as (select c.collection_id, c.timestamp, c.cpu_id, c.value as cycles, i.value as instructions, case when i.value = 0 then null else cast(c.value as double) / i.value end as CPI
 from c join i on i.collection_id = c.collection_id and i.timestamp = c.timestamp and i.cpu_id = c.cpu_id)"""


def norm(v: Views) -> DataFrame:
    return C.normalise(v.fx_counters)


def sums(keys: str, where: str = "true") -> str:
    return f"""with {NORM}, s as (select collection_id{keys}, cast(coalesce(sum(case when starts_with(metric_type, 'cycles') then value end), 0) as bigint) as cycles,
 cast(coalesce(sum(case when starts_with(metric_type, 'instructions') then value end), 0) as bigint) as instructions from norm where {where} group by collection_id{keys})"""


RATIO = "case when instructions = 0 then null else round(cast(cycles as double) / instructions, 6) end as CPI"
add("c1_normalise", norm, f"with {NORM} select * from norm")
add("c2_cpi", lambda v: C.cpi(norm(v)), CPI + " select collection_id, timestamp, cpu_id, cycles, instructions, round(CPI, 6) as CPI from cpi")
add("c3_cpi_time", lambda v: C.cpi_time(norm(v)), CPI + " select collection_id, timestamp, round(avg(CPI), 6) as CPI from cpi group by 1, 2")
add("c4_cpi_time_threads", lambda v: C.cpi_time(norm(v), [0, 3]), CPI + " select collection_id, timestamp, cpu_id, cycles, instructions, round(CPI, 6) as CPI from cpi where cpu_id in (0, 3)")
add("c5_cpi_by_thread", lambda v: C.cpi_overall(norm(v)), sums(", cpu_id") + f" select collection_id, cpu_id, cycles, instructions, {RATIO} from s")
add("c6_cpi_system", lambda v: C.cpi_overall(norm(v), "system"), sums("") + f" select collection_id, cycles, instructions, {RATIO} from s")
add("c7_cpi_of_threads", lambda v: C.cpi_by_threads(norm(v), [1, 2]), sums("", "cpu_id in (1, 2)") + f" select collection_id, cycles, instructions, {RATIO} from s")
add("c8_cpi_average_of_threads", lambda v: C.cpi_average_by_threads(norm(v), [1, 2, 5]), sums(", cpu_id", "cpu_id in (1, 2, 5)") + " select collection_id, round(avg(case when instructions = 0 then null else cast(cycles as double) / instructions end), 6) as CPI from s group by 1")
add("c9_events_overall", lambda v: C.events_overall(norm(v), "ref-cycles"), f"with {NORM} select collection_id, cpu_id, cast(coalesce(sum(case when starts_with(metric_type, 'ref-cycles') then value end), 0) as bigint) as value from norm group by 1, 2")
add("c10_event_of_threads", lambda v: C.event_by_threads(norm(v), "cycles", [0, 7]), sums("", "cpu_id in (0, 7)") + " select collection_id, cycles as value from s")
add("c11_path_length", lambda v: C.path_length(norm(v), 1000.0), sums("") + " select collection_id, round(instructions / 1000.0, 6) as path_length from s")
add("c12_per_second", lambda v: C.per_second(norm(v), "cycles"), sums("") + " select collection_id, round(cycles / 120.0, 6) as per_second from s")
add("c13_time_range", lambda v: C.time_range(norm(v)), f"with {NORM} select collection_id, min(timestamp) as start, max(timestamp) as \"end\", max(timestamp) - min(timestamp) as total from norm group by 1")
add("c14_time_delta", lambda v: C.time_delta(norm(v)), f"with {NORM} select collection_id, round((max(timestamp) - min(timestamp)) / (count(distinct timestamp) - 1), 6) as delta from norm group by 1")
add("c15_multiplexing", lambda v: C.is_multiplexing(v.fx_counters), "select collection_id, coalesce(bool_or(run_pct <> 100), false) as multiplexing from fx_counters group by 1")
EVENTS = ["cycles:D", "instructions:D", "branch-misses:D"]
WIDE = "with w as (select collection_id, timestamp, cpu_id, " + ", ".join(f"arg_min(value, ord) filter (where metric_type = '{e}') as \"{e}\"" for e in EVENTS) + " from fx_counters group by 1, 2, 3)"
add("c16_wide", lambda v: C.wide(v.fx_counters, EVENTS), WIDE + " select * from w")
add(
    "c17_tidy", lambda v: C.tidy(v.fx_counters, EVENTS[:2], [0, 1]),
    WIDE + " select collection_id, timestamp, " + ", ".join(f'avg("{e}") filter (where cpu_id = {t}) as "{e}_{t}"' for e in EVENTS[:2] for t in (0, 1)) + " from w where cpu_id in (0, 1) group by 1, 2",
)
add("c18_available_events", lambda v: C.available_events(v.fx_counters), "select distinct collection_id, metric_type from fx_counters")
add(
    "c19_combined_wide",
    lambda v: C.combined_wide(
        v.fx_counters.select(CID, "timestamp", F.when(F.col("cpu_id") > 0, F.concat(F.lit("CPU"), F.col("cpu_id").cast("string"))).otherwise("").alias("cpu"), F.col("metric_type").alias("event_name"), F.col("value").cast("double").alias("value")),
        v.fx_counters.select(CID, "timestamp", F.lit(None).cast("string").alias("cpu"), F.lit("CPI").alias("metric_name"), F.col("run_pct").cast("double").alias("value")),
        ["cycles:D", "CPI (%)"],
    ),
    """with u as (select collection_id, timestamp, case when cpu_id > 0 then concat('CPU', cast(cpu_id as string)) else 'all' end as cpu, metric_type as name, cast(value as double) as value from fx_counters
union all select collection_id, timestamp, 'all', 'CPI (%)', cast(run_pct as double) from fx_counters)
select collection_id, timestamp, cpu, round(avg(value) filter (where name = 'cycles:D'), 6) as "cycles:D", round(avg(value) filter (where name = 'CPI (%)'), 6) as "CPI (%)" from u group by 1, 2, 3""",
)

# Samples ---------------------------------------------------------------------------------------------------------------------
add(
    "d1_flat_wide", lambda v: E.flat_wide(v.flat, ["cpu", "command", "symbol"], digits=6),
    """select c.collection_id, c.cpu, c.command, c.symbol0 as symbol, c.value as cycles, i.value as instructions, case when i.value = 0 then null else round(cast(c.value as double) / i.value, 6) end as CPI
from fx_samples c join fx_samples i on i.collection_id = c.collection_id and i.cpu = c.cpu and i.command = c.command and i.symbol0 = c.symbol0 where c.event = 'cycles' and i.event = 'instructions'""", digits=None,
)
FULL_PLACE = " and ".join(f"i.{c} = c.{c}" for c in ("collection_id", "time", "cpu", "command", "pid", "addr0", "symbol0", "dso0"))
TWICE = "t as (select * from fx_samples where event <> 'cache-misses' union all select * replace (ord + 1 as ord, case event when 'cycles' then 'instructions' else 'cycles' end as event, value * 3 as value) from fx_samples where event <> 'cache-misses')"


def twice(v: Views) -> DataFrame:
    """Each sample with one of the other event at the same place."""
    d = v.flat.filter("event <> 'cache-misses'")
    return d.unionByName(d.withColumn("ord", F.col("ord") + 1).withColumn("value", F.col("value") * 3).withColumn("event", F.when(F.col("event") == "cycles", "instructions").otherwise("cycles")))


add(
    "d1_flat_wide_full_key", lambda v: E.flat_wide(twice(v)),
    f"""with {TWICE} select c.collection_id, c.time, c.cpu, c.command, c.pid, c.addr0 as addr, c.symbol0 as symbol, c.dso0 as dso_short_name, c.value as cycles, i.value as instructions, case when i.value = 0 then null else round(cast(c.value as double) / i.value, 6) end as CPI
from t c join t i on {FULL_PLACE} where c.event = 'cycles' and i.event = 'instructions'""",
)
add(
    "d1_flat_wide_in_order", lambda v: E.flat_wide(twice(v), ["cpu", "command", "symbol"], pair="order"),
    f"""with {TWICE}, k as (select *, row_number() over (partition by collection_id, cpu, command, symbol0, event order by ord) as k from t)
select c.collection_id, c.cpu, c.command, c.symbol0 as symbol, c.value as cycles, i.value as instructions, case when i.value = 0 then null else round(cast(c.value as double) / i.value, 6) end as CPI
from k c join k i on i.collection_id = c.collection_id and i.cpu = c.cpu and i.command = c.command and i.symbol0 = c.symbol0 and i.k = c.k where c.event = 'cycles' and i.event = 'instructions'""",
)
add(
    "d1_flat_wide_sums", lambda v: E.flat_wide(v.flat, ["cpu", "command", "symbol"], pair="sum"),
    """select *, case when instructions = 0 then null else round(cast(cycles as double) / instructions, 6) end as CPI from (select collection_id, cpu, command, symbol0 as symbol, cast(sum(value) filter (where event = 'cycles') as bigint) as cycles,
 cast(sum(value) filter (where event = 'instructions') as bigint) as instructions from fx_samples group by 1, 2, 3, 4) where cycles is not null and instructions is not null""",
)
add(
    "d2_flat_tidy", lambda v: E.flat_tidy(v.flat.filter("event = 'cycles'").groupBy(CID, "command", "cpu").agg(F.sum("value").alias("cycles")), [1, 2, 3], ["cycles"], ["command"]),
    "select collection_id, command, " + ", ".join(f"cast(sum(value) filter (where cpu = {t}) as bigint) as cycles_{t}" for t in (1, 2, 3)) + " from fx_samples where event = 'cycles' and cpu in (1, 2, 3) group by 1, 2",
)
CALLS = "calls as (select *, unnest([0, 1, 2]) as pos from fx_samples), c as (select *, case pos when 0 then addr0 when 1 then addr1 else addr2 end as addr, case pos when 0 then symbol0 when 1 then symbol1 else symbol2 end as symbol, case pos when 0 then dso0 when 1 then dso1 else dso2 end as dso from calls)"
add(
    "e1_commands", lambda v: E.commands(v.chains).select(CID, "command", F.array_join(F.transform("cpus", lambda x: x.cast("string")), ",").alias("cpus"), F.array_join("dsos", ",").alias("dsos")),
    f"with {CALLS} select collection_id, command, array_to_string(list_sort(list_distinct(list(cpu))), ',') as cpus, array_to_string(list_sort(list_distinct(list(dso))), ',') as dsos from c group by 1, 2",
)
add(
    "e2_in_window", lambda v: E.in_window(v.chains, "100.002", None, "500").select(CID, "ord", "time"),
    "select collection_id, ord, time from fx_samples where cast(time as decimal(20, 9)) between 100.002 and 600.002",
)
add(
    "e2_before_end", lambda v: E.in_window(v.chains, None, "1000.5", "200").select(CID, "ord", "time"),
    "select collection_id, ord, time from fx_samples where cast(time as decimal(20, 9)) between 800.5 and 1000.5",
)
add("e3_of_commands", lambda v: E.of_commands(v.chains, "BUILDING", "MACHINERY").select(CID, "ord", "command"), "select collection_id, ord, command from fx_samples where command in ('BUILDING', 'MACHINERY')")
add("e4_of_pids", lambda v: E.of_pids(v.chains, 1, 2, 3, 5, 8).select(CID, "ord", "pid"), "select collection_id, ord, pid from fx_samples where pid in (1, 2, 3, 5, 8)")
add("e5_of_cpus", lambda v: E.of_cpus(v.chains, 2, 4).select(CID, "ord", "cpu"), "select collection_id, ord, cpu from fx_samples where cpu in (2, 4)")
add("e6_raw_rows", lambda v: E.raw_rows(v.chains).select(CID, "ord", F.array_join("calls", "|").alias("calls")), "select collection_id, ord, concat(addr0, ' ', symbol0, ' (', dso0, ')|', addr1, ' ', symbol1, ' (', dso1, ')|', addr2, ' ', symbol2, ' (', dso2, ')') as calls from fx_samples")
add("e7_flat_rows", lambda v: E.flat_rows(v.chains).select(CID, "ord", "calls"), f"with {CALLS} select collection_id, ord, concat(addr, ' ', symbol, ' (', dso, ')') as calls from c")
add("e8_leaf_rows", lambda v: E.leaf_rows(v.chains).select(CID, "ord", "addr", "symbol", "offset", "dso"), "select collection_id, ord, addr0 as addr, string_split(symbol0, '+')[1] as symbol, string_split(symbol0, '+')[2] as \"offset\", dso0 as dso from fx_samples")
add(
    "e9_metric_by_symbol", lambda v: E.metric_by_symbol(v.chains, "cycles", "instructions"),
    """with m as (select collection_id, time, string_split(symbol0, '+')[1] as symbol, cpu, event, avg(value) as v from fx_samples where event in ('cycles', 'instructions') group by 1, 2, 3, 4, 5),
s as (select collection_id, symbol, sum(v) filter (where event = 'cycles') as cycles, sum(v) filter (where event = 'instructions') as instructions from m group by 1, 2)
select collection_id, symbol, round(cycles, 6) as cycles, round(instructions, 6) as instructions, case when instructions = 0 then null else round(cycles / instructions, 6) end as cycles_ratio from s""",
)

# Collapse: a text of each sample is parsed again, then folded ------------------------------------------------------------------
UNKNOWN1 = "case when symbol1 = '[unknown]' then '[libsupp.so]' else symbol1 end"
FOLD = "select collection_id, concat_ws(';', {proc}, {f2}, {f1}, {f0}) as stack, cast(sum(value) as bigint) as weight from fx_samples where {where} group by 1, 2"
BARE0 = "string_split(symbol0, '+')[1]"
FIRST = "event = (select arg_min(s.event, s.ord) from fx_samples s where s.collection_id = fx_samples.collection_id)"
add("f1_collapse", lambda v: FC.collapse(v.chains, FC.Options(event="cycles")), FOLD.format(proc="command", f2="symbol2", f1=UNKNOWN1, f0=BARE0, where="event = 'cycles'"))
add("f2_first_event", lambda v: FC.collapse(v.chains), FOLD.format(proc="command", f2="symbol2", f1=UNKNOWN1, f0=BARE0, where=FIRST))
add("f3_with_pid", lambda v: FC.collapse(v.chains, FC.Options(event="cycles", include_pid=True)), FOLD.format(proc="concat(command, ' ', cast(pid as string))", f2="symbol2", f1=UNKNOWN1, f0=BARE0, where="event = 'cycles'"))
add(
    "f3_tid_from_text", lambda v: FC.collapse(X.chain_samples(lines(v.fx_samples, F.concat_ws("\n", TID_HEADER(), block_text(0), block_text(1), block_text(2)))), FC.Options(event="cycles", include_tid=True)),
    FOLD.replace("sum(value)", "count(*)").format(proc="concat(command, ' ', cast(pid as string), '/', cast(pid + 1 as string))", f2="symbol2", f1=UNKNOWN1, f0=BARE0, where="event = 'cycles'"),
)
add("f3_with_tid", lambda v: FC.collapse(v.chains.withColumn("tid", F.col("pid") + 1), FC.Options(event="cycles", include_tid=True)), FOLD.format(proc="concat(command, ' ', cast(pid as string), '/', cast(pid + 1 as string))", f2="symbol2", f1=UNKNOWN1, f0=BARE0, where="event = 'cycles'"))
add(
    "f5_kernel_marks", lambda v: FC.collapse(v.chains.withColumn("calls", F.transform("calls", lambda c: F.struct(c["addr"].alias("addr"), c["symbol"].alias("symbol"), F.when(c["dso"] == "libcust.so", "[kernel.kallsyms]").when(c["dso"] == "libsupp.so", "/tmp/perf-12.map").otherwise(c["dso"]).alias("dso")))), FC.Options(event="cycles", annotate_kernel=True, annotate_jit=True)),
    FOLD.format(proc="command", f2="concat(symbol2, '_[k]')", f1="concat(case when symbol1 = '[unknown]' then '[perf-12.map]' else symbol1 end, '_[j]')", f0=BARE0, where="event = 'cycles'"),
)
add("f6_addresses", lambda v: FC.collapse(v.chains, FC.Options(event="cycles", addrs=True)), FOLD.format(proc="command", f2="symbol2", f1="case when symbol1 = '[unknown]' then concat('[libsupp.so <', addr1, '>]') else symbol1 end", f0=BARE0, where="event = 'cycles'"))
CHANGED = lambda: F.transform("calls", lambda c: F.struct(c["addr"].alias("addr"), F.when(c["dso"] == "libcust.so", F.concat(F.lit("a;'b'("), c["symbol"], F.lit(")"))).otherwise(c["symbol"]).alias("symbol"), c["dso"].alias("dso")))
add("f7_clean_symbols", lambda v: FC.collapse(v.chains.withColumn("calls", CHANGED()), FC.Options(event="cycles")), FOLD.format(proc="command", f2="'a:b'", f1=UNKNOWN1, f0=BARE0, where="event = 'cycles'"))
SPLIT = lambda: F.transform("calls", lambda c: F.struct(c["addr"].alias("addr"), F.when(c["dso"] == "libcust.so", F.concat(c["symbol"], F.lit("->in"))).otherwise(c["symbol"]).alias("symbol"), c["dso"].alias("dso")))
add("f8_inline_chain", lambda v: FC.collapse(v.chains.withColumn("calls", SPLIT()), FC.Options(event="cycles")), FOLD.format(proc="command", f2="'in', symbol2", f1=UNKNOWN1, f0=BARE0, where="event = 'cycles'"))
LINED = lambda: F.transform("calls", lambda c: F.struct(c["addr"].alias("addr"), c["symbol"].alias("symbol"), c["dso"].alias("dso"), F.when(c["dso"] == "libcust.so", F.lit("x.c:7")).alias("srcline")))
add("f9_source_lines", lambda v: FC.collapse(v.chains.withColumn("calls", LINED()), FC.Options(event="cycles", srcline=True)), FOLD.format(proc="command", f2="concat(symbol2, ':x.c:7')", f1=UNKNOWN1, f0=BARE0, where="event = 'cycles'"))
add(
    "f10_inline_table",
    lambda v: FC.collapse(
        FC.expand_inlined(v.chains, v.tr_dsos.select(F.lit("libcust.so").alias("dso"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("addr"), F.explode(F.array(F.lit(0), F.lit(1))).alias("seq"), "short_name", F.lit("l").alias("loc")).withColumn("func", F.concat("short_name", F.col("seq").cast("string")))),
        FC.Options(event="cycles"),
    ),
    FOLD.format(proc="command", f2="concat(symbol2, '1'), concat(symbol2, '0')", f1=UNKNOWN1, f0=BARE0, where="event = 'cycles'"),
)
add(
    "f11_collapse_summary", lambda v: FC.collapse_summary(v.chains, FC.Options(event="cycles"), 100)["total"],
    f"select collection_id, count(*) as stacks, cast(sum(weight) as bigint) as total, count(*) > 100 as truncated from ({FOLD.format(proc='command', f2='symbol2', f1=UNKNOWN1, f0=BARE0, where=chr(101) + 'vent = ' + chr(39) + 'cycles' + chr(39))}) group by 1",
)
CYCLES = FOLD.format(proc="command", f2="symbol2", f1=UNKNOWN1, f0=BARE0, where="event = 'cycles'")
add("f11_collapse_lines", lambda v: FC.collapse_summary(v.chains, FC.Options(event="cycles"))["lines"], f"select *, concat(stack, ' ', cast(weight as string)) as line from ({CYCLES})")
add(
    "f11_first_lines", lambda v: FC.collapse_summary(v.chains, FC.Options(event="cycles"), 20)["lines"].select(CID, "line"),
    f"select collection_id, concat(stack, ' ', cast(weight as string)) as line from (select *, row_number() over (partition by collection_id order by stack) as k from ({CYCLES})) where k <= 20",
)
add(
    "f12_hooks", lambda v: FC.collapse(v.chains, FC.Options(event="cycles", before=lambda d: d.filter("cpu <= 3"), after=lambda d: d.withColumn("weight", F.col("weight") * 2))),
    FOLD.format(proc="command", f2="symbol2", f1=UNKNOWN1, f0=BARE0, where="event = 'cycles' and cpu <= 3").replace("sum(value)", "sum(value * 2)"),
)

# Call graph ------------------------------------------------------------------------------------------------------------------
NODES = f"""with {CALLS}, f as (select collection_id, addr, arg_min(symbol, ord * 4 + pos) as symbol, arg_min(dso, ord * 4 + pos) as dso, min(ord * 4 + pos) as first from c group by 1, 2),
cost as (select collection_id, addr0 as addr, sum(value) filter (where event = 'cycles') as cycles, sum(value) filter (where event = 'instructions') as instructions, sum(value) filter (where event = 'cache-misses') as misses from fx_samples group by 1, 2),
nodes as (select f.collection_id, f.addr, f.symbol, string_split(f.symbol, '+')[1] as function, f.dso, cast(coalesce(cycles, 0) as bigint) as cycles, cast(coalesce(instructions, 0) as bigint) as instructions, cast(coalesce(misses, 0) as bigint) as misses, first
 from f left join cost on cost.collection_id = f.collection_id and cost.addr = f.addr)"""
add("j1_split_symbol", lambda v: v.fx_samples.select(CID, "ord", *[c.alias(n) for c, n in zip(J.split_symbol(F.col("symbol0")), ("function", "off"), strict=True)]).withColumn("off", F.col("off").cast("bigint")), "select collection_id, ord, string_split(symbol0, '+')[1] as function, cast(string_split(symbol0, '0x')[2] as bigint) as \"off\" from fx_samples")
add("j2_address_nodes", lambda v: J.address_nodes(v.chains).select(CID, "addr", "symbol", "function", "dso", "cycles", "instructions", F.coalesce(F.element_at("events", "cache-misses"), F.lit(0)).alias("misses")), NODES + " select collection_id, addr, symbol, function, dso, cycles, instructions, misses from nodes")
add("j3_functions", lambda v: J.functions(J.address_nodes(v.chains)).drop("first"), NODES + " select collection_id, function, dso, cast(sum(cycles) as bigint) as cycles, cast(sum(instructions) as bigint) as instructions, count(*) as addresses from nodes group by 1, 2, 3")
EDGES = "select distinct collection_id, src, dst, cast(1 as int) as weight from (select collection_id, addr1 as src, addr0 as dst from fx_samples union all select collection_id, addr2, addr1 from fx_samples)"
add("j4_address_edges", lambda v: J.address_edges(v.chains), EDGES)
FEDGES = NODES + """, pairs as (select collection_id, addr1 as a, addr0 as b from fx_samples union all select collection_id, addr2, addr1 from fx_samples),
edges as (select p.collection_id, concat(x.function, ' ', x.dso) as src, concat(y.function, ' ', y.dso) as dst, count(*) as weight from pairs p join nodes x on x.collection_id = p.collection_id and x.addr = p.a join nodes y on y.collection_id = p.collection_id and y.addr = p.b group by 1, 2, 3)"""
add("j5_function_edges", lambda v: J.function_edges(v.chains), FEDGES + " select * from edges")
add(
    "j6_skip_unknown", lambda v: J.address_edges(v.chains, skip_unknown=True),
    """select distinct collection_id, src, dst, cast(1 as int) as weight from (select collection_id, addr1 as src, addr0 as dst from fx_samples where symbol1 <> '[unknown]'
 union all select collection_id, addr2, case when symbol1 = '[unknown]' then addr0 else addr1 end from fx_samples)""",
)
add(
    "j7_module_groups", lambda v: J.module_groups(v.chains).select(CID, F.col("cluster").cast("int").alias("cluster"), "dso", F.array_join("functions", ",").alias("functions")),
    FEDGES + """, used as (select distinct collection_id, src as f from edges union select distinct collection_id, dst from edges), fn as (select collection_id, function, dso, min(first) as first from nodes group by 1, 2, 3),
m as (select n.collection_id, n.dso, min(n.first) as first, array_to_string(list_sort(list_distinct(list(n.function))), ',') as functions from fn n join used u on u.collection_id = n.collection_id and u.f = concat(n.function, ' ', n.dso) group by 1, 2)
select collection_id, cast(dense_rank() over (partition by collection_id order by first, dso) - 1 as int) as cluster, dso, functions from m""",
)


def two_tables(v: Views) -> tuple[DataFrame, DataFrame]:
    f = J.functions(J.address_nodes(v.chains)).select(CID, "function", "dso", "cycles")
    return f.filter("cycles % 3 <> 0"), f.filter("cycles % 2 = 0").withColumn("cycles", F.col("cycles") + 1)


TWO = NODES + ", fn as (select collection_id, function, dso, cast(sum(cycles) as bigint) as cycles from nodes group by 1, 2, 3), l as (select * from fn where cycles % 3 <> 0), r as (select collection_id, function, dso, cycles + 1 as cycles from fn where cycles % 2 = 0)"
ON = "o.collection_id = x.collection_id and o.function = x.function and o.dso = x.dso"
KEYS = [CID, "function", "dso"]
add("j8_union", lambda v: J.union_by_key(*two_tables(v), KEYS), TWO + f" select * from r union all select * from l x where not exists (select 1 from r o where {ON})")
add("j8_intersect", lambda v: J.intersect_by_key(*two_tables(v), KEYS), TWO + f" select * from l x where exists (select 1 from r o where {ON})")
add("j8_subtract", lambda v: J.subtract_by_key(*two_tables(v), KEYS), TWO + f" select * from l x where not exists (select 1 from r o where {ON})")
add("j8_symmetric", lambda v: J.symmetric_by_key(*two_tables(v), KEYS), TWO + f" select * from l x where not exists (select 1 from r o where {ON}) union all select * from r x where not exists (select 1 from l o where {ON})")
RANGES = "with r as (select module, addr_start as low, lead(addr_start) over (partition by module order by addr_start, line) as high, file, line from fx_line_table), hit as (select p.module, p.addr, r.file, r.line from fx_probe_addr p join r on r.module = p.module and p.addr >= r.low and p.addr < r.high)"
add("j9_resolve_lines", lambda v: J.resolve_lines(v.fx_probe_addr, J.line_ranges(v.fx_line_table)), RANGES + " select * from hit")
add(
    "j10_function_ranges", lambda v: J.function_ranges(v.fx_line_table.select("module", F.col("file").alias("function")).distinct(), v.fx_line_table.select("module", F.col("file").alias("function"), F.col("addr_start").alias("addr"), F.col("line").alias("size")), 1000, 15000),
    "select module, file as function, addr_start as start, addr_start + line as \"end\" from fx_line_table where addr_start >= 1000 and addr_start + line <= 15000",
)


def rollup(v: Views) -> DataFrame:
    ins = v.fx_probe_addr.select("module", F.lit("f").alias("function"), (F.col("addr") - F.col("addr") % 10).alias("func_addr"), (F.col("addr") % 10).alias("offset"), F.lit("nop").alias("text"))
    nodes = v.fx_probe_addr.filter("addr % 3 = 0").select("module", F.col("addr").alias("address"), (F.col("addr") % 97).alias("cycles"))
    return J.instruction_rollup(ins, nodes, J.resolve_lines(v.fx_probe_addr, J.line_ranges(v.fx_line_table)))


ROLL = RANGES + """, roll as (select p.module, 'f' as function, coalesce(h.file, '') as file, coalesce(h.line, -1) as line, cast(sum(case when p.addr % 3 = 0 then p.addr % 97 else 0 end) as bigint) as cycles, count(*) as instructions, array_to_string(list_sort(list(p.addr)), ',') as addresses
 from fx_probe_addr p left join hit h on h.module = p.module and h.addr = p.addr group by 1, 2, 3, 4)"""
add("j11_instruction_rollup", lambda v: rollup(v).withColumn("addresses", F.array_join(F.transform("addresses", lambda x: x.cast("string")), ",")), ROLL + " select * from roll")
add(
    "j12_attach_source", lambda v: J.attach_source(rollup(v).drop("addresses"), v.fx_line_table.select("file", "line").distinct().withColumn("text", F.concat_ws(":", "file", F.col("line").cast("string"))).withColumn("file", F.concat(F.lit("src/"), "file")), "src"),
    ROLL + """ select concat('src/', file) as file, line, module, function, cycles, instructions, min(line) over w as first_line, max(line) over w as last_line, concat_ws(':', file, cast(line as string)) as text from roll where line > 0 window w as (partition by module, function, file)""",
)
add("j13_build_id_paths", lambda v: J.build_id_paths(v.tr_dsos.select(F.col("long_name").alias("module")), v.tr_dsos.filter("id % 3 <> 0").select(F.col("long_name").alias("module"), "build_id"), "/root"), "select long_name as module, case when id % 3 <> 0 then build_id end as build_id, case when id % 3 <> 0 then concat('/root/', substr(long_name, 2), '/', build_id, '/elf') end as path from tr_dsos")

# System series ---------------------------------------------------------------------------------------------------------------
CORE = "with core as (select *, pct_user + pct_system as pct_total from fx_sar_cpu where cpu <> 'all')"
FEATS = [f"{n}_{c}" for c in K.CORE_COLUMNS for n in ("mean", "p95")]
FEATURES = CORE + ", feat as (select collection_id, cpu, " + ", ".join(f"avg({c}) as mean_{c}, quantile_cont({c}, 0.95) as p95_{c}" for c in K.CORE_COLUMNS) + " from core group by 1, 2), cls as (select *, cast(case when p95_pct_user + p95_pct_system > 15 then 1 when p95_pct_user + p95_pct_system < 10 then 99 else 0 end as int) as class from feat)"
add("k1_core_features", lambda v: K.core_features(v.fx_sar_cpu), FEATURES + f" select collection_id, cpu, {rounded(*FEATS)} from feat")
add("k2_core_classes", lambda v: K.core_classes(v.fx_sar_cpu).select(CID, "cpu", "class"), FEATURES + " select collection_id, cpu, class from cls")
add("k3_class_summary", lambda v: K.class_summary(K.core_classes(v.fx_sar_cpu)).select(CID, "class", "cores", "label"), FEATURES + " select collection_id, class, count(*) as cores, case class when 1 then 'Busy' when 0 then 'Active' else 'Idle' end as label from cls group by 1, 2")
add("k5_core_spread", lambda v: K.core_spread(v.fx_sar_cpu), CORE + ", m as (select collection_id, cpu, avg(pct_total) as m from core group by 1, 2) select collection_id, round(stddev_samp(m), 6) as cpu_util_std_dev, round(max(m), 6) as cpu_max_util, round(min(m), 6) as cpu_min_util from m group by 1")
WAIT = CORE + ", w as (select collection_id, cpu, quantile_cont(pct_iowait, 0.95) as p95, max(pct_iowait) as top from core group by 1, 2)"
add(
    "k6_iowait_pressure", lambda v: K.iowait_pressure(v.fx_sar_cpu, 5.0),
    WAIT + " select collection_id, round(max(p95), 6) as p95_single_core_iowait, round(max(top), 6) as max_single_core_iowait, arg_max(cpu, p95) as worst_core, count(*) filter (where p95 > 5) as iowait_core_count from w group by 1",
)
add(
    "k7_iowait_detail", lambda v: K.iowait_detail(v.fx_sar_cpu, 5.0),
    WAIT + """, bad as (select *, cast(cpu as int) as n from w where p95 > 5), run as (select *, n - row_number() over (partition by collection_id order by n) as run from bad),
runs as (select collection_id, run, count(*) as len, min(n) as low, max(n) as high, avg(p95) as mean from run group by 1, 2), longest as (select *, row_number() over (partition by collection_id order by len desc, low) as k from runs),
top as (select *, row_number() over (partition by collection_id order by p95 desc, n) as k from bad),
a as (select collection_id, string_agg(case when low = high then cast(low as string) else concat(cast(low as string), '-', cast(high as string)) end, ',' order by low) as ranges from runs group by 1)
select a.collection_id, a.ranges, case when l.len > 4 then printf('%d-%d (mean %.1f%%)', l.low, l.high, l.mean) end as zone, (select string_agg(printf('CPU %s=%.1f%%', cpu, p95), ', ' order by k) from top t where t.collection_id = a.collection_id and k <= 3) as top3
from a join longest l on l.collection_id = a.collection_id and l.k = 1""",
)
add(
    "k8_system_means", lambda v: K.system_means(v.fx_sar_cpu),
    "select collection_id, round(avg(pct_user) + avg(pct_system), 6) as total_cpu, round(avg(pct_iowait), 6) as avg_iowait, cast(0 as double) as avg_irq_percent, cast(0 as double) as avg_softirq_percent from fx_sar_cpu where cpu = 'all' group by 1",
)


def numa(v: Views) -> DataFrame:
    """Two nodes of four cores in every collection."""
    d = v.fx_sar_cpu.select(CID).distinct()
    return d.select(CID, F.explode(F.create_map(F.lit("node0"), F.lit("0-3"), F.lit("node1"), F.lit("4-7"))).alias("node", "cpus"))


NODE = CORE + ", n as (select collection_id, case when cast(cpu as int) < 4 then 'node0' else 'node1' end as node, avg(pct_total) as util from core group by 1, 2)"
add("k9_numa_load", lambda v: K.numa_load(v.fx_sar_cpu, numa(v)), NODE + " select collection_id, cast(2 as bigint) as numa_nodes_count, round(max(util) - min(util), 6) as numa_max_diff, string_agg(printf('%s: %.1f%%', node, util), ', ' order by node) as numa_status_msg from n group by 1")
add(
    "k10_workload_average", lambda v: K.with_workload_average(v.fx_sar_cpu).filter("cpu = 'workload_avg'"),
    "select collection_id, timestamp, 'workload_avg' as cpu, " + ", ".join(f"round(avg({c}), 6) as {c}" for c in K.CORE_COLUMNS) + " from fx_sar_cpu where cpu <> 'all' group by 1, 2",
)
add("k11_io_means", lambda v: K.io_means(v.fx_series), "select collection_id, round(sum(tps), 6) as total_tps, round(avg(await), 6) as avg_await, round(avg(pct_util), 6) as avg_util, round(avg(avgrq_sz), 6) as avg_avgrq_sz, round(avg(avgqu_sz), 6) as avg_avgqu_sz from fx_series group by 1")
DISK = """with st as (select collection_id, dev, avg(pct_util) as u, max(pct_util) as mu, quantile_cont(pct_util, 0.95) as pu, avg(await) as w, max(await) as mw, quantile_cont(await, 0.95) as pw, avg(aqu_sz) as q, max(aqu_sz) as mq, quantile_cont(aqu_sz, 0.95) as pq, avg(areq_sz) as z, avg(rkb_s) as r
 from fx_sar_disk where not regexp_matches(dev, 'loop|ram|zram') group by 1, 2), k as (select *, row_number() over (partition by collection_id order by u desc nulls last, dev) as k from st)"""
DISK_COLS = ", ".join(f"round(coalesce({a}, 0.0), 6) as {b}" for a, b in (("u", "avg_disk_util"), ("mu", "max_disk_util"), ("pu", "p95_disk_util"), ("w", "avg_disk_await"), ("mw", "max_disk_await"), ("pw", "p95_disk_await"), ("q", "avg_avgqu_sz"), ("mq", "max_avgqu_sz"), ("pq", "p95_avgqu_sz"), ("z / 2", "avg_avgrq_sz_kb"), ("r / 1024", "disk_throughput_mb")))
add("k12_busiest_disk", lambda v: K.busiest_disk(v.fx_sar_disk), DISK + f" select collection_id, dev as busiest_disk_name, {DISK_COLS} from k where k = 1")


def media(v: Views) -> DataFrame:
    """Devices of the disk series: sda and dm-0 spin."""
    return v.fx_sar_disk.select(CID, F.col("dev").alias("name")).distinct().withColumn("rotational", F.when(F.col("name").isin("sda", "dm-0"), "HDD").otherwise("SSD"))


SUB = "case when dev in ('sda', 'dm-0') then 'HDD' when contains(dev, 'nvme') then 'NVME_SSD' else 'SATA_SSD' end"
add(
    "k13_disk_media", lambda v: K.disk_media(K.busiest_disk(v.fx_sar_disk), media(v)).select(CID, "busiest_disk_name", "busiest_disk_type", "busiest_disk_subtype", "effective_await_threshold"),
    DISK + f" select collection_id, dev as busiest_disk_name, case when dev in ('sda', 'dm-0') then 'HDD' else 'SSD' end as busiest_disk_type, {SUB} as busiest_disk_subtype, case {SUB} when 'HDD' then cast(30 as double) when 'NVME_SSD' then cast(1 as double) else cast(5 as double) end as effective_await_threshold from k where k = 1",
)


def series(v: Views, **names: str) -> DataFrame:
    return v.fx_series.select(CID, "timestamp", *[F.col(c).alias(n) for n, c in names.items()])


add("k14_paging_means", lambda v: K.paging_means(series(v, pgpgin_s="tps", pgpgout_s="await", majflt_s="pct_util")), "select collection_id, round(avg(tps) + avg(await), 6) as avg_swaps, round(avg(pct_util), 6) as avg_majflt_s, cast(0 as double) as pswpin_total, cast(0 as double) as pswpout_total from fx_series group by 1")
add("k15_switch_means", lambda v: K.switch_means(series(v, cswch_s="tps", nvcswch_s="avgqu_sz")), "select collection_id, round(avg(tps), 6) as avg_cswch, round(avg(avgqu_sz), 6) as avg_nvcswch_s from fx_series group by 1")
add("k16_memory_means", lambda v: K.memory_means(series(v, pct_memused="pct_util", pct_commit="avgrq_sz")), "select collection_id, round(avg(pct_util), 6) as avg_memused_percent, round(avg(avgrq_sz), 6) as avg_commit_percent from fx_series group by 1")
add("k17_load_network_means", lambda v: K.load_means(series(v, ldavg_1="await")).join(K.network_means(series(v, pct_ifutil="pct_util")), CID), "select collection_id, round(avg(await), 6) as avg_load1, round(avg(pct_util), 6) as avg_ifutil from fx_series group by 1")
AFF = FEATURES + """, hot as (select collection_id, cpu from core group by 1, 2 having avg(pct_total) > 15), want as (select distinct f.collection_id, w.cpu from fx_sar_cpu f cross join (select unnest(['0', '1', '2', '5']) as cpu) w),
leak as (select h.* from hot h where not exists (select 1 from want w where w.collection_id = h.collection_id and w.cpu = h.cpu)), absent as (select w.* from want w where not exists (select 1 from cls c where c.collection_id = w.collection_id and c.cpu = w.cpu and c.class = 1)),
sides as (select 'l' as side, * from leak union all select 'a', * from absent), isl as (select side, collection_id, cast(cpu as int) as n, cast(cpu as int) - row_number() over (partition by side, collection_id order by cast(cpu as int)) as run from sides),
runs as (select side, collection_id, run, min(n) as low, max(n) as high from isl group by 1, 2, 3), txt as (select side, collection_id, string_agg(case when low = high then cast(low as string) else concat(cast(low as string), '-', cast(high as string)) end, ',' order by low) as t from runs group by 1, 2)"""
add(
    "k18_affinity", lambda v: K.affinity(v.fx_sar_cpu, "0-2,5"),
    AFF + """ select c.collection_id, true as affinity_check_enabled, cast((select count(*) from leak l where l.collection_id = c.collection_id) as int) as affinity_leakage_count, cast((select count(*) from absent a where a.collection_id = c.collection_id) as int) as affinity_absent_count,
 coalesce((select t from txt where side = 'l' and txt.collection_id = c.collection_id), 'None') as leakage_cores_str, coalesce((select t from txt where side = 'a' and txt.collection_id = c.collection_id), 'None') as absent_cores_str from (select distinct collection_id from cls) c""",
)
add("k19_expected_means", lambda v: K.expected_means(v.fx_sar_cpu, "0-2,5"), CORE + " select collection_id, round(avg(pct_total), 6) as total_cpu, round(avg(pct_iowait), 6) as avg_iowait from core where cpu in ('0', '1', '2', '5') group by 1")


def cpu_sets(rows: DataFrame) -> DataFrame:
    text = F.concat_ws(",", F.concat_ws("-", (F.col("addr") % 7).cast("string"), (F.col("addr") % 7 + 2).cast("string")), F.lit("x"), (F.col("addr") % 5).cast("string"))
    return rows.select("module", "addr", F.array_join(T.cpu_set(text), ",").alias("cpus"))


add("k20_cpu_sets_whole", lambda v: cpu_sets(v.fx_probe_addr))
add(
    "k20_cpu_sets", lambda v: cpu_sets(v.fx_probe_addr),
    """select module, addr, array_to_string(list_concat([cast(addr % 7 as string), cast(addr % 7 + 1 as string), cast(addr % 7 + 2 as string)], case when addr % 5 between addr % 7 and addr % 7 + 2 then [] else [cast(addr % 5 as string)] end), ',') as cpus from fx_probe_addr""",
)
SQL["k20_cpu_sets_whole"] = SQL["k20_cpu_sets"]
add(
    "k21_cpu_ranges", lambda v: v.fx_counters.filter("value > 500").groupBy(CID, "timestamp").agg(T.cpu_ranges(F.collect_set(F.col("cpu_id").cast("string"))).alias("cpus")),
    """with d as (select distinct collection_id, timestamp, cpu_id from fx_counters where value > 500), i as (select *, cpu_id - row_number() over (partition by collection_id, timestamp order by cpu_id) as run from d), r as (select collection_id, timestamp, run, min(cpu_id) as low, max(cpu_id) as high from i group by 1, 2, 3)
select collection_id, timestamp, string_agg(case when low = high then cast(low as string) else concat(cast(low as string), '-', cast(high as string)) end, ',' order by low) as cpus from r group by 1, 2""",
)


def context(v: Views) -> DataFrame:
    tables = {
        "cpu": v.fx_sar_cpu, "disk": v.fx_sar_disk, "devices": media(v), "io": v.fx_series, "topology": numa(v), "paging": series(v, pgpgin_s="tps", pgpgout_s="await"),
        "network": series(v, pct_ifutil="pct_util"), "load": series(v, ldavg_1="await"),
    }
    return K.full_context(tables, v.fx_sar_cpu.select(CID).distinct(), L.CONFIG, "0-2,5")


CTX = f"""with {FEATURES.removeprefix('with ').replace('> 15 then 1', '> 40 then 1')}, {NODE.removeprefix(CORE + ', ')}, {WAIT.removeprefix(CORE + ', ')}, {DISK.removeprefix('with ')},
x as (select c.collection_id, (select round(avg(pct_total), 6) from core t where t.collection_id = c.collection_id and cpu in ('0', '1', '2', '5')) as total_cpu,
 (select count(distinct class) from cls t where t.collection_id = c.collection_id) as cpu_clusters_count, (select max(util) - min(util) from n t where t.collection_id = c.collection_id) as numa_max_diff,
 (select max(p95) from w t where t.collection_id = c.collection_id) as wait, (select count(*) from w t where t.collection_id = c.collection_id and p95 > 10) as iowait_core_count,
 (select bool_or(class = 1) from cls t where t.collection_id = c.collection_id) as has_busy,
 (select avg(pct_util) from fx_series t where t.collection_id = c.collection_id) as avg_ifutil from (select distinct collection_id from fx_sar_cpu) c),
ctx as (select x.*, k.dev, coalesce(k.pu, 0.0) as pu, coalesce(k.pq, 0.0) as pq, coalesce(k.q, 0.0) as q, coalesce(k.pw, 0.0) as pw, coalesce(k.z / 2, 0.0) as z, {SUB} as sub from x join k on k.collection_id = x.collection_id and k.k = 1)"""
add(
    "k22_full_context", lambda v: context(v).select(CID, "num_cpu", "total_cpu", F.col("cpu_clusters_count").cast("bigint").alias("cpu_clusters_count"), "numa_max_diff", F.col("p95_single_core_iowait").alias("wait"), F.col("iowait_core_count").cast("bigint").alias("iowait_core_count"), "avg_ifutil", "busiest_disk_name", "p95_disk_util", "busiest_disk_subtype", "avg_cswch"),
    CTX + " select collection_id, 1 as num_cpu, total_cpu, cpu_clusters_count, round(numa_max_diff, 6) as numa_max_diff, round(wait, 6) as wait, iowait_core_count, round(avg_ifutil, 6) as avg_ifutil, dev as busiest_disk_name, round(pu, 6) as p95_disk_util, sub as busiest_disk_subtype, cast(0 as double) as avg_cswch from ctx",
)
WIDE_CPU = ("avg_iowait", "cpu_util_std_dev", "cpu_max_util", "cpu_min_util", "p95_single_core_iowait", "max_single_core_iowait")
WIDE_DISK = {"avg_disk_util": "u", "max_disk_util": "mu", "p95_disk_util": "pu", "avg_disk_await": "w", "max_disk_await": "mw", "p95_disk_await": "pw", "avg_avgqu_sz": "q", "max_avgqu_sz": "mq", "p95_avgqu_sz": "pq", "avg_avgrq_sz_kb": "z / 2", "disk_throughput_mb": "r / 1024"}
WIDE_COLUMNS = ["num_cpu", "total_cpu", *WIDE_CPU, "cpu_clusters_count", "is_cpu_imbalanced", "numa_nodes_count", "numa_max_diff", "numa_status_msg", "iowait_core_count", "iowait_core_details", "busiest_disk_name", "busiest_disk_type", "busiest_disk_subtype",
    "effective_await_threshold", *WIDE_DISK, "total_tps", "avg_swaps", "avg_load1", "avg_ifutil", "affinity_check_enabled", "affinity_leakage_count", "affinity_absent_count", "leakage_cores_str", "absent_cores_str", "avg_cswch", "ipc", "is_numa_imbalanced"]
WHOLE = CTX + f""", {AFF.removeprefix(FEATURES + ', ')}, detail as ({SQL['k7_iowait_detail'].replace(WAIT + ', ', 'with ').replace('p95 > 5', 'p95 > 10')}),
mean as (select collection_id, cpu, avg(pct_total) as m from core group by 1, 2), spread as (select collection_id, stddev_samp(m) as sd, max(m) as hi, min(m) as lo from mean group by 1),
top as (select collection_id, max(p95) as wait95, max(top) as wait_top from w group by 1), own as (select collection_id, avg(pct_iowait) as iowait from core where cpu in ('0', '1', '2', '5') group by 1),
numa as (select collection_id, string_agg(printf('%s: %.1f%%', node, util), ', ' order by node) as msg from n group by 1), more as (select collection_id, sum(tps) as tps, avg(tps) + avg(await) as swaps, avg(await) as load1 from fx_series group by 1),
leaks as (select c.collection_id, (select count(*) from leak l where l.collection_id = c.collection_id) as nl, (select count(*) from absent a where a.collection_id = c.collection_id) as na, coalesce((select t from txt where side = 'l' and txt.collection_id = c.collection_id), 'None') as lt,
 coalesce((select t from txt where side = 'a' and txt.collection_id = c.collection_id), 'None') as tt from (select distinct collection_id from fx_sar_cpu) c),
whole as (select ctx.*, (cpu_clusters_count > 1 and has_busy) as imbalanced, sd, hi, lo, wait95, wait_top, own.iowait, msg, tps, swaps, load1, nl, na, lt, tt, concat_ws('; ', d.ranges, d.zone, d.top3) as details, case sub when 'HDD' then 'HDD' else 'SSD' end as kind,
 case sub when 'HDD' then cast(30 as double) when 'NVME_SSD' then cast(1 as double) else cast(5 as double) end as slow from ctx join spread using (collection_id) join top using (collection_id) join own using (collection_id) join numa using (collection_id) join more using (collection_id)
 join leaks using (collection_id) left join detail d using (collection_id))"""
add(
    "k22_whole_context", lambda v: context(v).select(CID, *[F.col(c).cast("bigint").alias(c) if c in ("num_cpu", "cpu_clusters_count", "numa_nodes_count", "iowait_core_count", "affinity_leakage_count", "affinity_absent_count") else F.col(c) for c in WIDE_COLUMNS]),
    WHOLE + " select w.collection_id, 1 as num_cpu, total_cpu, round(iowait, 6) as avg_iowait, round(sd, 6) as cpu_util_std_dev, round(hi, 6) as cpu_max_util, round(lo, 6) as cpu_min_util, round(wait95, 6) as p95_single_core_iowait, round(wait_top, 6) as max_single_core_iowait, cpu_clusters_count,"
    " imbalanced as is_cpu_imbalanced, 2 as numa_nodes_count, round(numa_max_diff, 6) as numa_max_diff, msg as numa_status_msg, iowait_core_count, coalesce(nullif(details, ''), 'none') as iowait_core_details, w.dev as busiest_disk_name, kind as busiest_disk_type, sub as busiest_disk_subtype, slow as effective_await_threshold, "
    + ", ".join(f"round(coalesce(k.{x}, 0.0), 6) as {c}" for c, x in WIDE_DISK.items())
    + ", round(tps, 6) as total_tps, round(swaps, 6) as avg_swaps, round(load1, 6) as avg_load1, round(avg_ifutil, 6) as avg_ifutil, true as affinity_check_enabled, nl as affinity_leakage_count, na as affinity_absent_count, lt as leakage_cores_str, tt as absent_cores_str,"
    " cast(0 as double) as avg_cswch, cast(0 as double) as ipc, false as is_numa_imbalanced from whole w join k on k.collection_id = w.collection_id and k.k = 1",
)
DEV = "fx_devices where not starts_with(name, 'loop') and not starts_with(name, 'ram') and size_bytes > 0"
add(
    "k23_capacity_warnings", lambda v: K.capacity_warnings(v.devices),
    "select *, case when fs_percent > 90 then 'Critical' else 'Warning' end as level from (select collection_id, name, mount, fs_percent from fx_devices union all select collection_id, concat(name, 'p1'), concat(mount, '/1'), part_percent from fx_devices where parted) where fs_percent > 80",
)
add(
    "k24_storage_hierarchy", lambda v: K.storage_hierarchy(v.devices),
    f"""select collection_id, 'Total Storage' as id, '' as parent, cast(sum(size_bytes) as bigint) as size_bytes, cast(null as string) as medium from {DEV} group by 1
union all select collection_id, concat('disk_', name), 'Total Storage', size_bytes, rotational from {DEV}
union all select collection_id, case when parted then concat('part_', name, 'p1') else concat('v_part_', name) end, concat('disk_', name), case when parted then part_size else size_bytes end, rotational from {DEV}""",
)
add(
    "k25_disk_breakdown", lambda v: K.disk_breakdown(v.devices),
    f"""select collection_id, name as disk, case when parted then concat(name, '_', name, 'p1') else concat(name, '_vol') end as part, case when parted then part_size else size_bytes end as size_bytes from {DEV}
union all select collection_id, name, concat(name, '_free'), size_bytes - part_size from {DEV} and parted and (size_bytes - part_size) > 0.01 * size_bytes""",
)
add(
    "k26_byte_text", lambda v: v.tr_calls.select("id", T.byte_text(F.col("return_time") * 1000003).alias("size")),
    """select id, case when b >= 1099511627776 then printf('%.2f TB', b / 1099511627776.0) when b >= 1073741824 then printf('%.2f GB', b / 1073741824.0) when b >= 1048576 then printf('%.2f MB', b / 1048576.0) else concat(cast(b as string), ' B') end as size
from (select id, return_time * 1000003 as b from tr_calls)""",
)
add("k27_cpu_long", lambda v: K.cpu_long(v.fx_sar_cpu), "unpivot (select collection_id, timestamp, cpu, round(pct_user, 6) + 0.0 as pct_user, round(pct_system, 6) + 0.0 as pct_system, round(pct_iowait, 6) + 0.0 as pct_iowait, round(pct_idle, 6) + 0.0 as pct_idle from fx_sar_cpu) on pct_user, pct_system, pct_iowait, pct_idle into name metric value value".replace("unpivot (", "select * from (unpivot (", 1) + ")")
add(
    "k28_metric_long", lambda v: K.metric_long(v.fx_series.select(CID, "timestamp", F.col("tps").alias("rxkB/s"), F.col("await").alias("majflt/s"), F.col("pct_util").alias("%ifutil"), F.col("avgrq_sz").alias("plain"))),
    " union all ".join(f"select collection_id, timestamp, '{m}' as metric, round({c}, 6) + 0.0 as value, '{g}' as unit_group from fx_series" for m, c, g in (("rxkB/s", "tps", "throughput_kb"), ("majflt/s", "await", "rate_per_sec"), ("%ifutil", "pct_util", "percentage"), ("plain", "avgrq_sz", "absolute"))),
)
add(
    "k28_memory_long", lambda v: K.metric_long(v.fx_series.select(CID, "timestamp", F.col("tps").alias("kbmemfree"), F.col("pct_util").alias("%memused")), memory=True),
    "select collection_id, timestamp, 'memfree_gb' as metric, round(tps / 1048576, 6) + 0.0 as value, 'size_gb' as unit_group from fx_series union all select collection_id, timestamp, '%memused', round(pct_util, 6) + 0.0, 'percentage' from fx_series",
)
add(
    "k29_facets", lambda v: K.facets(v.fx_sar_cpu, "cpu").select(CID, F.array_join("vals", ",").alias("vals"), F.array_join("shown", ",").alias("shown"), "n"),
    "with d as (select distinct collection_id, cpu, coalesce(try_cast(cpu as int), -1) as k from fx_sar_cpu) select collection_id, string_agg(cpu, ',' order by k, cpu) as vals, array_to_string(list(cpu order by k, cpu)[1:3], ',') as shown, cast(count(*) as int) as n from d group by 1",
)
add(
    "k30_input_warnings", lambda v: K.input_warnings(v.fx_devices.select(CID, F.col("name").alias("file"), F.col("parted").alias("required")), v.fx_devices.filter("part_percent < 90").select(CID, F.col("name").alias("file"), F.when(F.col("part_percent") < 10, 0).otherwise(1).alias("size"))),
    "select collection_id, name as file, case when part_percent >= 90 then 'missing' else 'empty' end as warning from fx_devices where (part_percent >= 90 and parted) or part_percent < 10",
)

# Rules -----------------------------------------------------------------------------------------------------------------------
SLOW = "((sub = 'HDD' and pw > 30) or (sub = 'SATA_SSD' and pw > 5) or (sub = 'NVME_SSD' and pw > 1))"
DISK_RULE = f"((pu > 75 or pq > 80) or ({SLOW} and coalesce(wait, 0) > 10))"
SAT = f"({DISK_RULE} and pu > 75 and ({SLOW} or coalesce(wait, 0) > 10))"
IMBALANCED = "(cpu_clusters_count > 1 and has_busy)"
PATHS_SQL = {
    "diagnosis": "true", "diagnosis/OFF-CPU": "total_cpu <= 50", "diagnosis/ON-CPU": "total_cpu > 50", "diagnosis/architecture": f"({IMBALANCED} or numa_max_diff > 20)",
    "diagnosis/architecture/core imbalance": IMBALANCED, "diagnosis/architecture/node imbalance": "numa_max_diff > 20", "diagnosis/disk I/O": DISK_RULE,
    "diagnosis/disk I/O/saturation": SAT, "diagnosis/disk I/O/saturation/synchronous I/O": f"({SAT} and q < 10 and pq < 10 and wait > 10)",
    "diagnosis/disk I/O/saturation/small requests": f"({SAT} and z < 16)", "diagnosis/disk I/O/saturation/large requests": f"({SAT} and z > 64)",
    "diagnosis/disk I/O/congestion": f"({DISK_RULE} and pq > 80)", "idle system": "(total_cpu < 5 and pu < 10 and avg_ifutil < 10)",
}
add(
    "l3_active_rules", lambda v: L.evaluate(context(v)).filter(F.col("root") != "affinity audit").select(CID, "path", "active"),
    CTX + " " + " union all ".join(f"select collection_id, '{p}' as path, coalesce({c}, false) as active from ctx" for p, c in PATHS_SQL.items()),
)
add("l4_findings", lambda v: L.findings(L.evaluate(context(v)))["findings"].filter(F.col("path").isin("diagnosis/OFF-CPU", "diagnosis/ON-CPU")).select(CID, "path", "finding"), CTX + " select collection_id, case when total_cpu <= 50 then 'diagnosis/OFF-CPU' else 'diagnosis/ON-CPU' end as path, concat(case when total_cpu <= 50 then 'OFF' else 'ON' end, printf('-CPU: load %.2f%%, threshold 50%%', total_cpu)) as finding from ctx")
FINDINGS_SQL = {
    "affinity audit": ("true", "'affinity is checked'"), "affinity audit/affinity holds": ("nl = 0 and na = 0", "'the busy cores are the expected ones'"),
    "affinity audit/leakage": ("nl > 0", "concat(cast(nl as string), ' unexpected busy cores: ', lt)"), "affinity audit/absence": ("na > 0", "concat(cast(na as string), ' expected cores are not busy: ', tt)"),
    "diagnosis/OFF-CPU": (None, "printf('OFF-CPU: load %.2f%%, threshold 50%%', total_cpu)"), "diagnosis/ON-CPU": (None, "printf('ON-CPU: load %.2f%%, threshold 50%%', total_cpu)"),
    "diagnosis/architecture/core imbalance": (None, "printf('cores fall into %d classes', cpu_clusters_count)"), "diagnosis/architecture/node imbalance": (None, "concat(printf('nodes differ by %.1f%%: ', numa_max_diff), msg)"),
    "diagnosis/disk I/O": (None, "concat(printf('disk I/O limits: %s (%s), utilisation %.2f%%, queue %.2f, latency %.2f ms of ', dev, sub, pu, pq, pw), cast(slow as string), ' ms')"),
    "diagnosis/disk I/O/saturation": (None, "printf('the device is saturated at %.2f%%', pu)"), "diagnosis/disk I/O/saturation/synchronous I/O": (None, "printf('short queue %.2f, %d cores wait', q, iowait_core_count)"),
    "diagnosis/disk I/O/saturation/small requests": (None, "printf('many requests of %.1f KB', z)"), "diagnosis/disk I/O/saturation/large requests": (None, "printf('requests of %.1f KB', z)"),
    "diagnosis/disk I/O/congestion": (None, "printf('queue %.2f, threshold 80.0', pq)"), "idle system": (None, "'the system is idle'"),
}
add(
    "l4_findings_whole", lambda v: L.findings(L.evaluate(context(v)))["findings"].select(CID, "path", "finding"),
    WHOLE + " " + " union all ".join(f"select collection_id, '{p}' as path, {t} as finding from whole where coalesce({c or PATHS_SQL[p]}, false)" for p, (c, t) in FINDINGS_SQL.items()),
)
add(
    "l3_affinity_rules", lambda v: L.evaluate(context(v)).filter(F.col("root") == "affinity audit").select(CID, "path", "active"),
    WHOLE + " " + " union all ".join(f"select collection_id, '{p}' as path, {FINDINGS_SQL[p][0]} as active from whole" for p in FINDINGS_SQL if p.startswith("affinity")),
)
RULE_FILE = """
config: {LOAD_LIMIT: 5, WAIT_LIMIT: 2.5}
rules:
  - name: load
    precondition: 0 < total_cpu <= LOAD_LIMIT * 10 and numa_status_msg != None
    finding: "load {total_cpu:.1f} of {LOAD_LIMIT}"
    sub_rules:
      - {name: waiting, precondition: "not p95_single_core_iowait < WAIT_LIMIT", finding: "waiting"}
      - {name: spinning, precondition: "busiest_disk_subtype in ('HDD', 'other') or no_such_name"}
      - {name: solid, precondition: "busiest_disk_subtype not in ['HDD'] or no_such_name", finding: "solid"}
      - {name: unknown, precondition: no_such_name > 1 or True}
  - name: always
    sub_rules:
      - {name: kinds, precondition: "busiest_disk_name == 5 or iowait_core_details is None or num_cpu == True and total_cpu != 'x'"}
      - {name: broken, precondition: "total_cpu >"}
"""


def loaded_rules(v: Views) -> DataFrame:
    """Every rule of a file with its place in the tree and whether it holds."""
    rules, config = L.rules_of(RULE_FILE)
    return L.evaluate(context(v), rules, config).select(CID, F.col("rule_id").cast("int").alias("rule_id"), "path", F.col("depth").cast("int").alias("depth"), "active", F.coalesce("finding", F.lit("")).alias("finding"))


LOAD = "total_cpu > 0 and total_cpu <= 50"
LOADED_SQL = {
    "load": (0, LOAD, "printf('load %.1f of 5', total_cpu)"), "load/waiting": (1, f"{LOAD} and wait95 >= 2.5", "'waiting'"), "load/spinning": (1, f"{LOAD} and sub = 'HDD'", "''"), "load/solid": (1, f"{LOAD} and sub <> 'HDD'", "'solid'"),
    "load/unknown": (1, "false", "''"), "always": (0, "true", "''"), "always/kinds": (1, "true", "''"), "always/broken": (1, "false", "''"),
}
add(
    "l1_rules_from_text", loaded_rules,
    WHOLE + " " + " union all ".join(f"select collection_id, {i} as rule_id, '{p}' as path, {d} as depth, ({c}) as active, case when {c} then {t} else '' end as finding from whole" for i, (p, (d, c, t)) in enumerate(LOADED_SQL.items())),
)
add("l5_audit", lambda v: L.findings(L.evaluate(context(v)))["audit"].select(CID, "path", "finding"), AFF.replace("> 15 then 1", "> 40 then 1") + """, r as (select c.collection_id, (select count(*) from leak l where l.collection_id = c.collection_id) as nl, (select count(*) from absent a where a.collection_id = c.collection_id) as na, coalesce((select t from txt where side = 'l' and txt.collection_id = c.collection_id), 'None') as lt, coalesce((select t from txt where side = 'a' and txt.collection_id = c.collection_id), 'None') as tt from (select distinct collection_id from cls) c)
select collection_id, 'affinity audit' as path, 'affinity is checked' as finding from r union all select collection_id, 'affinity audit/affinity holds', 'the busy cores are the expected ones' from r where nl = 0 and na = 0
union all select collection_id, 'affinity audit/leakage', concat(cast(nl as string), ' unexpected busy cores: ', lt) from r where nl > 0 union all select collection_id, 'affinity audit/absence', concat(cast(na as string), ' expected cores are not busy: ', tt) from r where na > 0""")

# Trace tables ----------------------------------------------------------------------------------------------------------------
MV = "select id, pid, root_dir, case when id = 0 then 'unknown' when pid = -1 then 'host' else 'guest' end as host_or_guest from tr_machines"
IPC = "case when cyc_count = 0 then 0.0 else round(cast(insn_count as double) / cyc_count, 2) end as IPC"
add("m1_machines", lambda v: M.machines_view(v.tr_machines), MV)
add("m2_dsos", lambda v: M.dsos_view(v.tr_dsos, v.tr_machines), f"select d.id, machine_id, host_or_guest, short_name, long_name, build_id from tr_dsos d left join ({MV}) m on m.id = d.machine_id")
SV = "select s.id, s.name, d.short_name as dso, s.dso_id, s.sym_start, s.sym_end, case s.binding when 0 then 'local' when 1 then 'global' else 'weak' end as binding from tr_symbols s left join tr_dsos d on d.id = s.dso_id"
add("m3_symbols", lambda v: M.symbols_view(v.tr_symbols, v.tr_dsos), SV)
add("m4_threads", lambda v: M.threads_view(v.tr_threads, v.tr_machines), f"select t.id, machine_id, host_or_guest, process_id, t.pid, tid from tr_threads t left join ({MV}) m on m.id = t.machine_id")
add("m5_comm_threads", lambda v: M.comm_threads_view(v.tr_comm_threads, v.tr_comms, v.tr_threads), "select x.comm_id, c.comm as command, x.thread_id, t.pid, t.tid from tr_comm_threads x left join tr_comms c on c.id = x.comm_id left join tr_threads t on t.id = x.thread_id")
add(
    "m6_call_paths", lambda v: M.call_paths_view(v.tr_call_paths, v.tr_symbols, v.tr_dsos),
    f"""select c.id, lower(to_hex(c.ip)) as ip, c.symbol_id, s.name as symbol, s.dso_id, s.dso as dso_short_name, c.parent_id, lower(to_hex(p.ip)) as parent_ip, p.symbol_id as parent_symbol_id, q.name as parent_symbol, q.dso_id as parent_dso_id, q.dso as parent_dso_short_name
from tr_call_paths c join tr_call_paths p on p.id = c.parent_id left join ({SV}) s on s.id = c.symbol_id left join ({SV}) q on q.id = p.symbol_id""",
)
add(
    "m7_calls", lambda v: M.calls_view(v.tr_calls, v.tr_call_paths, v.tr_threads, v.tr_comms, v.tr_symbols),
    f"""select c.id, c.thread_id, t.pid, t.tid, m.comm as command, c.call_path_id, lower(to_hex(p.ip)) as ip, p.symbol_id, s.name as symbol, call_time, return_time, return_time - call_time as elapsed_time, branch_count, insn_count, cyc_count, {IPC}, call_id, return_id,
 case flags when 0 then '' when 1 then 'no call' when 2 then 'no return' when 3 then 'no call/return' when 6 then 'jump' else cast(flags as string) end as flags, parent_call_path_id, c.parent_id
from tr_calls c join tr_call_paths p on p.id = c.call_path_id left join tr_threads t on t.id = c.thread_id left join tr_comms m on m.id = c.comm_id left join tr_symbols s on s.id = p.symbol_id""",
)
add(
    "m8_samples", lambda v: M.samples_view(v.tr_samples, v.tr_threads, v.tr_comms, v.tr_selected_events, v.tr_symbols, v.tr_dsos, v.tr_branch_types),
    f"""select x.id, x.time, x.cpu, t.pid, t.tid, m.comm as command, e.name as event, lower(to_hex(x.ip)) as ip_hex, s.name as symbol, x.sym_offset, d.short_name as dso_short_name, lower(to_hex(x.to_ip)) as to_ip_hex, s2.name as to_symbol, x.to_sym_offset,
 d2.short_name as to_dso_short_name, b.name as branch_type_name, x.in_tx, x.insn_count, x.cyc_count, {IPC}, x.flags
from tr_samples x left join tr_threads t on t.id = x.thread_id left join tr_comms m on m.id = x.comm_id left join tr_selected_events e on e.id = x.evsel_id left join tr_symbols s on s.id = x.symbol_id left join tr_dsos d on d.id = x.dso_id
 left join tr_symbols s2 on s2.id = x.to_symbol_id left join tr_dsos d2 on d2.id = x.to_dso_id left join tr_branch_types b on b.id = x.branch_type""",
)
AT = "from {0} p join tr_samples s on s.id = p.id"
add("m9_ptwrite", lambda v: M.ptwrite_view(v.tr_ptwrite, v.tr_samples), f"select p.id, time, cpu, lower(to_hex(payload)) as payload_hex, case when exact_ip = 0 then 'False' else 'True' end as exact_ip {AT.format('tr_ptwrite')}")
add("m10_cbr", lambda v: M.cbr_view(v.tr_cbr, v.tr_samples), f"select p.id, time, s.cpu, cbr, mhz, percent {AT.format('tr_cbr')}")
add("m11_mwait", lambda v: M.mwait_view(v.tr_mwait, v.tr_samples), f"select p.id, time, cpu, lower(to_hex(hints)) as hints_hex, lower(to_hex(extensions)) as extensions_hex {AT.format('tr_mwait')}")
add("m12_pwre", lambda v: M.pwre_view(v.tr_pwre, v.tr_samples), f"select p.id, time, cpu, cstate, subcstate, case when hw = 0 then 'False' else 'True' end as hw {AT.format('tr_pwre')}")
add("m13_exstop", lambda v: M.exstop_view(v.tr_exstop, v.tr_samples), f"select p.id, time, cpu, case when exact_ip = 0 then 'False' else 'True' end as exact_ip {AT.format('tr_exstop')}")
WAKE = "case wake_reason when 1 then 'Interrupt' when 2 then 'Timer Deadline' when 4 then 'Monitored Address' when 8 then 'HW' else cast(wake_reason as string) end"
add("m14_pwrx", lambda v: M.pwrx_view(v.tr_pwrx, v.tr_samples), f"select p.id, time, cpu, deepest_cstate, last_cstate, {WAKE} as wake_reason {AT.format('tr_pwrx')}")
FIELD = {"cbr": ("cbr", "mhz", "percent"), "mwait": ("hints_hex", "extensions_hex"), "pwre": ("cstate", "subcstate", "hw"), "exstop": ("exact_ip",), "pwrx": ("deepest_cstate", "last_cstate", "wake_reason")}
add(
    "m15_power_events", lambda v: M.power_events_view(v.tr_samples, v.tr_selected_events, v.tr_cbr, v.tr_mwait, v.tr_pwre, v.tr_exstop, v.tr_pwrx),
    "select s.id, s.time, s.cpu, e.name as event, " + ", ".join(f"case when e.name = '{k}' then cast({WAKE if c == 'wake_reason' else f'lower(to_hex({k}.{c[:-4]}))' if c.endswith('_hex') else f'{k}.{c}'} as string) else '' end as {c}" for k, cs in FIELD.items() for c in cs)
    + " from tr_samples s join tr_selected_events e on e.id = s.evsel_id " + " ".join(f"left join tr_{k} {k} on {k}.id = s.id" for k in FIELD) + " where e.name in ('cbr', 'mwait', 'pwre', 'exstop', 'pwrx')",
)
add(
    "m16_context_switches", lambda v: M.context_switches_view(v.tr_context_switches, v.tr_threads, v.tr_comms),
    """select x.id, x.machine_id, x.time, x.cpu, a.pid as pid_out, a.tid as tid_out, c.comm as comm_out, b.pid as pid_in, b.tid as tid_in, d.comm as comm_in, case x.flags when 0 then 'in' when 1 then 'out' when 3 then 'out preempt' else cast(x.flags as string) end as flags
from tr_context_switches x join tr_threads a on a.id = x.thread_out_id join tr_threads b on b.id = x.thread_in_id join tr_comms c on c.id = x.comm_out_id join tr_comms d on d.id = x.comm_in_id""",
)


def raw_power(v: Views) -> DataFrame:
    """Raw events: four bytes of flags, then the payload, little endian."""
    hexed = F.lpad(F.hex("payload"), 16, "0")
    body = F.concat(*[F.substring(hexed, i, 2) for i in range(15, 0, -2)])
    return v.tr_raw_power.select("id", "config", F.unhex(F.concat(F.lit("01000000"), body)).alias("raw"))


add("m17_pwre_fields", lambda v: M.decode_power(raw_power(v))["pwre"], "select id, cast((payload >> 12) & 15 as int) as cstate, cast((payload >> 8) & 15 as int) as subcstate, cast((payload >> 7) & 1 as int) as hw from tr_raw_power where config = 2")
add("m17_mwait_fields", lambda v: M.decode_power(raw_power(v))["mwait"], "select id, cast(payload & 255 as int) as hints, cast((payload >> 32) & 3 as int) as extensions from tr_raw_power where config = 1")
add("m17_pwrx_fields", lambda v: M.decode_power(raw_power(v))["pwrx"], "select id, cast(payload & 15 as int) as deepest_cstate, cast((payload >> 4) & 15 as int) as last_cstate, cast((payload >> 8) & 15 as int) as wake_reason from tr_raw_power where config = 4")
add("m17_ptwrite_fields", lambda v: M.decode_power(raw_power(v))["ptwrite"], "select id, payload, 1 as exact_ip from tr_raw_power where config = 0")
add("m17_exstop_fields", lambda v: M.decode_power(raw_power(v))["exstop"], "select id, 1 as exact_ip from tr_raw_power where config = 3")
add(
    "m17_cbr_fields", lambda v: M.decode_power(v.tr_raw_power.select("id", "config", F.unhex(F.concat(F.lpad(F.hex(F.col("payload") % 60 + 1), 2, "0"), F.lit("00"), F.lit("28"), F.lit("00"), F.lit("E8030000"))).alias("raw")))["cbr"],
    "select id, cast(payload % 60 + 1 as int) as cbr, 1 as mhz, cast(((payload % 60 + 1) * 1000 // 40 + 5) // 10 as int) as percent from tr_raw_power where config = 5",
)
add("m18_with_calls", lambda v: M.with_calls_flag(v.tr_comms, v.tr_calls), "select c.*, case when x.comm_id is not null then true end as has_calls from tr_comms c left join (select distinct comm_id from tr_calls) x on x.comm_id = c.id")
add("m19_with_unknown", lambda v: M.with_unknown(v.tr_comms, comm="unknown"), "select * from tr_comms where id <> 0 union all select 0, 'unknown', null, null, null")

# Text: lines written from the views, parsed again -----------------------------------------------------------------------------


def lines(df: DataFrame, value, ord: str = "ord") -> DataFrame:
    return df.select(CID, F.col(ord).alias("ord"), value.alias("value"))


SAR_TEXT = "with x as (select collection_id, timestamp, cast(round(tps, 3) as double) as tps, cast(round(await, 3) as double) as await from fx_series)"


def sar_lines(v: Views) -> DataFrame:
    d = v.fx_series.select(CID, F.col("timestamp").alias("ord"), F.concat_ws(";", F.lit("h"), F.lit("1"), F.col("timestamp").cast("string"), F.round("tps", 3).cast("string"), F.round("await", 3).cast("string")).alias("value"))
    head = v.fx_series.select(CID).distinct().select(CID, F.explode(F.array(F.lit(-2), F.lit(100))).alias("ord"), F.lit("# hostname;interval;timestamp;tps;await").alias("value"))
    junk = v.fx_series.select(CID).distinct().select(CID, F.lit(-3).alias("ord"), F.lit("Linux").alias("value"))
    return d.unionByName(head).unionByName(junk)


add("a1_sar_scan", lambda v: A.sar_rows(sar_lines(v), ["tps", "await", "%util"]), SAR_TEXT + " select collection_id, 'h' as hostname, 1 as interval, cast(timestamp as string) as timestamp, round(tps, 6) + 0.0 as tps, round(await, 6) + 0.0 as await, cast(0 as double) as pct_util from x")
CPU_HEAD = "# hostname;interval;timestamp;CPU;%user;%system;%iowait;%idle"


def sar_cpu_lines(v: Views) -> DataFrame:
    d = v.fx_sar_cpu
    body = d.select(CID, (F.col("timestamp") * 10 + F.coalesce(F.col("cpu").try_cast("int"), F.lit(9))).alias("ord"), F.concat_ws(";", F.lit("h"), F.lit("1"), F.col("timestamp").cast("string"), F.when(F.col("cpu") == "all", "-1").otherwise(F.col("cpu")), *[F.round(c, 3).cast("string") for c in K.CORE_COLUMNS]).alias("value"))
    return body.unionByName(d.select(CID).distinct().select(CID, F.lit(-1).alias("ord"), F.lit(CPU_HEAD).alias("value")))


add("a2_sar_cpu_scan", lambda v: A.sar(sar_cpu_lines(v), "cpu").drop("hostname", "interval"), "select collection_id, cast(timestamp as string) as timestamp, cpu, " + ", ".join(f"round({c}, 3) + 0.0 as {c}" for c in K.CORE_COLUMNS) + " from fx_sar_cpu")
SERIES_LINE = lambda: F.concat_ws(";", F.col("timestamp").cast("string"), F.concat(F.lit("CPU"), F.col("cpu_id").cast("string")), F.when(F.col("value") % 7 == 0, "<not counted>").otherwise(F.format_number("value", 0)), F.lit(""), F.col("metric_type"), F.lit("1"), F.lit("100"), F.format_string("%.2f", F.col("run_pct").cast("double")), F.when(F.col("value") % 2 == 0, "IPC").otherwise("other"))
add("a3_counter_series", lambda v: X.counter_series(lines(v.fx_counters, SERIES_LINE())).drop("ord"), "select collection_id, timestamp, concat('CPU', cast(cpu_id as string)) as cpu, cast(value as double) as value, '' as unit, metric_type as event_name from fx_counters where value % 7 <> 0")
add("a4_counter_metrics", lambda v: X.counter_metrics(lines(v.fx_counters, SERIES_LINE())).drop("ord"), "select collection_id, timestamp, concat('CPU', cast(cpu_id as string)) as cpu, cast(run_pct as double) as value, 'IPC' as metric_name from fx_counters where value % 2 = 0")
CSV_LINE = lambda: F.concat_ws(",", F.col("timestamp").cast("string"), F.concat(F.lit("CPU"), F.col("cpu_id").cast("string")), F.when(F.col("value") % 7 == 0, "<not counted>").otherwise(F.col("value").cast("string")), F.lit(""), F.col("metric_type"), F.lit("1000"), F.col("run_pct").cast("string"))
add("a5_counter_csv", lambda v: X.counter_csv(lines(v.fx_counters, CSV_LINE())), "select collection_id, ord, timestamp, cpu_id, value, metric_type, cast(run_pct as double) as run_pct from fx_counters where value % 7 <> 0")
FLAT_LINE = lambda: F.concat(F.col("command"), F.lit(" "), F.col("pid").cast("string"), F.lit(" ["), F.lpad(F.col("cpu").cast("string"), 3, "0"), F.lit("] "), F.col("time"), F.lit(": "), F.col("value").cast("string"), F.lit(" "), F.col("event"), F.lit(":  "), F.col("addr0"), F.lit(" "), F.col("symbol0"), F.lit(" ("), F.translate("dso0", " ", "_"), F.lit(")"))
add("a6_flat_samples", lambda v: X.flat_samples(lines(v.fx_samples, FLAT_LINE())), "select collection_id, ord, command, pid, cpu, time, value, event, addr0 as addr, symbol0 as symbol, replace(dso0, ' ', '_') as dso_short_name from fx_samples")


def block_text(i: int):
    return F.concat(F.lit("\t"), F.col(f"addr{i}"), F.lit(" "), F.col(f"symbol{i}"), F.lit(" ("), F.col(f"dso{i}"), F.lit(")"))


HEADER = lambda: F.concat(F.col("command"), F.lit(" "), F.col("pid").cast("string"), F.lit(" ["), F.col("cpu").cast("string"), F.lit("] "), F.col("time"), F.lit(": "), F.col("value").cast("string"), F.lit(" "), F.col("event"), F.lit(": "))
BLOCK = lambda: F.concat_ws("\n", F.lit("# a comment"), HEADER(), block_text(0), block_text(1), block_text(2))
add(
    "a7_chain_samples", lambda v: E.flat_rows(X.chain_samples(lines(v.fx_samples, BLOCK()))).select(CID, F.col("ord.ord").alias("ord"), "command", "pid", "cpu", "time", "value", "event", "calls"),
    f"with {CALLS} select collection_id, ord, command, pid, cpu, time, value, event, concat(addr, ' ', symbol, ' (', dso, ')') as calls from c",
)


def bare_text(i: int):
    return F.concat(F.lit("\t"), F.col(f"symbol{i}"), F.lit(" ("), F.col(f"dso{i}"), F.lit(")"))


TID_HEADER = lambda: F.concat(F.col("command"), F.lit(" "), F.col("pid").cast("string"), F.lit("/"), (F.col("pid") + 1).cast("string"), F.lit(" "), F.col("time"), F.lit(": "), F.col("event"), F.lit(": "))
COMMAND_HEADER = lambda: F.concat(F.col("command"), F.lit(":"))
add(
    "f1_text_bare", lambda v: FC.collapse(X.chain_samples(lines(v.fx_samples, F.concat_ws("\n", TID_HEADER(), bare_text(0), bare_text(1), bare_text(2)))), FC.Options(event="cycles", include_tid=True)),
    FOLD.replace("sum(value)", "count(*)").format(proc="concat(command, ' ', cast(pid as string), '/', cast(pid + 1 as string))", f2="symbol2", f1=UNKNOWN1, f0=BARE0, where="event = 'cycles'"),
)
add(
    "f1_text_command", lambda v: FC.collapse(X.chain_samples(lines(v.fx_samples, F.concat_ws("\n", COMMAND_HEADER(), block_text(0), block_text(1), block_text(2)))), FC.Options(event="cycles", include_pid=True)),
    FOLD.replace("sum(value)", "count(*)").format(proc="command", f2="symbol2", f1=UNKNOWN1, f0=BARE0, where="true"),
)


def report_lines(v: Views) -> DataFrame:
    d = v.tr_calls.select(F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias(CID), F.col("id").alias("ord"), F.concat(F.rpad(F.format_string(" %.2f%% %.2f%%", (F.col("id") % 100).cast("double"), (F.col("id") % 50).cast("double")), 17, " "), F.rpad(F.concat(F.lit("c"), F.col("thread_id").cast("string")), 14, " "), F.rpad(F.lit("lib x.so"), 12, " "), F.when(F.col("id") % 2 == 0, "[k] ").otherwise("[.] "), F.lit("f<a,  b>::"), F.col("comm_id").cast("string")).alias("value"))
    ruler = d.select(CID).distinct().select(CID, F.lit(-1).cast("bigint").alias("ord"), F.concat(F.lit("." * 15), F.lit("  "), F.lit("." * 12), F.lit("  "), F.lit("." * 10), F.lit("  "), F.lit("." * 20)).alias("value"))
    return d.unionByName(ruler.withColumn("value", F.regexp_replace("value", "^", "#")).withColumn("value", F.regexp_replace("value", r"^#\.", "#"))).unionByName(ruler.withColumn("ord", F.lit(-2).cast("bigint")).withColumn("value", F.lit("# Overhead")))


add(
    "a8_report_rows", lambda v: X.report_rows(report_lines(v)),
    "select concat('c', cast(id % 3 as string)) as collection_id, cast(id % 100 as double) as overhead_cycles, cast(id % 50 as double) as overhead_insns, concat('c', cast(thread_id as string)) as command, 'lib x.so' as shared_object, case when id % 2 = 0 then 'k' else '.' end as execution_mode, concat('f<a, b>::', cast(comm_id as string)) as symbol from tr_calls",
)
HOT_LINE = lambda: F.concat(F.lit("  "), F.format_string("%.2f%%", F.col("insn_count") / 100.0), F.lit("  "), F.col("cyc_count").cast("string"), F.lit(" cmd lib.so "), F.when(F.col("id") % 3 == 0, "[k] ").when(F.col("id") % 3 == 1, "[.] ").otherwise(""), F.lit("f"), F.col("comm_id").cast("string"), F.lit("   -  -  "))
add(
    "a9_hotspots", lambda v: X.hotspots(v.tr_calls.select(F.concat(F.lit("c"), (F.col("comm_id")).cast("string")).alias(CID), F.col("id").alias("ord"), HOT_LINE().alias("value")), 50),
    """select collection_id, round(insn_count / 100.0, 2) + 0.0 as overhead, cyc_count as samples, 'cmd' as process, 'lib.so' as library, concat('f', cast(comm_id as string)) as symbol, case when id % 3 = 0 then 'Kernel' when id % 3 = 1 then 'User' else 'Unknown' end as scope
from (select *, concat('c', cast(comm_id as string)) as collection_id, row_number() over (partition by comm_id order by id) as k from tr_calls) where k <= 50""",
)
add(
    "a10_build_ids", lambda v: X.build_ids(v.tr_symbols.select(F.lit("c").alias(CID), F.col("id").alias("ord"), F.when(F.col("id") % 10 == 0, "broken").otherwise(F.concat(F.hex("sym_start"), F.lit(" /lib/m"), (F.col("id") % 37).cast("string"))).alias("value"))),
    "select 'c' as collection_id, concat('/lib/m', cast(id % 37 as string)) as module, arg_max(upper(to_hex(sym_start)), id) as build_id from tr_symbols where id % 10 <> 0 group by 1, 2",
)
add("a11_folded", lambda v: X.folded(B.folded_lines(v.fx_folded)), "select collection_id, stack, weight from fx_folded")
add(
    "a12_folded_lenient", lambda v: X.folded(v.fx_folded.select(CID, F.when(F.col("weight") % 2 == 0, F.concat_ws(" ", "stack", F.col("weight").cast("string"))).otherwise(F.translate("stack", " ", "_")).alias("value")), lenient=True),
    "select collection_id, stack, cast(sum(w) as bigint) as weight from (select collection_id, case when weight % 2 = 0 then stack else replace(stack, ' ', '_') end as stack, case when weight % 2 = 0 then weight else 1 end as w from fx_folded) group by 1, 2",
)

# Sinks: what is written --------------------------------------------------------------------------------------------------------
add("b1_folded_lines", lambda v: B.folded_lines(v.fx_folded), "select collection_id, concat(stack, ' ', cast(weight as string)) as value from fx_folded")
add("b2_symbol_csv", lambda v: B.symbol_stats_csv(G.symbol_hotspots(v.fx_folded), G.total_weight(v.fx_folded)), SYMBOLS + " select h.collection_id, symbol, inclusive, printf('%.2f%%', inclusive * 100.0 / total) as inclusive_pct, leaf, printf('%.2f%%', leaf * 100.0 / total) as leaf_pct from hot h join totals using (collection_id)")
add("b3_stack_csv", lambda v: B.stack_stats_csv(v.fx_folded), "select collection_id, stack, weight from fx_folded")
add("b4_path_csv", lambda v: B.path_stats_csv(H.path_stats(v.fx_folded)).select(CID, "path", "count"), PATHS + " select collection_id, array_to_string(path, ';') as path, count from paths")
add(
    "b4_path_csv_percent", lambda v: B.path_stats_csv(H.path_stats(v.fx_folded)),
    PATHS + ", whole as (select collection_id, sum(weight) as total from fx_folded where contains(stack, ';') group by 1) select collection_id, array_to_string(path, ';') as path, count, printf('%.2f%%', count * 100.0 / total) as percent from paths join whole using (collection_id)",
)
add("b6_rounded_records", lambda v: B.rounded_records(v.fx_series.select(CID, "timestamp", (F.floor("tps") / 8).alias("x"))), "select collection_id, timestamp, round_even(floor(tps) / 8, 2) as x from fx_series")
add("b7_groups_json", lambda v: B.groups_json(J.module_groups(v.chains)))
MODULES, _, RANKED = SQL["j7_module_groups"].replace("array_to_string(list_sort(list_distinct(list(n.function))), ',') as functions", "list_sort(list_distinct(list(n.function))) as functions").rpartition("select collection_id, cast(dense_rank()")
SQL["b7_groups_json"] = f"{MODULES}select collection_id, cast(to_json(struct_pack(cluster := cluster, dso := dso, functions := functions)) as varchar) as js from (select collection_id, cast(dense_rank(){RANKED})"


def spec_files(v: Views) -> DataFrame:
    """Specifications of the devices as YAML (of which JSON is a part), and files that must not count beside them."""
    device = F.struct("name", "rotational", "size_bytes", F.struct(F.col("fs_percent").alias("percent"), "mount").alias("fs_usage"))
    text = F.concat(F.lit("cpu_info: {cores: 4}\ndisk_info:\n  block_devices: "), F.to_json(F.collect_list(device)))
    d = v.fx_devices.groupBy(CID).agg(text.alias("text"))
    kinds = {"static_info.yaml": F.col("text"), "spec_info.yaml": F.lit("disk_info: {}"), "other.yaml": F.lit("[")}
    return d.select(CID, F.explode(F.array(*[F.struct(F.lit(k).alias("file"), t.alias("text")) for k, t in kinds.items()])).alias("f")).select(CID, "f.*")


add(
    "a13_system_specs", lambda v: A.devices(A.system_specs(spec_files(v))).select(CID, "name", F.col("rotational").cast("string").alias("rotational"), F.col("size_bytes").cast("bigint").alias("size_bytes"), F.col("fs_percent").cast("double").alias("fs_percent"), "mount"),
    "select collection_id, name, cast(rotational as string) as rotational, cast(size_bytes as bigint) as size_bytes, cast(fs_percent as double) as fs_percent, mount from fx_devices",
)


def archives(v: Views) -> DataFrame:
    """A tar archive for each collection, with a list of its devices in the data folder and a file outside of it."""

    def packed(frames):
        import io
        import tarfile

        import pandas as pd

        for f in frames:
            for cid, text in zip(f[CID], f["text"], strict=True):
                out = io.BytesIO()
                with tarfile.open(fileobj=out, mode="w") as tar:
                    for name, body in (("attach_session_1/devices.csv", text), ("attach_session_1/in/empty.csv", ""), ("zother/x", "x")):
                        info = tarfile.TarInfo(name)
                        info.size = len(body.encode())
                        tar.addfile(info, io.BytesIO(body.encode()))
                yield pd.DataFrame({"path": [f"/a/{cid}.tar"], "content": [out.getvalue()]})

    lines = F.array_join(F.sort_array(F.collect_list(F.concat_ws(",", "name", F.col("size_bytes").cast("string")))), "\n")
    return v.fx_devices.groupBy(CID).agg(lines.alias("text")).mapInPandas(packed, "path string, content binary")


add(
    "a14_archive_members", lambda v: A.unpacked(archives(v)),
    "with t as (select collection_id, array_to_string(list_sort(list(concat_ws(',', name, cast(size_bytes as string)))), chr(10)) as text from fx_devices group by 1) select collection_id, 'devices.csv' as file, cast(strlen(text) as bigint) as size, text from t union all select collection_id, 'in/empty.csv', cast(0 as bigint), '' from t",
)
add(
    "a14_archive_lines", lambda v: A.unpacked_lines(archives(v)),
    "with t as (select collection_id, list_sort(list(concat_ws(',', name, cast(size_bytes as string)))) as rows from fx_devices group by 1) select collection_id, 'devices.csv' as file, cast(i - 1 as bigint) as ord, rows[i] as value from (select *, unnest(range(1, len(rows) + 1)) as i from t)",
)


def quoted(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows as lines of CSV, texts in quotes with a comma and a quote put into them."""
    def cell(c: str):
        if A.TRACE_TYPES.get(c) == "string":
            return F.coalesce(F.concat(F.lit('"'), F.col(c), F.lit(', ""x"""')), F.lit(""))
        return F.coalesce((F.col(c).cast("int") if A.TRACE_TYPES.get(c) == "boolean" else F.col(c)).cast("string"), F.lit(""))

    return df.select(F.array_join(F.array(*map(cell, names)), ",").alias("value"))


def trace_text(v: Views, table: str) -> DataFrame:
    """A table's rows; every third has a further field, and every fifth lacks the last one where there are more than two."""
    names = A.TRACE[table].split()
    d = v.__getattr__(f"tr_{table}")
    more = quoted(d.filter("id % 3 = 0"), names).withColumn("value", F.concat("value", F.lit(",77")))
    rest = d.filter("id % 3 <> 0")
    return more.unionByName(quoted(rest.filter("id % 5 <> 0"), names)).unionByName(quoted(rest.filter("id % 5 = 0"), names[:-1]))


def trace_sql(table: str) -> str:
    names = A.TRACE[table].split()
    def cell(c: str) -> str:
        x = f"concat({c}, ', \"x\"')" if A.TRACE_TYPES.get(c) == "string" else c
        return f"case when id % 3 = 0 or id % 5 <> 0 then {x} end as {c}" if c == names[-1] else f"{x} as {c}"

    return f"select {', '.join(map(cell, names))} from tr_{table}"


for _table in A.TRACE:
    if _table != "samples":
        add(f"a15_{_table}", lambda v, t=_table: A.trace_rows(trace_text(v, t), t), trace_sql(_table))


def sample_text(v: Views) -> DataFrame:
    """Samples in the branch form, the whole one, without their last two fields, and with two more."""
    d = v.tr_samples.select("*", F.lit(3).cast("bigint").alias("machine_id"), F.col("insn_count").alias("period"), F.lit(2).cast("bigint").alias("weight"), F.lit(None).cast("bigint").alias("transaction_"), F.lit(9).cast("bigint").alias("data_src"))
    names = A.TRACE["samples"].split()
    head, gap = names.index("period"), 4
    # One read of the view, and each field's text made once: a form is a choice of the fields.
    cells = F.array(*[F.coalesce((F.col(c).cast("int") if A.TRACE_TYPES.get(c) == "boolean" else F.col(c)).cast("string"), F.lit("")) for c in names])
    d = d.filter("id % 4 >= 0").select("id", X.found_once(cells))
    f, more = F.col("f"), [F.get("f", F.lit(names.index(c))) for c in ("ip", "time")]
    branch = F.concat(F.slice(f, 1, head), F.slice(f, head + gap + 1, len(names) - head - gap))
    form = F.when(F.col("id") % 4 == 0, branch).when(F.col("id") % 4 == 1, f).when(F.col("id") % 4 == 2, F.slice(f, 1, len(names) - 2))
    value = F.array_join(form.otherwise(F.concat(f, F.array(*more))), ",")
    return d.select(value.alias("value"))


PADDED = {"machine_id": "3", "period": "case when id % 4 <> 0 then insn_count end", "weight": "case when id % 4 <> 0 then 2 end", "transaction_": "null", "data_src": "case when id % 4 <> 0 then 9 end", "cyc_count": "case when id % 4 = 2 then 0 else cyc_count end", "flags": "case when id % 4 = 2 then 0 else flags end"}
add("a15_samples", lambda v: A.trace_rows(sample_text(v), "samples"), "select " + ", ".join(f"cast({PADDED.get(c, c)} as {A.TRACE_TYPES.get(c, 'bigint')}) as {c}" for c in A.TRACE["samples"].split()) + " from tr_samples")
