"""Faults found in the third round."""

from pyspark.sql import functions as F

from tracelake.operators import CID
from tracelake.operators import callgraph as J
from tracelake.operators import samples as E
from tracelake.operators import stacks as G
from tracelake.plans.views import view
from tracelake.sources import text as X


def test_subset_symbols_count_a_stack_once(spark):
    """A symbol that a stack holds twice counts once; equal costs are ranked by name, whatever their leaf cost."""
    d = spark.createDataFrame([("c", "p;x;a;x", 3), ("c", "p;x;b", 2), ("c", "p;a;x", 1), ("c", "p;b;x", 2), ("c", "x", 5), ("c", "p;q", 7)], f"{CID} string, stack string, weight bigint")
    got = G.subset_summary(d, "x", 3, once=True)["symbols"].select("symbol", "inclusive", "leaf", "rank", F.round("inclusive_pct", 3)).collect()
    assert sorted(map(tuple, got), key=lambda r: r[3]) == [("x", 8, 6, 1, 61.538), ("a", 4, 0, 2, 30.769), ("b", 4, 2, 3, 30.769)]
    whole = {r["symbol"]: r["inclusive"] for r in G.subset_summary(d, "x", 3)["symbols"].collect()}
    assert whole == {"x": 11, "a": 4, "b": 4}


def test_pairs_in_order_don_t_hang_on_the_order_of_rows(spark):
    """Samples of one place and one ord are paired by value, however the rows come."""
    rows = [("c", 1, "p", "cycles", v) for v in (9, 2, 5)] + [("c", 1, "p", "instructions", v) for v in (4, 8, 6)] + [("c", 0, "p", "cycles", 7), ("c", 2, "p", "instructions", 1)]
    for given in (rows, rows[::-1], sorted(rows, key=lambda r: r[4])):
        d = spark.createDataFrame(given, f"{CID} string, ord int, symbol string, event string, value bigint").coalesce(1)
        got = E.flat_wide(d, ["symbol"], pair="order").select("cycles", "instructions").collect()
        assert sorted(map(tuple, got)) == [(2, 6), (5, 8), (7, 4), (9, 1)]


def test_all_pairs_are_joined_by_distinct_values(spark):
    """Of a place with many equal values the join gets each once; the rows are those of all pairs."""
    rows = [("c", "p", e, v) for e, vs in (("cycles", [1, 1, 2, None, 0, 1]), ("instructions", [3, 3, 0, None])) for v in vs] + [("c", "q", "cycles", 1), ("c", None, "cycles", 1), ("c", None, "instructions", 1)]
    out = E.flat_wide(spark.createDataFrame(rows, f"{CID} string, symbol string, event string, value bigint"), ["symbol"], digits=2)
    c, i = ([r[3] for r in rows if r[1] == "p" and r[2] == e] for e in ("cycles", "instructions"))
    want = [("c", "p", x, y, None if x is None or not y else round(x / y, 2)) for x in c for y in i]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    big = spark.range(4000).select(F.lit("c").alias(CID), F.lit("p").alias("symbol"), F.when(F.col("id") % 2 == 0, "cycles").otherwise("instructions").alias("event"), (F.col("id") % 2).alias("value"))
    out = E.flat_wide(big, ["symbol"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 2000 * 2000 and plan.split("Join")[1].count("Aggregate") == 2


def test_address_nodes_count_before_they_sort(spark):
    """Every call of a task goes into a hash table, not into a sort; the node has the names of the first sighting."""
    call = "array<struct<addr:string,symbol:string,dso:string>>"
    rows = [("c", 5, "p", "cycles", 3, [("a", "f+0x1", "d"), ("b", "g", "d")]), ("c", 2, "q", "misses", 4, [("b", "h", "e"), ("a", "k", "d")]), ("c", 7, "q", "misses", None, [("a", "f", "x")]), ("c", 8, "q", "instructions", 2, [("b", "g", "x")]), ("c", 9, "q", "cycles", 2, [("a", "g", "x")])]
    d = spark.createDataFrame(rows, f"{CID} string, ord bigint, command string, event string, value bigint, calls {call}").withColumns({"pid": F.lit(1), "cpu": F.lit(0)})
    out = J.address_nodes(d)
    got = sorted(tuple(r) for r in out.drop(CID, "offset").collect())
    assert got == [("a", "k", "k", "d", None, 5, 0, {"misses": None}, 2, 1), ("b", "h", "h", "e", "q", 0, 2, {"misses": 4}, 2, 0)]
    lines = out._jdf.queryExecution().sparkPlan().toString().splitlines()
    explodes = [i for i, line in enumerate(lines) if "Generate explode" in line or "Generate posexplode" in line]
    above = [next(line for line in reversed(lines[:i]) if "Aggregate(" in line) for i in explodes]
    assert len(above) == 1 and "HashAggregate(" in above[0]


def test_fields_are_found_once_whatever_is_filtered(spark):
    """Filters on a sample's fields don't search the text again."""
    d = spark.range(3).select(F.lit("c").alias(CID), F.col("id").alias("ord"), F.concat(F.lit("a 1 [000] 2.5: "), F.col("id").cast("string"), F.lit(" ev:  ff f (lib)")).alias("value"))
    flat = X.flat_samples(d).filter("event = 'ev' and value > 0")
    assert flat.count() == 2 and flat._jdf.queryExecution().optimizedPlan().toString().count("(?d)^") == 1
    chains = X.chain_samples(d.withColumn("value", F.concat("value", F.lit("\n\tff f (lib)")))).filter("event = 'ev' or event is null")
    assert chains.count() == 3 and chains._jdf.queryExecution().optimizedPlan().toString().count("split(piece") == 1


def test_numbered_views_keep_the_parts_of_a_shuffle(spark):
    """Small parts that are numbered by order are not merged, so that a task sorts one of them."""
    for name in ("fx_samples", "tr_samples"):
        assert view(spark, "/root/testdata/sf0.001", name).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
