"""Faults found in the fourth round."""

from collections import Counter

import duckdb
from pyspark.sql import functions as F

from tracelake.operators import CID
from tracelake.operators import samples as E
from tracelake.plans import queries as Q
from tracelake.plans.views import TABLES


def samples(spark, cycles, instructions):
    """Samples of one place: (value, how many) of each event."""
    ds = [spark.range(n).select(F.lit("c").alias(CID), F.lit("p").alias("symbol"), F.lit(e).alias("event"), F.lit(v).cast("bigint").alias("value")) for e, of in (("cycles", cycles), ("instructions", instructions)) for v, n in of]
    out = ds[0]
    for d in ds[1:]:
        out = out.unionByName(d)
    return out


def test_pairs_of_one_place_are_dealt_to_all_tasks(spark):
    """The pairs of a single place, of a single value even, are not the work of one task."""
    n = 2 * E.SIDE + 100
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    try:
        out = E.flat_wide(samples(spark, [(6, n)], [(3, n), (None, 1), (0, 1)]), ["symbol"])
        tasks = out.groupBy(F.spark_partition_id(), "cycles", "instructions", "CPI").count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = Counter()
    for r in tasks:
        got[r["cycles"], r["instructions"], r["CPI"]] += r["count"]
    assert got == {(6, 3, 2.0): n * n, (6, None, None): n, (6, 0, None): n}
    assert max(r["count"] for r in tasks) < n * n


def test_repeated_rows_at_the_edges_of_blocks(spark):
    """A row for every pair, where as many samples or pairs as a row or a block holds come together, one less or one more."""
    many = [1, E.BLOCK - 1, E.BLOCK, E.BLOCK + 1, E.SIDE, E.SIDE + 1, 2 * E.SIDE + 1]
    few = [1, 2, 3]
    out = E.flat_wide(samples(spark, list(enumerate(many)), list(enumerate(few))), ["symbol"], digits=3)
    assert out.columns == [CID, "symbol", "cycles", "instructions", "CPI"]
    got = {(r["cycles"], r["instructions"], r["CPI"]): r["count"] for r in out.groupBy("cycles", "instructions", "CPI").count().collect()}
    assert got == {(c, i, round(c / i, 3) if i else None): n * m for c, n in enumerate(many) for i, m in enumerate(few)}


def test_sides_of_all_pairs_read_their_own_event(spark):
    """Neither side of the join counts the other's samples."""
    out = E.flat_wide(samples(spark, [(1, 2)], [(1, 3)]).repartition(2), ["symbol"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    counted = [line for line in plan.splitlines() if "count(" in line]
    assert out.count() == 6 and counted and not [line for line in counted if "CASE" in line or "event" in line]


def test_pairs_in_order_are_the_sql_with_its_ties_by_value(spark):
    """The SQL leaves the order of equal `ord` open; the query is what it gives when value decides there."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    sql = Q.SQL["d1_flat_wide_in_order"]
    decided = sql.replace("order by ord)", "order by ord, value)")
    out = Q.QUERIES["d1_flat_wide_in_order"](spark, "/root/testdata/sf0.001")
    want = con.execute(f"select {', '.join(out.columns)} from ({decided})").fetchall()
    assert decided != sql and len(want) > 3000
    assert Counter(map(tuple, out.collect())) == Counter(want)
