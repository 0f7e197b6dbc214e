"""Small inputs with known results: text formats, counters, stacks, disks, rules."""

import json
import tarfile

import pytest
from pyspark.sql import functions as F

from tracelake.functions import text as T
from tracelake.operators import CID
from tracelake.operators import collapse as FC
from tracelake.operators import counters as C
from tracelake.operators import layout as I
from tracelake.operators import rules as L
from tracelake.operators import samples as E
from tracelake.operators import stacks as G
from tracelake.operators import system as K
from tracelake.operators import tree as H
from tracelake.sources import sinks as B
from tracelake.sources import tables as A
from tracelake.sources import text as X


def lines(spark, text):
    return spark.createDataFrame([("c", i, x) for i, x in enumerate(text.split("\n"))], f"{CID} string, ord int, value string")


COUNTERS = """# started
1.0,CPU0,2000,,cycles:D,1000,100.00,,
1.0,CPU0,1000,,instructions:D,1000,100.00,0.5,insn per cycle
1.0,CPU1,2400,,cycles:D,1000,75.00,,
1.0,CPU1,1600,,instructions:D,1000,100.00,,
2.0,CPU0,<not counted>,,cycles:D,0,0.00,,
2.0,CPU1,50,,ref-cycles:D,1000,100.00,,"""


def test_counters(spark):
    rows = X.counter_csv(lines(spark, COUNTERS))
    n = C.normalise(rows)
    assert n.count() == 5
    got = {r["cpu_id"]: r["CPI"] for r in C.cpi(n).collect()}
    assert got == {0: 2.0, 1: 1.5}
    total = C.cpi_overall(n, "system").first()
    assert (total["cycles"], total["instructions"]) == (4400, 2600)
    with pytest.raises(ValueError):
        C.cpi_overall(n, "core")
    assert C.is_multiplexing(rows).first()["multiplexing"]
    assert C.events_overall(n, "none").agg(F.sum("value")).first()[0] == 0


def test_counter_series(spark):
    text = "1.0;CPU0;1,200;Joules;power/energy/;1;100;;\n1.0;S0;5;;clock MHz;1;100;2.5;some IPC\nbad\n;;\n1.0;3;;cycles"
    rows = {r["event_name"]: r for r in X.counter_series(lines(spark, text)).collect()}
    assert rows["power/energy/"]["value"] == 1200 and rows["power/energy/"]["unit"] == "Joules"
    assert rows["clock MHz"]["unit"] == "MHz" and rows["cycles"]["cpu"] == "all"
    assert [r["value"] for r in X.counter_metrics(lines(spark, text)).collect()] == [2.5]


def test_aggregated_and_malformed_counters(spark):
    rows = X.counter_csv(lines(spark, "1.0,2200,,cycles:D,1,100\n1.0,x,,cycles:D,1,100")).collect()
    assert [(r["cpu_id"], r["value"]) for r in rows] == [(-1, 2200)]
    assert X.counter_csv(lines(spark, "# only a comment")).count() == 0
    assert X.counter_csv(lines(spark, "1.0,CPU0,5,,cycles")).count() == 0


BLOCKS = """# comment
my app         12 [003] 1.000001: 10 cycles:
\tf0 leaf+0x10 (/lib/a.so)
\tf1 [unknown] (/lib/b.so)
\tf2 main (app)

other 7 [000] 2.5: 3 instructions:
\tf0 a->b (x)
other 7 [000] 3.5: 4 instructions:
\tf9 vfs(char*) ([kernel.kallsyms])"""


def test_blocks_and_collapse(spark, tmp_path):
    path = tmp_path / "host1" / "script.txt"
    path.parent.mkdir()
    path.write_text(BLOCKS)
    s = X.chain_samples(X.read_blocks(spark, str(path)))
    got = s.orderBy("time").collect()
    assert [(r["command"], r["pid"], r["time"], len(r["calls"])) for r in got] == [("my app", 12, "1.000001", 3), ("other", 7, "2.5", 1), ("other", 7, "3.5", 1)]
    assert got[0][CID] == "host1"
    folded = {r["stack"]: r["weight"] for r in FC.collapse(s, FC.Options(event="cycles")).collect()}
    assert folded == {"my_app;main;[b.so];leaf": 10}
    folded = {r["stack"]: r["weight"] for r in FC.collapse(s, FC.Options(event="instructions", annotate_kernel=True, include_pid=True)).collect()}
    assert folded == {"other 7;b;a": 3, "other 7;vfs_[k]": 4}
    assert E.in_window(s, start=2, delta="x").count() == 2
    assert E.in_window(s, start="0", end=None).count() == 3


def test_header_and_frame_forms(spark):
    text = "mysqld 12/34 [000] 5.5: 7 cycles:ppp:\n\tffff a (x)\n\nold app 9 6.25: cycles:\n\tmain (app)\n\t12 a::b(int) (/l/x.so (deleted))\n\nalone:\n\tf z (y)\n\nno header\n\tf z (y)"
    d = spark.createDataFrame([("c", i, b) for i, b in enumerate(text.split("\n\n"))], f"{CID} string, ord int, value string")
    got = [tuple(r)[2:] for r in X.chain_samples(d).orderBy("ord").collect()]
    assert got == [
        ("mysqld", 12, 34, 0, "5.5", 7, "cycles:ppp", [("ffff", "a", "x")]),
        ("old app", 9, None, None, "6.25", None, "cycles", [("", "main", "app"), ("12", "a::b(int)", "/l/x.so (deleted)")]),
        ("alone", None, None, None, None, None, None, [("f", "z", "y")]),
    ]
    names = ["f(int)", "a;b(x)", "(anonymous namespace)::g(int)", "main.(*T).run", "h(int)::(anonymous namespace)::k()", "plain", "q'\"s"]
    out = spark.createDataFrame([(n,) for n in names], "s string").select(FC.clean_symbol(F.col("s"))).collect()
    assert [r[0] for r in out] == ["f", "a:b", "(anonymous namespace)::g", "main.(*T).run", "h", "plain", "qs"]


def test_flat_samples(spark):
    text = "# ========\ncmd 1 [002] 3.25: 9 cycles:  ffff sym+0x1 (lib.so)\nbroken line"
    r = X.flat_samples(lines(spark, text)).collect()
    assert len(r) == 1 and r[0]["time"] == "3.25" and r[0]["symbol"] == "sym+0x1" and r[0]["cpu"] == 2


def test_folded_scans(spark):
    text = "p;a;b 5\np;a;b 2\n#x;y 1\nlone 3\np;a\np;c x"
    assert {(r["stack"], r["weight"]) for r in X.folded(lines(spark, text)).collect()} == {("p;a;b", 7)}
    assert ("p;a", 1) in {(r["stack"], r["weight"]) for r in X.folded(lines(spark, text), lenient=True).collect()}


@pytest.fixture
def stacks(spark):
    return spark.createDataFrame([("c", "proc;foo;bar", 10), ("c", "proc;foo;baz", 5), ("c", "proc;other", 1), ("c", "q;bar;bar", 4), ("c", "q", 2)], f"{CID} string, stack string, weight bigint")


def test_stacks(stacks):
    got = {r["symbol"]: (r["inclusive"], r["leaf"]) for r in G.symbol_hotspots(stacks).collect()}
    assert got["bar"] == (18, 14) and got["foo"] == (15, 0)
    assert G.topk_stacks(stacks, 0).count() == 0
    assert G.subset_by_symbol(stacks, "bar").count() == 2
    with pytest.raises(ValueError):
        G.subset_by_path(stacks, [])
    assert G.symbol_share(stacks, "absent").first()["share"] == 0


def test_tree_invariants(stacks):
    t = H.build_tree(stacks)
    total = stacks.filter("stack like '%;%'").agg(F.sum("weight")).first()[0]
    assert t.filter("depth = 1").agg(F.sum("count")).first()[0] == total == t.agg(F.sum("leaf_count")).first()[0]
    stats = H.path_stats(stacks, 1).collect()
    assert len(stats) == 1 and stats[0]["truncated"] and stats[0]["path"] == ["foo", "bar"]
    with pytest.raises(ValueError):
        H.symbol_overhead(stacks, "")


def test_layouts_agree(spark):
    """By text the blocks are those of the same order given row by row, also where a name comes between a leaf and its namesake."""
    stacks = ["a", "a;foo", "a;foo(int);x", "a;foo;y", "a;foo;z", "a b;c", "b", "b;foo", "b;foo;y;y", "b;foo.part", ";x", "a;;q"]
    rows = [(c, s, i + 1 + len(c)) for c in ("c", "dd") for i, s in enumerate(stacks)]
    d = spark.createDataFrame(rows, f"{CID} string, stack string, weight bigint")
    place = {s: i for i, s in enumerate(sorted(stacks))}
    given = spark.createDataFrame([(c, s, w, -place[s]) for c, s, w in rows], f"{CID} string, stack string, weight bigint, ord int")
    blocks = lambda x: sorted(tuple(r) for r in x.collect())
    assert blocks(I.layout(d)) == blocks(I.layout(given, flamechart=True))
    two = lambda x: x.withColumn("w2", F.col("weight") * 3 + F.length("stack"))
    assert blocks(I.layout(two(d), second="w2")) == blocks(I.layout(two(given), flamechart=True, second="w2"))
    assert I.layout(d.limit(0)).count() == 0


def test_text_functions(spark):
    r = spark.range(1).select(T.cpu_set(F.lit("0-2,5, 7-8,x")), T.cpu_ranges(F.array(*map(F.lit, ["0", "1", "2", "all", "4", "5", "7"]))), T.cpu_ranges(F.array().cast("array<string>")), T.byte_text(F.lit(3 * 1024**3)), T.byte_text(F.lit(5)), T.natural_sorted(F.array(*map(F.lit, ["10", "2", "a"])))).first()
    assert list(r) == [["0", "1", "2", "5", "7", "8"], "all,0-2,4-5,7", "None", "3.00 GB", "5 B", ["a", "2", "10"]]


def cpu_table(spark, load):
    rows = [("c", t, str(i), u, 0.0, w, 100.0 - u) for t in range(3) for i, (u, w) in enumerate(load)] + [("c", t, "all", 5.0, 1.0, 2.0, 92.0) for t in range(3)]
    return spark.createDataFrame(rows, f"{CID} string, timestamp int, cpu string, pct_user double, pct_system double, pct_iowait double, pct_idle double")


def test_core_classes(spark):
    d = cpu_table(spark, [(90.0, 0.0), (12.0, 0.0), (1.0, 0.0), (20.0, 0.0)])
    assert {r["cpu"]: r["class"] for r in K.core_classes(d).collect()} == {"0": 1, "1": 0, "2": 99, "3": 1}
    assert K.core_classes(cpu_table(spark, [(1.0, 0.0)])).count() == 0


def disk_table(spark):
    rows = [("c", t, "sda", 85.0, 30.0, 85.0, 8.0) for t in range(3)] + [("c", t, "loop0", 99.0, 1.0, 1.0, 1.0) for t in range(3)]
    return spark.createDataFrame(rows, f"{CID} string, timestamp int, dev string, pct_util double, await double, aqu_sz double, areq_sz double")


def test_context_and_rules(spark):
    cpu = cpu_table(spark, [(5.0, 20.0)] * 8)
    dev = spark.createDataFrame([("c", "sda", "SSD")], f"{CID} string, name string, rotational string")
    ctx = K.full_context({"cpu": cpu, "disk": disk_table(spark), "devices": dev}, cpu.select(CID).distinct(), L.CONFIG)
    r = ctx.first()
    assert r["busiest_disk_name"] == "sda" and r["busiest_disk_subtype"] == "SATA_SSD" and r["effective_await_threshold"] == 5.0 and r["avg_cswch"] == 0.0
    on = {x["path"] for x in L.evaluate(ctx).filter("active").collect()}
    assert {"diagnosis/OFF-CPU", "diagnosis/disk I/O", "diagnosis/disk I/O/saturation", "diagnosis/disk I/O/congestion", "diagnosis/disk I/O/saturation/small requests"} <= on
    assert "diagnosis/ON-CPU" not in on
    empty = K.full_context({}, cpu.select(CID).distinct())
    assert empty.first()["total_cpu"] == 0.0
    assert not L.evaluate(empty, [L.Rule("r", "unknown_name > 1", "{other}")]).first()["active"]


def test_disks(spark):
    schema = f"{CID} string, name string, rotational string, size_bytes bigint, fs_percent double, mount string, partitions array<struct<name:string,size_bytes:bigint,fs_percent:double,mount:string>>"
    d = spark.createDataFrame([("c", "sda", "SSD", 1000, None, None, [("sda1", 600, 92.0, "/")]), ("c", "sdb", "HDD", 2000, 85.0, "/data", []), ("c", "loop0", "N/A", 10, 99.0, "/l", [])], schema)
    assert {(r["name"], r["level"]) for r in K.capacity_warnings(d).collect()} == {("sda1", "Critical"), ("sdb", "Warning"), ("loop0", "Critical")}
    h = {r["id"]: r["size_bytes"] for r in K.storage_hierarchy(d).collect()}
    assert h == {"Total Storage": 3000, "disk_sda": 1000, "disk_sdb": 2000, "part_sda1": 600, "v_part_sdb": 2000}
    assert {(r["part"], r["size_bytes"]) for r in K.disk_breakdown(d).collect()} == {("sda_sda1", 600), ("sda_free", 400), ("sdb_vol", 2000)}


def test_specs_and_archives(spark, tmp_path):
    spec = "cpu_info: {'CPU(s)': 8}\nnuma_info: {numa_topology: {node0: 0-3, node1: 4-7}}\ndisk_info: {block_devices: [{name: sda, rotational: SSD, size_bytes: 10, partitions: [{name: sda1, size_bytes: 5, fs_usage: {percent: 92, mount: /}}]}]}"
    data = tmp_path / "attach_session_1"
    data.mkdir()
    (data / "spec_info.yaml").write_text(spec)
    (data / "sar_io.csv").write_text("junk\n# hostname;interval;timestamp;tps;rkB/s\nh;1;t0;5;2\n# hostname;interval;timestamp;tps;rkB/s\nh;1;t1;7;2\n")
    with tarfile.open(tmp_path / "host9.tar", "w") as t:
        t.add(data, "attach_session_1")
    m = A.archive_members(spark, str(tmp_path / "host9.tar"))
    assert {r["file"] for r in m.collect()} == {"spec_info.yaml", "sar_io.csv"}
    s = A.system_specs(m)
    assert A.topology(s).count() == 2 and A.devices(s).first()["partitions"][0]["fs_percent"] == 92
    io = A.sar(A.member_lines(m, "sar_io.csv"), "io")
    assert sorted((r["tps"], r["rkb_s"], r["await"]) for r in io.collect()) == [(5.0, 2.0, 0.0), (7.0, 2.0, 0.0)]


def test_sinks(spark, stacks, tmp_path):
    B.write_folded(stacks, str(tmp_path / "f"))
    back = X.folded(X.read_lines(spark, str(tmp_path / "f") + "/*/*.txt", F.lit("c")))
    assert {(r["stack"], r["weight"]) for r in back.collect()} == {(r["stack"], r["weight"]) for r in stacks.filter("stack like '%;%'").collect()}
    B.write_csv(B.symbol_stats_csv(G.symbol_hotspots(stacks).filter("false"), G.total_weight(stacks)), str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).columns == [CID, "symbol", "inclusive", "inclusive_pct", "leaf", "leaf_pct"]
    B.write_records(spark.createDataFrame([(0.125,)], "x double"), str(tmp_path / "r"))
    assert json.loads("".join(f.read_text() for f in (tmp_path / "r").glob("*.json")))["x"] == 0.12
    A.trace_schema("samples")
    stacks.select(F.lit(1).alias("id"), F.lit("x").alias("name")).limit(1).write.csv(str(tmp_path / "t"))
    assert A.trace_table(spark, str(tmp_path / "t"), "selected_events").first()["name"] == "x"


def test_stream(spark, tmp_path):
    from tracelake.streaming import series

    (tmp_path / "in").mkdir()
    rows = spark.createDataFrame([("c", "2024-01-01 00:00:01", "cycles", 10), ("c", "2024-01-01 00:00:02", "instructions", 5), ("c", "2024-01-01 00:00:15", "cycles", 3)], f"{CID} string, ts string, metric_type string, value bigint")
    rows.withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(f"{CID} string, ts timestamp, metric_type string, value bigint").parquet(str(tmp_path / "in"))
    q = series.cpi_stream(live).writeStream.format("memory").queryName("cpi").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["cycles"]: r["CPI"] for r in spark.table("cpi").collect()}
    assert got == {10: 2.0, 3: None}
