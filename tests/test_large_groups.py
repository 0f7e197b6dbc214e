"""Operators that must not hold a group whole: wide ranges, quantiles of hot groups, flame charts, archives, many equal places; and rule
conditions against Python."""

import io
import math
import random
import tarfile
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from tracelake.operators import CID
from tracelake.operators import callgraph as J
from tracelake.operators import collapse as FC
from tracelake.operators import layout as I
from tracelake.operators import samples as E
from tracelake.operators.conditions import condition
from tracelake.operators.quantiles import quantiles
from tracelake.sources import tables as A
from tracelake.sources import text as X


def test_ranges_of_any_width(spark):
    rng = random.Random(1)
    ranges = [("m", 0, 1 << 40, "wide", 1), ("m", -(1 << 62), 1 << 62, "all", 2), ("m", (1 << 40) - 1, (1 << 40) + 1, "edge", 3), ("n", 5, 6, "one", 4), ("n", 7, 7, "none", 5), ("m", -(1 << 63), (1 << 63) - 1, "most", 6)]
    ranges += [("m", a, a + rng.randint(1, 5000), "r", 10 + i) for i, a in enumerate(rng.sample(range(100_000), 60))]
    addresses = sorted({("m", rng.randrange(110_000)) for _ in range(300)} | {("m", 1 << 40), ("m", -5), ("m", -(1 << 63)), ("n", 5), ("n", 6), ("n", 7), ("x", 1)})
    r = spark.createDataFrame(ranges, "module string, low bigint, high bigint, file string, line int")
    got = J.resolve_lines(spark.createDataFrame(addresses, "module string, addr bigint"), r).collect()
    want = []
    for m, a in addresses:
        hit = sorted((lo, hi, f, n) for x, lo, hi, f, n in ranges if x == m and lo <= a < hi)
        if hit:
            want.append((m, a, hit[0][2], hit[0][3]))
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("share", [0.0, 0.5, 0.95, 1.0])
def test_quantiles_equal_numpy(spark, share):
    rng = np.random.default_rng(7)
    rows = [("hot", float(x), float(y)) for x, y in zip(rng.normal(size=900) * 1e3, rng.integers(-3, 3, 900), strict=True)]
    rows += [("zero", 0.0, None)] * 50 + [("one", 5.5, -1e300), ("odd", 1e-310, 1e300), ("odd", -1e-310, -1e300), ("odd", 0.0, 2.0), ("none", None, None), (None, 1.0, 1.0)]
    got = {r["k"]: (r["q_x"], r["q_y"]) for r in quantiles(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], ["x", "y"], share).collect()}
    assert set(got) == {"hot", "zero", "one", "odd"}
    for k, pair in got.items():
        for i, q in enumerate(pair):
            own = [r[i + 1] for r in rows if r[0] == k and r[i + 1] is not None]
            assert (q is None) == (not own) and (q is None or math.isclose(q, np.quantile(own, share), rel_tol=1e-9, abs_tol=1e-300)), (k, i)


def test_flame_charts_stitch_sorted_ranges(spark):
    """Blocks of a chart equal those of one pass over its stacks, however many ranges they are sorted into."""
    rng = random.Random(3)
    names = ["a", "b", "c"]
    rows = [(c, ";".join(rng.choice(names) for _ in range(rng.randint(1, 4))), rng.randint(1, 9), i) for c in ("x", "y") for i in range(160)]
    want = []
    for c in ("x", "y"):
        own = [(r[1].split(";"), r[2]) for r in sorted((r for r in rows if r[0] == c), key=lambda r: -r[3])]
        open_, at = [], 0
        for full, w in [*(([""] + f, w) for f, w in own), ([], 0)]:
            same = 0
            while same < min(len(open_), len(full)) and open_[same][0] == full[same]:
                same += 1
            want += [(c, n, d, s, at) for d, (n, s) in enumerate(open_) if d >= same]
            open_ = open_[:same] + [(n, at) for n in full[same:]]
            at += w
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        d = spark.createDataFrame(rows, f"{CID} string, stack string, weight bigint, ord int")
        got = I.layout(d, flamechart=True).select(CID, "name", "depth", "x_start", "x_end").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert sorted(map(tuple, got)) == sorted(want)


def test_equal_places_don_t_multiply(spark):
    n = 10_000
    d = spark.range(2 * n).select(F.lit("c").alias(CID), F.col("id").alias("ord"), F.lit("p").alias("symbol"), F.when(F.col("id") % 2 == 0, "cycles").otherwise("instructions").alias("event"), (F.col("id") + 1).alias("value"))
    paired = E.flat_wide(d, ["symbol"], pair="order")
    assert paired.count() == n and paired.filter("instructions <> cycles + 1").count() == 0
    assert [tuple(r)[2:4] for r in E.flat_wide(d, ["symbol"], pair="sum").collect()] == [(n * n, n * n + n)]
    with pytest.raises(ValueError):
        E.flat_wide(d, ["symbol"], pair="some")


def archive(path, members, mode="w"):
    with tarfile.open(path, mode) as t:
        for name, body in members:
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))


@pytest.mark.parametrize("mode", ["w", "w:gz"])
def test_archive_lines(spark, tmp_path, mode):
    path = tmp_path / ("h1.tar" if mode == "w" else "h1.tar.gz")
    archive(path, [("other/x", b"no"), ("./attach_session_2/a.csv", b"1\r\n2\n\n3"), ("attach_session_2/b/c.txt", b""), ("zz/y", b"no")], mode)
    got = A.archive_lines(spark, str(path)).select(CID, "file", "ord", "value").collect()
    assert sorted(map(tuple, got)) == [("h1", "a.csv", i, v) for i, v in enumerate(["1", "2", "", "3"])]


def test_members_larger_than_memory_are_streamed(tmp_path):
    """A member of 48 MB goes through with a small part of it in memory at a time."""
    path = tmp_path / "big.tar"
    line = b"x" * 2047 + b"\n"
    archive(path, [("d/big.txt", line * 24_000)])
    tracemalloc.start()
    rows = size = 0
    for chunk in A.line_chunks("c", str(path), lambda: open(path, "rb")):
        rows += len(chunk)
        size += sum(map(len, chunk["value"]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (rows, size) == (24_000, 24_000 * 2047) and peak < 24 << 20


def test_archive_without_data_folder():
    with pytest.raises(ValueError):
        A.data_folder("a.tar", ["x/1", "y/2"])


def test_folded_lines_without_limit_are_sorted_by_ranges(spark):
    s = spark.createDataFrame([("c", i, "p", 1, 0, "1", 5, "cycles", [("0", f"f{i % 7}", "d")]) for i in range(30)], f"{CID} string, ord int, command string, pid int, cpu int, time string, value bigint, event string, calls array<struct<addr:string,symbol:string,dso:string>>")
    out = FC.collapse_summary(s)
    plan = out["lines"]._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and [r["line"] for r in out["lines"].collect()] == sorted(f"p;f{i} {5 * n}" for i, n in zip(range(7), (5, 5, 4, 4, 4, 4, 4), strict=True))
    assert [r["line"] for r in FC.collapse_summary(s, limit=2)["lines"].collect()] == ["p;f0 25", "p;f1 25"]
    with pytest.raises(ValueError):
        FC.collapse_summary(s, limit=-1)


def test_text_forms_of_samples(spark):
    text = "   my  app\t 7/8 [001]  1.5:\t12  cpu/cycles/u:  rest of it\r\n\tff00 a (b) c (/x y (deleted))\r\n\tnot a frame\n [x] (skipped)\n|skip (x)\n#skip (x)\n  0x1f  op()  const (lib)\n\t12 (lib)\n"
    d = spark.createDataFrame([("c", 0, text)], f"{CID} string, ord int, value string")
    got = [tuple(r)[2:] for r in X.chain_samples(d).collect()]
    assert got == [("my app", 7, 8, 1, "1.5", 12, "cpu/cycles/u", [("ff00", "a (b) c", "/x y (deleted)"), ("", "[x]", "skipped"), ("0x1f", "op()  const", "lib"), ("", "12", "lib")])]
    flat = ["a b 1 [000] 2.25: 3 ev:u: ff  f (int)  g (lib)", "a 1 2.25: 3 ev: ff f (lib)", "a 1 [000] 2.25: ev: ff f (lib)", "a 1 [0] 2.25: 3 ev: ff (lib)", "", None]
    d = spark.createDataFrame([("c", i, x) for i, x in enumerate(flat)], f"{CID} string, ord int, value string")
    assert [tuple(r)[2:] for r in X.flat_samples(d).collect()] == [("a b", 1, 0, "2.25", 3, "ev:u", "ff", "f (int) g", "lib")]
    long = "x" * 200_000 + "\n" + "\ty" * 100_000 + "\n\tf z (y)"
    assert X.chain_samples(spark.createDataFrame([("c", 0, "p 1 1.0: e:\n" + long)], f"{CID} string, ord int, value string")).select(F.size("calls")).first()[0] == 1


ATOMS = ["x", "y", "s", "t", "b", "n", "gone", "1", "0", "2.5", "-1", "'ab'", "''", "None", "True", "False"]


def random_value(rng, depth=0):
    if depth > 2 or rng.random() < 0.25:
        return rng.choice(ATOMS)
    a, b, c = (random_value(rng, depth + 1) for _ in range(3))
    return rng.choice([f"({a} < {b})", f"({a} == {b})", f"({a} != {b})", f"({a} <= {b} < {c})", f"({a} in ({b}, {c}))", f"({a} not in [{b}, 's'])", f"({a} is None)", f"({a} is not None)", f"({a} + {b})", f"({a} / {b})", f"({a} % {b})", f"({a} in s)"])


def random_condition(rng, depth=0):
    if depth > 2 or rng.random() < 0.3:
        return random_value(rng)
    a, b, c = (random_condition(rng, depth + 1) for _ in range(3))
    return rng.choice([f"({a} and {b})", f"({a} or {b})", f"(not {a})", f"({a} or {b} or {c})", f"({a} if {b} else {c})"])


def test_conditions_equal_python(spark):
    """Random conditions hold where Python's own evaluation says so; what raises there is inactive."""
    schema = StructType([StructField("x", DoubleType()), StructField("y", LongType()), StructField("s", StringType()), StructField("t", StringType()), StructField("b", BooleanType()), StructField("n", DoubleType())])
    rows = [(1.0, 2, "ab", "abc", True, None), (0.0, 0, "", "x", False, None), (2.5, -1, "x", "ab", None, None), (None, 7, None, "", True, None)]
    rng = random.Random(5)
    texts = [random_condition(rng) for _ in range(120)] + ["x >", "f(x)", "x if b else s", "x == 1 == True", "y ** 2 == 4", "7 // y", "1 < x < 3 and gone", "b or gone", "gone or b", "[x]", "lambda: 1"]
    d = spark.createDataFrame(rows, schema)
    got = [d.select(*[F.coalesce(condition(t, schema), F.lit(False)) for t in texts[i : i + 40]]).collect() for i in range(0, len(texts), 40)]

    def holds(text, row):
        try:
            return bool(eval(text, {}, dict(zip("xystbn", row, strict=True))))
        except Exception:
            return False

    skip = {"f(x)", "[x]", "lambda: 1"}  # no plain expressions: inactive, whatever Python makes of them
    for r, row in enumerate(rows):
        for i, t in enumerate(texts):
            want = False if t in skip else holds(t, row)
            assert got[i // 40][r][i % 40] == want, (t, row, want)
