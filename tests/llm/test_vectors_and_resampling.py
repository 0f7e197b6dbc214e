"""Vector codes, importance resampling and near copies of vectors: small inputs with nulls, ties, repeated rows, odd numbers and no rows
at all, against brute-force statements of the contract."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tracelake.llm import alike, codes, resample, smallworld
from tracelake.llm import queries as Q

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int, node long, row long, leader long, v int"
TEXTS = "doc_id long, text string, row long, score double, rank int, doc string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, 2, 3, 4) for i, v, lab in rows], VECTORS)


def odd_vectors():
    nan, inf = float("nan"), float("inf")
    return [(900, None, 1), (901, [], 1), (902, [nan] * 4, 1), (903, [1.0, inf, 0.0, 0.0], 1), (904, [1.0, None, 0.0, 0.0], 1)]


# Codes -----------------------------------------------------------------------------------------------------------------------


def brute_codes(rows, parts=4, entries=256, rounds=4):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(1024 * __import__("fractions").Fraction(x)) for x in v] for _, v, _ in rows]
    size = len(whole[0]) // parts
    books = [[w[p * size : (p + 1) * size] for w in whole[:entries]] for p in range(parts)]

    def nearest(p, w):
        x = w[p * size : (p + 1) * size]
        d = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            of = defaultdict(list)
            for w in whole:
                of[nearest(p, w)[0]].append(w[p * size : (p + 1) * size])
            for k, own in of.items():
                books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out, by = [], Counter()
    for (i, _, lab), w in zip(rows, whole, strict=True):
        got = [nearest(p, w) for p in range(parts)]
        err = sum(d for _, d in got)
        by[lab] += err
        out.append((i, "".join(f"{k:02x}" for k, _ in got), err, lab))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted([(i, c, e, by[lab], sha) for i, c, e, lab in out], key=repr)


@pytest.mark.parametrize("scale", [1.0, 3e5, 1e30])
def test_codes_equal_brute_force(spark, scale):
    rng = np.random.default_rng(4)
    rows = [(int(i), (rng.normal(size=8).round(2) * scale).tolist(), [1, 2, None][i % 3]) for i in rng.permutation(60)]
    rows += [(7, rows[0][1], 1), (7, [0.0] * 8, 2), (None, [-0.5 * scale] * 8, 1), (200, rows[3][1], None)]
    df = vectors(spark, [*rows, *odd_vectors(), (905, [1.0] * 4, 1), (906, [1.0] * 7, 1)])
    got = [tuple(r) for r in codes.vector_codes(df, entries=9, rows=16).collect()]
    want = brute_codes(rows, entries=9)
    if scale == 1e30:  # errors beyond 64 bits are null
        assert any(e is None for _, _, e, _, _ in got)
        want = [(i, c, e if e < 1 << 63 else None, x if x < 1 << 63 else None, sha) for i, c, e, x, sha in want]
        got = [(i, c, e, x if x is not None else None, sha) for i, c, e, x, sha in got]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_codes_without_rows_and_with_few(spark):
    assert codes.vector_codes(vectors(spark, [])).collect() == []
    assert codes.vector_codes(vectors(spark, odd_vectors())).collect() == []
    rows = [(1, [0.5, 0.25, 0.0, -0.001], None)]
    assert [tuple(r) for r in codes.vector_codes(vectors(spark, rows)).collect()] == brute_codes(rows)


def test_limbs_and_whole_numbers():
    for x in (0, 1, -1, 2**31, -(2**31), 2**95 + 5, -(2**95) - 5):
        assert sum(d << codes.LIMB * i for i, d in enumerate(codes.limbs(x))) == x
    v = np.array([[0.5, -0.0001, 1e300, -1e17]])
    assert codes.whole(v, 1024).tolist() == [[512, -1, 1024 * int(1e300), -1024 * int(1e17)]]


@pytest.mark.parametrize("name", ["op11_value_dictionaries", "op12_importance_resampling"])
def test_sql_says_the_same(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = Q.queries()[name](spark, SF)
    want = con.execute(Q.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


# Resampling ------------------------------------------------------------------------------------------------------------------


def brute_resample(rows, target, longest=1, n=10_000, percent=10, least=20):
    def feats(t):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % n for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    own, other = [feats(t) for _, t in rows], Counter(b for t in target for b in feats(t)[1])
    corpus = Counter(b for _, f in own for b in f)
    s, t = sum(corpus.values()), sum(other.values())
    out = []
    for (i, _), (words, f) in zip(rows, own, strict=True):
        g = [math.floor(1000 * math.log((other[b] + 1) * (s + n) / ((corpus[b] + 1) * (t + n)))) for b in f]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = defaultdict(list)
    for k, r in enumerate(able, 1):
        ranks[r].append(k if k <= len(able) * percent // 100 else None)
    return sorted([(*r[:4], ranks[r].pop(0) if ranks[r] else None) for r in out], key=repr)


@pytest.mark.parametrize("longest", [1, 2])
def test_resampling_equals_brute_force(spark, longest):
    rng = np.random.default_rng(2)
    words = ["Alpha", "beta", "gamma-delta", "été", "x1", "中文", "ab.cd", "Ω", "É"]
    rows = [(int(i), " ".join(rng.choice(words, rng.integers(0, 60)))) for i in range(300)]
    rows += [(400, None), (401, ""), (None, "beta " * 30), (None, "beta " * 30), (5, rows[5][1]), *[(500, "alpha " * 25)] * 40, (501, "x" * 5000 + " a" * 3000)]
    target = ["alpha beta alpha", None, "x1 x1 été"]
    df = spark.createDataFrame([(i, t, 1, 2.0, 3, "d") for i, t in rows], TEXTS).repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(df.drop("row"), goal, longest, percent=30).drop("row").collect()
    assert sorted(map(tuple, got), key=repr) == brute_resample(rows, target, longest, percent=30)
    if longest == 1:
        drawn = resample.drawn_documents(df, goal, percent=30)
        want = Counter(i for i, *_, k in brute_resample(rows, target, percent=30) if k)
        assert drawn.columns == df.columns and Counter(r["doc_id"] for r in drawn.collect()) == want


def test_resampling_without_rows(spark):
    none, some = spark.createDataFrame([], TEXTS), spark.createDataFrame([(1, "a b", 1, 1.0, 1, "d")], TEXTS)
    assert resample.resample_digest(none, some).collect() == []
    assert [tuple(r) for r in resample.resample_digest(some, none).collect()] == brute_resample([(1, "a b")], [])


@pytest.mark.parametrize("segments", [1, 3, 50])
@pytest.mark.parametrize("samples", [2, 16])
def test_ranks_of_hot_and_distinct_keys(spark, segments, samples):
    from pyspark.sql import functions as F

    from tracelake.llm.common import stored

    rng = np.random.default_rng(segments)
    keys = np.concatenate([np.zeros(700, int), rng.integers(-(2**62), 2**62, 300)])
    rows = [(int(k), i) for i, k in enumerate(rng.permutation(keys))]
    df = stored(spark.createDataFrame(rows, "a long, b long").repartition(7))
    want = {r: k for k, r in enumerate(sorted(rows), 1)}
    for draw in (0, 1, 437, 1000):
        got = resample.ranked(df, [F.col("a"), F.col("b")], draw, samples=samples, segments=segments).collect()
        assert {(r["a"], r["b"]): r["rank"] for r in got} == {k: n if n <= draw else None for k, n in want.items()}


def test_segments_stay_even_where_keys_are_equal():
    """Splitters cut by all of a key, so that equal scores do not share a segment."""
    keys = resample.packed([np.zeros(1000, np.int64), np.arange(1000)])
    assert (np.sort(keys) == keys).all() and len(np.unique(keys)) == 1000
    few = [-(2**63), -5, -1, 0, 1, 255, 256, 2**63 - 1]
    assert (np.argsort(resample.packed([np.array(few)])) == np.arange(len(few))).all()


# Near copies of vectors ------------------------------------------------------------------------------------------------------


def brute_alike(rows, cosine):
    n = len(rows)
    ok = [i is not None and lab is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, v, lab in rows]
    links, comp = [0] * n, list(range(n))

    def top(a):
        while comp[a] != a:
            a = comp[a]
        return a

    for a in range(n):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if (x * y).sum() / math.sqrt((x * x).sum() * (y * y).sum()) >= cosine:
                    links[a] += 1
                    links[b] += 1
                    comp[top(a)] = top(b)
    least = {}
    for a in range(n):
        if ok[a]:
            least[top(a)] = min(least.get(top(a), 1 << 62), rows[a][0])
    ids = [least[top(a)] if ok[a] else rows[a][0] for a in range(n)]
    return sorted([(r[0], links[a], ids[a], None if r[0] is None else r[0] == ids[a]) for a, r in enumerate(rows)], key=repr)


@pytest.mark.parametrize("shard_rows", [4096, 40])
def test_near_vectors_equal_brute_force(spark, shard_rows):
    rng = np.random.default_rng(6)
    rows, seeds = [], rng.normal(size=(12, 16))
    for i in range(330):
        noise = [0.02, 0.12, 0.2, 0.3][i % 4]
        v = seeds[0 if i % 3 == 0 else i % 12] + noise * rng.normal(size=16)  # a third in one group
        rows.append((i, (v * rng.choice([1.0, 1e-200, 1e200])).tolist(), [1, 1, 1, 2][i % 4 if i % 3 else 0]))
    rows += [(500, rows[0][1], 1), (501, rows[0][1], 1), (501, rows[0][1], 2), (501, rows[4][1], 1), (502, [1.0, 2.0], 1), (503, [2.0, 4.0], 1), (504, [0.0] * 16, 1), (505, rows[0][1], None), (None, rows[0][1], 1), (None, None, 1)]
    rows += odd_vectors()
    got = alike.near_vectors(vectors(spark, rows), shard_rows=shard_rows, width=8).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == brute_alike(rows, 0.93)


def test_near_vectors_at_the_threshold(spark):
    """Pairs a hair to either side of the cosine, and chains."""
    c = 0.8
    rows = [(1, [1.0, 0.0, 0.0], 1), (2, [c, 0.6, 0.0], 1), (3, [c - 1e-9, math.sqrt(1 - (c - 1e-9) ** 2), 0.0], 1), (4, [0.0, 0.0, 1.0], 1), (5, [0.0, 0.59999, 0.80001], 1)]
    got = alike.near_vectors(vectors(spark, rows), cosine=c).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == brute_alike(rows, c)
    assert alike.near_vectors(vectors(spark, [])).collect() == []


def test_graph_search_and_audit():
    rng = np.random.default_rng(1)
    u = alike.unit(rng.normal(size=(1500, 24)))
    g, lead, of = alike.grouped(u, 0.05, 8, 24, 0)
    assert sorted(np.unique(of)) == list(range(g.size)) and (of[lead] == np.arange(g.size)).all()
    assert len(g.nbr) > 1 and ((g.nbr[0] >= 0).sum(1) > 0).all()
    again = smallworld.loaded(g.dump(), g.x)
    q = u[:200].astype(np.float32)
    ids, sim = again.search(q, 40)
    near = np.argsort(-(q @ g.x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids, near, strict=True)]) > 0.85
    assert all(len(set(r[r >= 0])) == (r >= 0).sum() for r in ids)
    # A crowd wider than the first beam is found whole.
    r, c = alike.lookup(g, q, np.full(200, 0.3, np.float32), 0.93, 8, 0.99)
    true = {(i, j) for i, j in zip(*np.nonzero(q @ g.x.T >= 0.3), strict=True)}
    assert len(true & set(zip(r.tolist(), c.tolist(), strict=True))) >= 0.95 * len(true) and len(set(zip(r, c, strict=True))) == len(r)


def test_audit_widens_the_beam():
    rng = np.random.default_rng(3)
    u = alike.unit(rng.normal(size=(900, 32)))
    g, _, _ = alike.grouped(u, 0.01, 4, 8, 0)
    g.nbr[0][:, 2:] = -1  # a poor graph: narrow beams lose nodes
    q = u[:64].astype(np.float32)
    width = alike.audited_width(g, q, np.full(64, 0.9, np.float32), 0.9, 2, 0.999)
    assert width > 2
    r, c = alike.lookup(g, q, np.full(64, 0.99, np.float32), 0.9, 2, 0.999)
    assert len(r) >= 63


@pytest.fixture(scope="module")
def planted():
    """Near copies over several shards of one label: recall against a scan."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(1200, 32))
    copies = base[rng.integers(0, 1200, 400)] + 0.2 * rng.normal(size=(400, 32))
    return [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([base, copies]))]


def test_recall_of_near_vectors(spark, planted):
    got = {r["vec_id"]: r["n_links"] for r in alike.near_vectors(vectors(spark, planted), shard_rows=300, width=16).collect()}
    u = alike.unit(np.array([v for _, v, _ in planted]))
    true = (u @ u.T >= 0.93).sum(1) - 1
    assert sum(got.values()) >= 0.99 * true.sum() > 0 and all(got[i] <= n for i, n in enumerate(true.tolist()))
