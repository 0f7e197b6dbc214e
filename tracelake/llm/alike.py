"""Near copies of vectors by cosine, found with small-world graphs of shards.

Equal vectors of a label are one class.  A label's classes are dealt by hash to shards of bounded size, and each shard is put into a
graph (`smallworld`), batch by batch.  A vector within half of the threshold's angle of a node joins that node's group instead of
becoming a node: all of a group are near copies of each other by the triangle inequality, so that a large group costs a node and its
links are counted, not listed.

Every pair of shards, and each shard with itself, is searched once: the nodes of the one are looked up in the graph of the other, all
that lie within the threshold's angle and the radii of both groups.  A beam that is still full of such nodes is doubled, and before
that all beams are until audits pass: known near copies (probes made from nodes at the threshold exactly, and what a scan finds for
some of the queries) are found at the target recall; beams as wide as the shard are scans.  Pairs of groups so near that all their
members link, by the angles, are counted whole; other ones are verified member by member in double precision.  Links between groups
are united to components; members follow their group.

Rows: vectors that are null, zero, or hold null or non-finite components, and those without a label, link with nothing and are their
own components; so do rows without a vec_id, whose component and `kept` are null.  Vectors of different lengths never link; repeated
rows link with each other; an empty table gives no rows; further columns are ignored."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import discard, stored
from tracelake.llm.near import components
from tracelake.llm.smallworld import SmallWorld, levels, loaded

SLACK = 1e-6  # angles of float32 cosines
GROUP = "label string, dim int, shard int, shards int, leader long, rep long, nodes array<long>, counts array<long>, angles array<double>, vectors binary, size long, radius double, graph binary"


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)  # so that no square overflows or vanishes
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def angle(cosine):
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def grouped(u: np.ndarray, half: float, links: int, width: int, seed: int) -> tuple[SmallWorld, np.ndarray, np.ndarray]:
    """The graph of the unit vectors that lead a group, those vectors' rows, and each row's leader (as a node of the graph)."""
    n = len(u)
    order = np.random.default_rng(seed).permutation(n)
    g = SmallWorld(np.empty(u.shape, np.float32), links)
    lead, of, level = np.empty(n, np.int64), np.empty(n, np.int64), levels(n, links, seed + 1)
    near = np.cos(half)
    at = 0
    while at < n:
        rows = order[at : at + max(64, min(512, g.size))]
        at += len(rows)
        q = u[rows].astype(np.float32)
        beams = g.descend(q, width) if g.size else []
        owner = np.full(len(rows), -1)
        if beams:
            ids, sim = beams[0]
            best = sim.argmax(1)
            best = ids[np.arange(len(rows)), best]
            exact = np.einsum("ij,ij->i", u[rows], u[lead[best]])
            owner = np.where(exact >= near, best, -1)
        own = u[rows] @ u[rows].T >= near
        new: list[int] = []
        for i in np.flatnonzero(owner < 0).tolist():
            before = [k for k, j in enumerate(new) if own[i, j]] if own[i].sum() > 1 else []
            if before:
                owner[i] = g.size + before[0]
            else:
                owner[i] = g.size + len(new)
                new.append(i)
        of[rows] = owner
        if new:
            nodes = g.size + np.arange(len(new))
            lead[nodes], g.x[nodes] = rows[new], q[new]
            g.add(nodes, level[rows[new]], [(i[new], s[new]) for i, s in beams])
    g.x = g.x[: g.size]
    return g, lead[: g.size], of


def build(key, rows: pd.DataFrame, half: float, links: int, width: int) -> pd.DataFrame:
    """A shard's groups, one row each, and its graph (with the groups' first rows in the order of its nodes)."""
    rows = rows.sort_values("node", ignore_index=True)
    v = np.array(rows["v"].tolist(), float)
    u = unit(v)
    g, lead, of = grouped(u, half, links, width, int(key[2]))
    off = angle(np.einsum("ij,ij->i", u, u[lead[of]]))
    off[lead] = 0.0
    node, rep, count = (rows[c].to_numpy() for c in ("node", "rep", "count"))
    order = np.lexsort((np.arange(len(of)) != lead[of], of))  # the leader first
    parts = np.split(order, np.cumsum(np.bincount(of, minlength=g.size))[:-1])
    out = [
        (*key, int(rows["shards"][0]), int(node[p[0]]), int(rep[p].min()), node[p].tolist(), count[p].tolist(), off[p].tolist(), v[p].tobytes(), int(count[p].sum()), float(off[p].max()), None)
        for p in parts
    ]
    columns = [x.split()[0] for x in GROUP.split(", ")]
    whole = (*key, int(rows["shards"][0]), None, None, node[lead].tolist(), count_of(parts, count), [float(off[p].max()) for p in parts], v[lead].tobytes(), None, None, g.dump())
    return pd.DataFrame([*out, whole], columns=columns).astype({"leader": "Int64", "rep": "Int64", "size": "Int64"})


def count_of(parts: list[np.ndarray], count: np.ndarray) -> list[int]:
    """Vectors of each group; a group of several classes as a negative number, as its links need its members."""
    return [int(count[p].sum()) * (1 if len(p) == 1 else -1) for p in parts]


def audited_width(g: SmallWorld, q: np.ndarray, least: np.ndarray, cosine: float, width: int, target: float, seed: int = 3, some: int = 128) -> int:
    """The first doubled width at which probes and some of the queries find what a scan finds."""
    rng = np.random.default_rng(seed)
    x = g.x[rng.choice(g.size, min(some, g.size), replace=False)]
    side = rng.standard_normal(x.shape).astype(np.float32)
    side -= np.einsum("ij,ij->i", side, x)[:, None] * x
    norm = np.linalg.norm(side, axis=1, keepdims=True)
    probes = np.float32(cosine) * x + np.float32(np.sqrt(1 - cosine**2)) * side / np.where(norm > 0, norm, 1)
    pick = rng.choice(len(q), min(some, len(q)), replace=False)
    asked = np.concatenate([probes, q[pick]])
    bound = np.concatenate([np.full(len(x), cosine - 1e-5, np.float32), least[pick]])
    true = (asked @ g.x.T >= bound[:, None]).sum(1)
    while width < g.size:
        _, sim = g.search(asked, width)
        found = (sim >= bound[:, None]).sum(1)
        full = found >= min(width, g.size)  # widened by itself later
        if found[~full].sum() >= target * true[~full].sum():
            break
        width *= 2
    return width


def lookup(g: SmallWorld, q: np.ndarray, least: np.ndarray, cosine: float, width: int, target: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of the nodes found whose cosine with the query is at least its bound."""
    width, todo, rows, nodes = audited_width(g, q, least, cosine, width, target), np.arange(len(q)), [], []
    while len(todo):
        if width >= g.size:
            for i in range(0, len(todo), 512):
                at = todo[i : i + 512]
                r, c = np.nonzero(q[at] @ g.x.T >= least[at, None])
                rows.append(at[r])
                nodes.append(c)
            break
        ids, sim = g.search(q[todo], width)
        hit = sim >= least[todo, None]
        full = hit.all(1)
        r, c = np.nonzero(hit & ~full[:, None])
        rows.append(todo[r])
        nodes.append(ids[r, c])
        todo, width = todo[full], 2 * width
    return (np.concatenate(rows), np.concatenate(nodes)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a with the same row of b, in double precision."""
    a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
    return (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))


def seek(ask: pd.DataFrame, held: pd.DataFrame, cosine: float, width: int, target: float) -> pd.DataFrame:
    """Pairs of groups of two shards that may link: whether all of their members do (`sure`) or members must be compared."""
    columns = ["a", "b", "size_a", "size_b", "sure"]
    if ask.empty or held.empty:
        return pd.DataFrame({c: [] for c in columns})
    theta = float(np.arccos(cosine))
    one, two = ask.iloc[0], held.iloc[0]
    dim = int(one["dim"])
    va, vb = (np.frombuffer(s["vectors"], float).reshape(-1, dim) for s in (one, two))
    ra, rb = (np.array(s["angles"]) for s in (one, two))
    na, nb = (np.array(s["counts"]) for s in (one, two))
    ids_a, ids_b = (np.array(s["nodes"]) for s in (one, two))
    ua, ub = unit(va), unit(vb)
    g = loaded(two["graph"], ub.astype(np.float32))
    least = np.cos(np.minimum(theta + ra + rb.max() + 1e-3, np.pi)).astype(np.float32)
    i, j = lookup(g, ua.astype(np.float32), least, cosine, width, target)
    if one["shard"] == two["shard"]:  # either may have found the other
        both = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)], 1)[i != j], axis=0)
        i, j = both[:, 0], both[:, 1]
    exact = cosines(va[i], vb[j]) if len(i) else np.empty(0)
    apart = angle(exact)
    lone = (na[i] > 0) & (nb[j] > 0)  # one class each: decided here
    sure = np.where(lone, exact >= cosine, apart + ra[i] + rb[j] <= theta - SLACK)
    may = np.where(lone, sure, apart <= theta + ra[i] + rb[j] + SLACK)
    i, j, sure = i[may], j[may], sure[may]
    return pd.DataFrame({"a": ids_a[i], "b": ids_b[j], "size_a": np.abs(na[i]), "size_b": np.abs(nb[j]), "sure": sure})


def compared(rows: pd.DataFrame, cosine: float, block: int = 1024) -> pd.DataFrame:
    """How many vectors of the other group each member of two groups links with; a row (a, b, null) for groups that link at all."""
    theta, r = float(np.arccos(cosine)), rows.iloc[0]
    va, vb = (np.frombuffer(r[f"vectors_{s}"], float).reshape(len(r[f"nodes_{s}"]), -1) for s in "ab")
    na, nb = (np.array(r[f"counts_{s}"]) for s in "ab")
    ua, ub = unit(va), unit(vb)
    # The angle to the other leader and that group's radius tell what links with all of it.
    all_of_b = angle(ua @ ub[0]) + float(max(r["angles_b"])) <= theta - SLACK
    got_a, got_b = np.where(all_of_b, nb.sum(), 0), np.full(len(nb), na[all_of_b].sum())
    for i in range(0, len(ua), block):
        at = np.flatnonzero(~all_of_b[i : i + block]) + i
        if len(at):
            c = ua[at] @ ub.T
            near = c >= cosine
            p, q = np.nonzero(np.abs(c - cosine) < 1e-9)  # too close to call by a product of rounded units
            near[p, q] = cosines(va[at[p]], vb[q]) >= cosine
            got_a[at] += near @ nb
            got_b += na[at] @ near
    out = [(n, None, x) for ids, got in ((r["nodes_a"], got_a), (r["nodes_b"], got_b)) for n, x in zip(ids, got.tolist(), strict=True) if x]
    if out:
        out.append((r["a"], r["b"], None))
    return pd.DataFrame(out, columns=["node", "to", "links"]).astype("Int64")


def near_vectors(embeddings: DataFrame, cosine: float = 0.93, shard_rows: int = 4096, links: int = 16, width: int = 32, target: float = 0.99, vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: how many other vectors of its label lie within the cosine, and the smallest
    vec_id that such links reach.  shard_rows bounds what a task holds of vectors; more of them make fewer pairs of shards."""
    if not 0 < cosine < 1:
        raise ValueError("the cosine is between 0 and 1")
    v = F.col(vector).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    good = F.coalesce(good, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = embeddings.select(F.col("vec_id").cast("long"), F.when(good, F.col("label").cast("string")).alias("label"), F.when(good, v).alias("v"))
    classes = rows.filter("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("count"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("node"), "label", F.size("v").alias("dim"), "v", "rep", "count"))
    shards = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    dealt = classes.join(shards, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))
    half = float(np.arccos(cosine)) / 2 - SLACK

    def shard_of(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return build(key, pdf, half, links, width)

    built = stored(dealt.groupBy("label", "dim", "shard").applyInPandas(shard_of, GROUP))
    groups = built.filter("graph is null")
    # Each pair of shards once, either way by turns, so that all shards are asked as often.
    graphs = built.filter("graph is not null").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    asks = (F.col("shard") <= F.col("other")) == ((F.col("shard") + F.col("other")) % 2 == 0)
    asked = graphs.filter(asks).select("label", "dim", F.col("shard").alias("from"), F.col("other").alias("to"), "shard", "nodes", "counts", "angles", "vectors")
    held = graphs.filter(~asks | (F.col("shard") == F.col("other"))).select("label", "dim", F.col("other").alias("from"), F.col("shard").alias("to"), "shard", "nodes", "counts", "angles", "vectors", "graph")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return seek(left, right, cosine, width, target)

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        return compared(pdf, cosine)

    keys = ("label", "dim", "from", "to")
    met = stored(asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(search, "a long, b long, size_a long, size_b long, sure boolean"))
    sure = met.filter("sure")
    side = [groups.select(F.col("leader").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("nodes", "counts", "angles", "vectors")]) for s in "ab"]
    pairs = met.filter("not sure").select("a", "b").join(side[0], "a").join(side[1], "b")
    checked = stored(pairs.groupBy("a", "b").applyInPandas(verify, "node long, `to` long, links long"))
    edges = sure.select("a", "b").union(checked.filter("`to` is not null").select("node", "to"))
    comp = components(edges).select(F.col("node").alias("leader"), "comp")

    whole = sure.select(F.col("a").alias("leader"), F.col("size_b").alias("n")).union(sure.select("b", "size_a")).groupBy("leader").agg(F.sum("n").alias("whole"))
    led = groups.select("leader", "rep", "size", F.explode("nodes").alias("node"))
    ends = groups.select("leader", "rep").join(comp, "leader", "left").select("leader", "rep", F.coalesce("comp", "leader").alias("comp"))
    least = ends.groupBy("comp").agg(F.min("rep").alias("component_id"))
    part = checked.filter("links is not null").groupBy("node").agg(F.sum("links").alias("part"))
    total = led.join(whole, "leader", "left").join(ends.join(least, "comp").select("leader", "component_id"), "leader").join(part, "node", "left")
    n = F.col("size") - 1 + F.coalesce("whole", F.lit(0)) + F.coalesce("part", F.lit(0))
    found = stored(classes.join(total.select("node", n.alias("n_links"), "component_id"), "node").select("label", "v", "n_links", "component_id"))
    discard(classes, built, met, checked)
    out = rows.join(found, ["label", "v"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
