"""Approximate nearest neighbours by balanced posting lists.

The number of lists follows the number of rows, up to a bound.  Their centroids come from balanced k-means over a bounded sample, in two
levels: the sample's cells are split in proportion to what they hold.  Every vector is posted to its nearest centroid's list and, near a
boundary, to the lists of further centroids; lists beyond a length are cut into parts, so that no task holds an unbounded list, and
shorter ones, which stand in the order of their cells, are read in blocks, so that a query has k rows for a block and not for a list.
A block's distances to all its queries come from one product of matrices, with a bound of its error; what may be among the k nearest
by that is measured exactly.
A query walks a neighbour graph of the centroids in memory and takes all lists whose centroid is at most e times a distance
farther than the nearest one, that distance being the nearest one's, or the sample's median where that is more (so that a query
on a centroid looks around, too); e is calibrated on the sample so that a target share of true neighbours is posted there.  Where
these lists hold too few ids, the next nearest ones are taken, so that a query has k neighbours wherever there are k candidates.

Rows: a null vec_id takes no part; vectors that are null, zero, of another length than most, or that hold a null or a non-finite component take no part;
repeated rows are candidates each under their id (a repeated id counts once, with its smallest distance); an empty table gives no
rows; further columns are ignored."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import map_slices, stored


@dataclass
class Lists:
    centroids: np.ndarray
    graph: list[list[int]]  # each centroid's nearest ones, and those that it is nearest to
    reach: float  # e
    floor: float  # the least distance that e is a multiple of
    spread: float  # a vector is posted to centroids at most (1 + spread) times as far as its nearest
    copies: int
    tops: np.ndarray  # centroids of the cells, and each cell's centroids, filled up with -1
    held: np.ndarray
    probe: int = 8  # cells in which a vector's nearest centroids are sought

    def nearest(self, x: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """The m nearest centroids of each row, and their distances, from the nearest cells."""
        cells = np.argpartition(distances(x, self.tops), min(self.probe, len(self.tops)) - 1, axis=1)[:, : self.probe]
        of = self.held[cells].reshape(len(x), -1)
        d = np.full((len(x), *self.held[cells].shape[1:]), np.inf)
        for t in np.unique(cells):
            row, at = np.nonzero(cells == t)
            own = self.held[t][self.held[t] >= 0]
            d[row, at, : len(own)] = distances(x[row], self.centroids[own])
        d = d.reshape(len(x), -1)
        near = np.argpartition(d, min(m, d.shape[1]) - 1, axis=1)[:, :m]
        return np.take_along_axis(of, near, 1), np.take_along_axis(d, near, 1)

    def posts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list) of every posting, and whether it is the row's first, in a list whose centroid is nearest."""
        some = [self.nearest(x[i : i + 2048], self.copies) for i in range(0, len(x), 2048)]
        near, dn = (np.concatenate(a) for a in zip(*some, strict=True))
        keep = dn <= (1 + self.spread) * dn.min(1, keepdims=True) + 1e-12
        row, col = np.nonzero(keep & np.isfinite(dn))
        return row, near[row, col], col == dn.argmin(1)[row]

    def extent(self, best):
        return best + self.reach * np.maximum(best, self.floor) + 1e-12

    def lists_for(self, q: np.ndarray, held: np.ndarray, least: int) -> list[int]:
        """All lists within reach, by a walk over the graph: nearest first, as long as a centroid in reach or nearer than the
        best of the walk is left; and the next nearest lists, until together they hold `least` ids."""
        seen = set(range(0, len(self.centroids), max(1, len(self.centroids) // 8)))
        entry = np.fromiter(seen, np.int64)
        heap = list(zip(np.sqrt(((self.centroids[entry] - q) ** 2).sum(1)).tolist(), entry.tolist(), strict=True))
        heapq.heapify(heap)
        best, got, idle = heap[0][0], [], 0
        while heap:
            d, c = heapq.heappop(heap)
            best = min(best, d)
            if d <= self.extent(best):
                got.append((d, c))
                idle = 0
            else:
                idle += 1
                if idle > 64:
                    break
            new = [x for x in self.graph[c] if x not in seen]
            if new:
                seen.update(new)
                for e, x in zip(np.sqrt(((self.centroids[new] - q) ** 2).sum(1)).tolist(), new, strict=True):
                    heapq.heappush(heap, (e, x))
        out = {c for d, c in got if d <= self.extent(best)}
        n = held[list(out)].sum()
        if n < least:
            for c in np.argsort(((self.centroids - q) ** 2).sum(1), kind="stable").tolist():
                if c not in out:
                    out.add(c)
                    n += held[c]
                    if n >= least:
                        break
        return sorted(out)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0))


def balanced_means(x: np.ndarray, k: int, turns: int = 8, seed: int = 5) -> np.ndarray:
    """k centroids; being in a full cluster costs extra, so that sizes stay alike."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)  # copies must not draw several centroids
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    size = np.full(k, len(x) / k)
    for _ in range(turns):
        d = distances(x, c) ** 2
        own = (d + 0.3 * np.median(d.min(1)) * (size / size.mean() - 1)).argmin(1)
        size = np.bincount(own, minlength=k).astype(float)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        full = size > 0
        c[full] = total[full] / size[full, None]
        c[~full] = x[rng.choice(len(x), (~full).sum())]
    return c


def two_levels(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells' centroids, each cell's centroids, all centroids): a cell gets as many of the k as its share of the rows asks for."""
    tops = balanced_means(x, int(np.ceil(np.sqrt(k))))
    of = np.concatenate([distances(x[i : i + 4096], tops).argmin(1) for i in range(0, len(x), 4096)])
    c, held = [], []
    for t in range(len(tops)):
        own = x[of == t]
        if len(own):
            c.append(balanced_means(own, max(1, round(k * len(own) / len(x)))))
        held.append(len(own) and len(c[-1]))
    full = np.full((len(tops), max(held)), -1)
    full[np.arange(full.shape[1])[None] < np.array(held)[:, None]] = np.arange(sum(held))
    return tops, full, np.concatenate(c)


def neighbours_of(c: np.ndarray, q: np.ndarray, m: int) -> np.ndarray:
    """The m nearest of c to each row of q, nearest first, in blocks."""
    out = []
    for i in range(0, len(q), 64):
        d = distances(q[i : i + 64], c)
        near = np.argpartition(d, min(m, len(c)) - 1, axis=1)[:, :m]
        out.append(np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out)


def in_blocks(counts: np.ndarray, longest: int, a_block: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each list, and in how many parts each block is read: consecutive lists of up to `a_block` rows together, or one
    of more than `longest`, which is cut."""
    block, rows, parts = np.zeros(len(counts), np.int32), 0, [1]
    for i, n in enumerate(counts.tolist()):
        if i and (n > longest or parts[-1] > 1 or rows + n > a_block):
            parts.append(1)
            rows = 0
        block[i], rows = len(parts) - 1, rows + n
        if n > longest:
            parts[-1] = -(-n // longest)
    return block, np.array(parts, np.int32)


def within(x: np.ndarray, ids: np.ndarray, lst: np.ndarray, q: np.ndarray, qid: np.ndarray, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance) of the k nearest ids of each query among the rows x in lists that it wants (queries x lists), but its own."""
    most = min(k * int(np.unique(ids, return_counts=True)[1].max()), len(x))  # rows that hold k ids
    qs, found, far = [], [], []
    for i in range(0, len(q), 64):
        some = q[i : i + 64]
        with np.errstate(over="ignore", invalid="ignore"):
            xx = (x * x).sum(1) if i == 0 else xx
            size = xx[None] + (some * some).sum(1)[:, None]
            square, slack = size - 2 * some @ x.T, 4 * (x.shape[1] + 4) * np.finfo(float).eps * size
            low, high = square - slack, square + slack
        unsure = ~np.isfinite(size)  # beyond what can be squared: measured exactly
        low[unsure], high[unsure] = -np.inf, np.inf
        out = ~wanted[i : i + 64][:, lst] | (ids[None] == qid[i : i + 64, None])
        high[out] = np.inf
        limit = np.partition(high, most - 1, axis=1)[:, most - 1]
        for j in range(len(some)):
            at = np.flatnonzero((low[j] <= limit[j]) & ~out[j])
            with np.errstate(over="ignore"):
                d = np.sqrt(((x[at] - some[j]) ** 2).sum(1))
            at, d = at[np.isfinite(d)], d[np.isfinite(d)]
            order = np.lexsort((ids[at], d))
            first = order[np.sort(np.unique(ids[at][order], return_index=True)[1])][:k]  # only the nearest row of an id counts
            qs.append(np.full(len(first), qid[i + j]))
            found.append(ids[at[first]])
            far.append(d[first])
    return np.concatenate(qs), np.concatenate(found), np.concatenate(far)


def fit_lists(sample: np.ndarray, lists: int | None = None, spread: float = 0.05, copies: int = 2, target: float = 0.99, k: int = 10) -> Lists:
    tops, held, c = two_levels(sample, max(1, lists or len(sample) // 100))
    near = neighbours_of(c, c, 25)
    graph: list[set[int]] = [set(row) - {i} for i, row in enumerate(near.tolist())]
    for i, row in enumerate(near.tolist()):
        for j in row:
            if j != i:
                graph[j].add(i)  # both ways, so that no centroid is out of the walk's reach
    out = Lists(c, [sorted(g) for g in graph], 0.0, 0.0, spread, copies, tops, held)
    sample = np.unique(sample, axis=0)  # copies of one vector must not decide the reach
    sample = sample[np.random.default_rng(9).permutation(len(sample))]
    some = np.linspace(0, len(sample) - 1, min(len(sample), 400)).astype(int)
    dq = distances(sample[some], c)
    out.floor = float(np.median(dq.min(1)) or np.median(dq) or 1.0)
    row, lst, _ = out.posts(sample)
    of: dict[int, list[int]] = {}
    for r, v in zip(row.tolist(), lst.tolist(), strict=True):
        of.setdefault(r, []).append(v)
    true = neighbours_of(sample, sample[some], k + 1)[:, 1:]
    need = [(dq[i, of[j]].min() - dq[i].min()) / max(dq[i].min(), out.floor) for i in range(len(some)) for j in true[i].tolist()]
    out.reach = float(max(0.0, np.quantile(need, target))) if need else 0.0
    return out


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows with a vector that takes part, as array<double>."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall(v, lambda x: x == 0)
    return df.select("vec_id", v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & ~zero)


def nearest(embeddings: DataFrame, k: int = 10, every: int = 100, a_list: int = 100, most_lists: int = 16_384, sample: int = 20_000, a_centroid: int = 20, longest: int = 2000, vector: str = "embedding", most_asked: int = 4000, a_block: int = 16_384) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each row whose id is divisible by `every`.

    There is a list for every `a_list` rows, up to `most_lists`; they are fitted on `sample` rows, or on `a_centroid` for each list
    where that is more."""
    spark = embeddings.sparkSession
    good = usable(embeddings, vector)
    sized = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = sized[0]["d"] if sized else 0
    good = good.filter(F.size("v") == dim)
    lists = int(np.clip(sized[0]["count"] // a_list, 1, most_lists)) if sized else 0
    some = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(sample, a_centroid * lists)).select("v").toArrow().column("v") if dim else []
    schema = "query_id long, rank int, vec_id long, score double"
    if not len(some):
        return spark.createDataFrame([], schema)
    index = fit_lists(some.combine_chunks().flatten().to_numpy().reshape(-1, dim), lists, k=k)
    shared = spark.sparkContext.broadcast(index)

    def post(b):
        x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        row, lst, home = shared.value.posts(x)
        ids = b.column("vec_id").to_numpy()
        return {"list": lst.astype(np.int32), "home": home, "vec_id": ids[row], "v": list(x[row])}

    postings = stored(map_slices(good.select(F.col("vec_id").cast("long"), "v"), post, "list int, home boolean, vec_id long, v array<double>", 2048))
    # Lengths of the lists, and their ids, each counted in one list only: as many rows as centroids.
    lengths, counts = np.zeros(len(index.centroids), np.int64), np.zeros(len(index.centroids), np.int64)
    for r in postings.groupBy("list").count().collect():
        lengths[r["list"]] = r["count"]
    for r in postings.filter("home").groupBy("vec_id").agg(F.min("list").alias("list")).groupBy("list").count().collect():
        counts[r["list"]] = r["count"]
    block, parts = in_blocks(lengths, longest, a_block)
    held = spark.sparkContext.broadcast((counts, block))

    def seek(b):
        out = {"query_id": [], "q": [], "block": [], "lists": []}
        for i, v in zip(b.column("query_id").to_pylist(), b.column("q").to_pylist(), strict=True):
            lists = np.array(shared.value.lists_for(np.array(v), held.value[0], k + 1), np.int32)
            of = held.value[1][lists]
            for x in np.unique(of):
                for c, y in zip(out, (i, v, x, lists[of == x]), strict=True):
                    out[c].append(y)
        return out

    # A repeated row asks once.
    asked = good.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").cast("long").alias("query_id"), F.col("v").alias("q")).distinct()
    asked = stored(map_slices(asked, seek, "query_id long, q array<double>, block int, lists array<int>"))
    # A block that many queries ask is read once for each slice of them.
    cuts = np.ones(len(parts), np.int32)
    for r in asked.groupBy("block").count().collect():
        cuts[r["block"]] = -(-r["count"] // most_asked)

    def looked_up(of: np.ndarray):
        return F.pandas_udf(lambda at: pd.Series(of[at.to_numpy()]), "int")

    def each(n):
        return F.explode(F.sequence(F.lit(0), n - 1))

    def one_of(n, *by):
        return F.pmod(F.xxhash64(*by), n).cast("int")

    in_parts, in_cuts = looked_up(parts), looked_up(cuts)
    asked = asked.withColumn("cut", one_of(in_cuts("block"), "query_id", "q")).withColumn("part", each(in_parts("block")))
    dealt = postings.select("list", "vec_id", "v", looked_up(block)("list").alias("block"))
    dealt = dealt.withColumn("part", one_of(in_parts("block"), "vec_id")).withColumn("cut", each(in_cuts("block")))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        names, lst = np.unique(left["list"].to_numpy(), return_inverse=True)
        wanted = np.array([np.isin(names, lists) for lists in right["lists"]])
        q, x = np.stack(right["q"].to_numpy()), np.stack(left["v"].to_numpy())
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), within(x, left["vec_id"].to_numpy(), lst, q, right["query_id"].to_numpy(), wanted, k), strict=True)))

    keys = ("block", "part", "cut")
    near = dealt.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(best, "query_id long, vec_id long, score double")
    once = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    # Spark keeps k rows of a query in each partition before it brings them together.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
