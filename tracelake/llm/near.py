"""Jaccard join of shingle sets by PartEnum signatures, and its components.

Sizes are cut into bands so that partners stand in the same band or the next; in a band a similarity of p percent bounds the
number of elements in which two sets differ by k.  The domain is hashed into n1 parts, of which more than `spare` differ in k2
elements at most; each part is hashed into n2 pieces, and a signature stands for every choice of n2 - k2 pieces.  So similar sets
share a signature.  A choice without elements says nothing; such signatures are left out where the set has at most `spare`
parts that can give one, as another part then gives a shared signature with elements, and kept for the few other sets.

Equal sets are one class.  In the bucket of a signature each class is compared with the smallest one, its hub, exactly if it may
be near: a parity bitmap of each set gives a lower bound of the elements in which two differ.  What two classes of a bucket may
still link over depends on how far from the hub they are.  Near ones: with D(x) the elements in which x and the hub differ, x and
y differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)| elements, so that classes in different components can only link if they share
differences; these are joined by their rarest ones.  Far ones have little to do with the hub; they are joined by the rarest of
their own elements.  Both take as many of the rarest as the bound asks for, and compare what shares one exactly.  As two that
link are about as far from the hub as each other, each linking pair stands on one side at least (`cut`).  No link between
components is lost, and like texts cost as many comparisons as a bucket has members.

Rows: a null or blank text has an empty set, links with nothing and is its own component; a null doc_id gets a null component;
repeated rows are copies; an empty table gives no rows; further columns are ignored."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache, reduce
from itertools import combinations
from math import comb, exp, factorial, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import blank_words, discard, distinct, gram_hashes, map_slices, mixed, stored, word_hashes


@dataclass(frozen=True)
class Scheme:
    band: int
    low: int
    high: int
    n1: int
    k2: int
    n2: int
    spare: int
    least: int


def poisson(n: int, mean: float) -> float:
    return exp(-mean) * mean**n / factorial(n)


def spare_parts(low: int, base: int, k2: int, n2: int, least: int) -> tuple[int, float]:
    """How many parts to add so that few sets of `low` elements have more parts than that with a choice of under `least`
    elements; their expected number of such parts over the spare ones."""
    if base == 1:
        return 0, 0.0
    for m in range(base + 3):
        held = low / (base + m) * (n2 - k2) / n2
        few = (base + m) * min(1.0, comb(n2, k2) * sum(poisson(i, held) for i in range(least)))
        if m >= few + 3 * sqrt(few) - 0.3:
            break
    return m, max(0.0, few + 3 * sqrt(few) - 0.3 - m)


@cache
def schemes(percent: int, shortest: int) -> tuple[Scheme, Scheme]:
    """The scheme of the band in which that size stands, and that of the next band."""
    low, band = 1, 0
    while 100 * low // percent < shortest:
        low, band = 100 * low // percent + 1, band + 1
    return scheme(percent, low, band), scheme(percent, 100 * low // percent + 1, band + 1)


@cache
def scheme(percent: int, low: int, band: int, shared: int = 60, sharers: int = 8) -> Scheme:
    """The cheapest scheme of a band.  A chance signature costs two sets, and is one that holds none but elements that unrelated
    texts have in common: taken as `shared` of a set's elements, with so many `sharers` in its bucket."""
    high = 100 * low // percent
    k = (100 - percent) * 2 * high // (100 + percent)
    small = max(1, percent * low // 100)  # sets of the band before have partners here
    alike = min(0.8, shared / low)
    best = None
    for k2 in range(min(k, 3) + 1):
        for n2 in range(k2 + 1, k2 + 5) if k2 else (1,):
            for least in (1, 2, 3):
                base = k // (k2 + 1) + 1
                m, over = spare_parts(small, base, k2, n2, least)
                n1 = base + m
                made, held = n1 * comb(n2, k2), low / n1 * (n2 - k2) / n2
                wrong = made * (exp(-held * (1 - alike)) - sum(poisson(i, held) * alike**i for i in range(least))) + over
                if k2 and made > max(70, 0.6 * low) or least > 1 and over:
                    continue
                price = made + sharers * wrong * low
                if best is None or price < best[0]:
                    best = price, Scheme(band, low, high, n1, k2, n2, m, least)
    return best[1]


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams; of the whole text, if it is shorter."""
    h = word_hashes.of(blank_words(text))
    return distinct(gram_hashes(h, min(words, len(h)))) if len(h) else np.empty(0, np.uint64)


def set_hashes(s: np.ndarray) -> tuple[int, int]:
    a = mixed(s + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) if len(s) else 0
    b = mixed(s ^ np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64) if len(s) else 0
    return int(np.array(a, np.uint64).view(np.int64)), int(np.array(b, np.uint64).view(np.int64))


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    own, nxt = schemes(percent, len(s))
    place, value = mixed(s ^ np.uint64(0x2545F4914F6CDD1D)), mixed(s)
    out = [part_signatures(place, value, own)]
    if 100 * len(s) >= percent * nxt.low:  # large enough for partners in the next band
        out.append(part_signatures(place, value, nxt))
    return distinct(np.concatenate(out))


@cache
def choices(x: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """A column for each choice of pieces, with 1 for those that are in it, and the tags of each choice's parts."""
    some = list(combinations(range(x.n2), x.n2 - x.k2))
    chosen = np.zeros((x.n2, len(some)), np.uint64)
    for c, pieces in enumerate(some):
        chosen[list(pieces), c] = 1
    part = np.arange(x.n1, dtype=np.uint64) * np.uint64(2654435761)
    tags = [mixed(part + np.uint64((x.band * 131 + c) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for c in range(len(some))]
    return chosen, np.stack(tags)


def part_signatures(place: np.ndarray, value: np.ndarray, x: Scheme) -> np.ndarray:
    """The signatures of a set by two hashes of its elements."""
    cells = x.n1 * x.n2
    cell = (place % np.uint64(cells)).astype(np.uint16 if cells <= 1 << 16 else np.int64)
    held = np.bincount(cell, minlength=cells)
    first = np.cumsum(held) - held
    sums = np.add.reduceat(np.append(value[np.argsort(cell, kind="stable")], np.uint64(0)), first)
    sums[held == 0] = 0
    chosen, tags = choices(x)
    values = mixed((sums.reshape(x.n1, x.n2) @ chosen).T + tags)
    full = (held.astype(np.uint64).reshape(x.n1, x.n2) @ chosen).T >= x.least
    return values.ravel() if (~full.all(0)).sum() > x.spare else values[full]


def parity_bits(s: np.ndarray) -> bytes:
    """A bit for each remainder of elements, odd or even in number; at least four times as many bits as elements."""
    size = max(64, 1 << (4 * len(s) - 1).bit_length()) if len(s) else 64
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_apart(a: bytes, b: bytes) -> int:
    """A lower bound of the elements in which two sets differ; the longer bitmap is folded to the shorter."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    both = np.bitwise_xor.reduce(x.reshape(-1, size)) ^ np.bitwise_xor.reduce(y.reshape(-1, size))
    return int(np.bitwise_count(both).sum())


def folded(bits: bytes) -> int:
    """A parity bitmap folded to 64 bits."""
    return int(np.bitwise_xor.reduce(np.frombuffer(bits, np.int64)))


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, h1, h2, bits) of each document: its set's size, two hashes of it and its parity bitmap."""

    def run(b):
        out = {"doc_id": b.column("doc_id"), "n": [], "h1": [], "h2": [], "bits": []}
        for t in b.column("text").to_pylist():
            s = shingles(t, words)
            for c, v in zip(("n", "h1", "h2", "bits"), (len(s), *set_hashes(s), parity_bits(s)), strict=True):
                out[c].append(v)
        return out

    return map_slices(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n long, h1 long, h2 long, bits binary")


def signature_rows(docs: DataFrame, words: int, percent: int, turn: int = 0, turns: int = 1, remembered: int = 100_000) -> DataFrame:
    """(node, sig): the signatures of each set, node being its first hash; of several turns those that fall to one.  A task leaves out sets that it has just had, so that
    a group of equal texts gives a set for each task at most."""

    def make(_):
        had: set[int] = set()

        def run(b):
            if len(had) > remembered:
                had.clear()
            nodes, sigs = [], []
            for t in b.column("text").to_pylist():
                s = shingles(t, words)
                node = set_hashes(s)[0]
                if len(s) and node not in had:
                    had.add(node)
                    sig = signatures(s, percent)
                    sig = sig[sig % np.uint64(turns) == turn].view(np.int64)
                    nodes.append(np.full(len(sig), node))
                    sigs.append(sig)
            return {"node": np.concatenate(nodes), "sig": np.concatenate(sigs)} if nodes else None

        return run

    return map_slices(docs.filter("doc_id is not null").select("text"), make, "node long, sig long", 256, lambda: None)


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node in links (a, b): the smallest node that they reach.  Every node points to its smallest neighbour or
    itself, pointers are followed to their ends, and the ends stand for what points to them in the links that are left."""
    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = stored(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("comp")))
    while edges.limit(1).count():
        ends = edges.select(F.col("a").alias("tip"), F.col("b").alias("to")).union(edges.select("b", "a"))
        point = stored(ends.groupBy("tip").agg(F.least(F.col("tip"), F.min("to")).alias("to")))
        while True:
            far = point.select(F.col("tip").alias("to"), F.col("to").alias("end"))
            after = stored(point.join(far, "to").select("tip", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("moved")))
            discard(point)
            point = after
            if not point.filter("moved").limit(1).count():
                break
        of = point.select("tip", "to")
        new = stored(found.join(of.withColumnRenamed("tip", "comp"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")))
        left = edges.join(of.select(F.col("tip").alias("a"), F.col("to").alias("c")), "a").select("c", "b").join(of.select(F.col("tip").alias("b"), F.col("to").alias("d")), "b")
        less = stored(left.filter("c <> d").select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct())
        discard(edges, point, found)
        edges, found = less, new
    discard(edges)
    return found


def joined_components(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components of found (node, comp) when links (a, b) come to them."""
    one = links.join(found.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left")
    two = one.join(found.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left")
    more = components(two.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).filter("a <> b"))
    nodes = found.union(more.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("comp")))
    return nodes.join(more.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))


def bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs (a, b) with the sizes of both sets and a lower bound of the elements in which they differ, from the bitmaps,
    and b's bitmap in 64 bits."""
    side = [classes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab"]

    def run(b):
        out = {c: b.column(c) for c in ("a", "b", "na", "nb")}
        both = zip(b.column("bits_a").to_pylist(), b.column("bits_b").to_pylist(), strict=True)
        least, fold = [], []
        for x, y in both:
            least.append(least_apart(x, y))
            fold.append(folded(y))
        return out | {"least": least, "fold": fold}

    return stored(map_slices(pairs.join(side[1], "b").join(side[0], "a"), run, "a long, b long, na long, nb long, least long, fold long"))


def sets_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame, words: int, repeated: bool) -> DataFrame:
    """(node, set) of the nodes, from the texts.  repeated: rows may share an id, so that a set may be read several times."""
    wanted = nodes.join(classes.select("node", "rep", "h2"), "node")

    def run(b):
        out = {"node": [], "set": []}
        for node, h2, text in zip(*(b.column(c).to_pylist() for c in ("node", "h2", "text")), strict=True):
            s = shingles(text, words)
            if set_hashes(s) == (node, h2):
                out["node"].append(node)
                out["set"].append(s.view(np.int64))
        return out

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(wanted, "rep")
    sets = map_slices(texts, run, "node long, `set` array<long>")
    return sets.dropDuplicates(["node"]) if repeated else sets


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int, repeated: bool) -> DataFrame:
    """pairs (a, b) with the sizes of both sets, the elements in which they differ, and whether they link; from the whole sets."""
    need = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = stored(sets_of(need, classes, docs, words, repeated))
    one = pairs.select("a", "b").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    two = one.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    apart = F.concat(F.array_except("sa", "sb"), F.array_except("sb", "sa"))
    d = two.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), apart.alias("apart"))
    total = F.col("na") + F.col("nb")
    out = stored(d.withColumn("link", F.size("apart") * (100 + percent) <= (100 - percent) * total))
    discard(sets)
    return out


def most_apart(n: Column, percent: int) -> Column:
    """In how many elements a set of n and one linked with it may differ."""
    return F.floor(n * (100 - percent) / percent)


def cut(n: Column) -> Column:
    """How far from a hub of n elements classes are far ones.  Near are those at most their own most_apart() farther: if x is not
    near, what links with x is beyond the cut, as x itself is."""
    return F.floor(n / 2)


def may_link(a: dict[str, Column], b: dict[str, Column], percent: int) -> Column:
    """Whether sets of at most n elements may link by their folded bitmaps, in which bits differ for an odd number of differences
    each.  Of several sets `all` has the bits of each and `any` those of one at least; so a bit that all of one side have and none
    of the other differs whichever two are meant.  Of a single set both are its bitmap."""
    differ = F.bit_count(a["all"].bitwiseAND(F.bitwise_not(b["any"]))) + F.bit_count(b["all"].bitwiseAND(F.bitwise_not(a["any"])))
    return differ * (100 + percent) <= (100 - percent) * (a["n"] + b["n"])


def between(rows: DataFrame, key: list[str], percent: int) -> DataFrame:
    """Pairs (node_a, node_b) of different components with one key that may link, from (*key, node, comp, n, d, r, fold): d elements,
    r of them from this one on in the order of rarity, and the folded bitmap.  The first element that two share has all the others
    that they share behind it, in both.  Components are paired first, by their best bounds, so that a key which all of a component
    share costs no pairs within it, nor one that comes too late for components to link; components are told apart by what the bitmaps
    of their nodes have in common."""
    most, least = (lambda c: F.max(c).alias(c)), (lambda c: F.min(c).alias(c))
    kinds = rows.groupBy(*key, "comp").agg(most("r"), least("d"), most("n"), F.min("n").alias("m"), F.bit_and("fold").alias("all"), F.bit_or("fold").alias("any"))
    rows = rows.withColumn("all", F.col("fold")).withColumnRenamed("fold", "any")

    def side(df: DataFrame, c: str) -> DataFrame:
        return df.select(*key, *[F.col(x).alias(f"{x}_{c}") for x in df.columns if x not in key])

    def enough(*c: str) -> Column:
        shared = 2 * F.least(f"r_{c[0]}", f"r_{c[1]}") - F.col(f"d_{c[0]}") - F.col(f"d_{c[1]}")
        near = may_link(*[{x: F.col(f"{x}_{i}") for x in ("n", "all", "any")} for i in c], percent)
        return ((100 + percent) * shared + (100 - percent) * (F.col(f"n_{c[0]}") + F.col(f"n_{c[1]}")) >= 0) & near

    two = side(kinds, "a").join(side(kinds, "b"), key).filter((F.col("comp_a") < F.col("comp_b")) & enough("a", "b"))
    two = two.filter((100 * F.col("n_a") >= percent * F.col("m_b")) & (100 * F.col("n_b") >= percent * F.col("m_a")))
    two = two.select(*key, "comp_a", "comp_b", *[F.col(f"{x}_b").alias(f"{x}_best") for x in ("r", "d", "n", "all", "any")])
    one = two.join(side(rows, "a"), [*key, "comp_a"]).filter(enough("a", "best")).drop("r_best", "d_best", "n_best", "all_best", "any_best")
    sized = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return one.join(side(rows, "b"), [*key, "comp_b"]).filter(sized & enough("a", "b")).select("node_a", "node_b")


def told_apart(rows: DataFrame, key: str, percent: int, most: int = 16) -> tuple[DataFrame, DataFrame]:
    """Of rows (key, node, comp, n, fold): pairs (a, b) of different components that may link by their sizes and folded bitmaps, for
    keys with up to `most` rows, and the rows of the other keys in which components meet.  Pairs are made within one such row's
    array, so that a key costs `most` candidates a row at the utmost."""
    met = rows.groupBy(key).agg(F.min("comp").alias("one"), F.max("comp").alias("other"), F.count("*").alias("held")).filter("one < other").select(key, "held")
    d = rows.join(met, key)
    lists = d.filter(F.col("held") <= most).groupBy(key).agg(F.collect_list(F.struct("node", "comp", "n", "fold")).alias("of"))

    def partners(x: Column) -> Column:
        def may(y: Column) -> Column:
            return (x["node"] < y["node"]) & (x["comp"] != y["comp"]) & may_link(*[{"all": s["fold"], "any": s["fold"], "n": s["n"]} for s in (x, y)], percent)

        return F.transform(F.filter("of", may), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))

    pairs = lists.select(F.explode(F.flatten(F.transform("of", partners))).alias("p")).select("p.a", "p.b")
    return pairs, d.filter(F.col("held") > most).drop("held")


def ordered(rows: DataFrame, by: list[str]) -> DataFrame:
    """(*by, node, xs) from (*by, node, x): the elements that several nodes share, the rarest first.  Counts are made up before they
    are shuffled, and Spark cuts up an element that many share where it is joined."""
    common = rows.groupBy(*by, "x").agg(F.count("*").alias("c")).filter("c > 1")
    return rows.join(common, [*by, "x"]).groupBy(*by, "node").agg(F.sort_array(F.collect_list(F.struct("c", "x"))).alias("xs"))


def far_candidates(nodes: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int, repeated: bool) -> DataFrame:
    """Pairs (a, b) among nodes (node, comp, fold) in different components that share one of their rarest elements, of which each takes
    as many as it must have in common with any partner's."""
    sets = stored(sets_of(nodes.select("node"), classes, docs, words, repeated))
    order = stored(ordered(sets.select("node", F.explode("set").alias("x")), []))
    d = order.join(nodes, "node").join(classes.select("node", "n"), "node")
    alone = F.col("n") - F.size("xs")  # shared by nobody, so the rarest of all
    keep = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone
    some = F.slice("xs", F.lit(1), F.greatest(F.least(keep, F.size("xs")), F.lit(0)).cast("int"))
    rows = d.select("node", "comp", "n", "fold", alone.alias("alone"), F.posexplode(some).alias("p", "e"))
    rows = stored(rows.select(F.col("e.x").alias("x"), "node", "comp", "n", "fold", F.col("n").alias("d"), (F.col("n") - F.col("alone") - F.col("p")).alias("r")))
    pairs = between(rows, ["x"], percent).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    out = stored(pairs.distinct())
    discard(sets, order, rows)
    return out


def dealt(rows: DataFrame, one: DataFrame, key: str, ways: int = 16) -> DataFrame:
    """rows joined with `one`, which has a row for each key at most; the rows of a key go to so many tasks."""
    many = one.withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    return rows.withColumn("way", F.pmod("node", F.lit(ways)).cast("int")).join(many, [key, "way"]).drop("way")


def near_candidates(family: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes near one hub in different components that may link, from (hub, node, n, d, fold, comp, out), out telling
    whose component isn't the hub's: those that share one of the differences that are rarest around the hub, as many of each as
    its bound asks for, and those whose differences are so few that they link whatever they are (one for a component)."""
    least = family.groupBy("hub").agg(F.min("d").alias("any"), F.min(F.when(F.col("out"), F.col("d"))).alias("outer")).filter("outer is not null")
    d = stored(dealt(family, least, "hub").withColumn("most", most_apart(F.col("n"), percent)))
    apart = tried.select(F.col("a").alias("hub"), F.col("b").alias("node"), "apart")
    order = stored(ordered(d.select("hub", "node").join(apart, ["hub", "node"]).select("hub", "node", F.explode("apart").alias("x")), ["hub"]))
    alone = F.col("d") - F.size("xs")
    # A partner has at least d - most differences, by the triangle, and as many as the least of those that it can be.
    other = F.when(F.col("out"), F.col("any")).otherwise(F.col("outer"))
    need = F.ceil((F.col("d") + F.greatest(other, F.col("d") - F.col("most")) - F.col("most")) / 2)
    keep = F.col("d") - F.greatest(need, F.lit(1)) + 1 - alone
    some = F.slice("xs", F.lit(1), F.greatest(F.least(keep, F.size("xs")), F.lit(0)).cast("int"))
    rows = d.join(order, ["hub", "node"]).select("hub", "node", "comp", "n", "d", "fold", alone.alias("alone"), F.posexplode(some).alias("p", "e"))
    rows = stored(rows.select("hub", F.col("e.x").alias("x"), "node", "comp", "n", "d", "fold", (F.col("d") - F.col("alone") - F.col("p")).alias("r")))
    share = stored(between(rows, ["hub", "x"], percent))
    # Those so near the hub that differences cannot part them: x and y link if their spares add up, so that each that links with any
    # links with the one of the largest spare, too, and so do its partners.
    few = d.filter("out and d + any <= most").select("hub", "node", "comp", "n", "d")
    spare = (100 - percent) * F.col("n") - (100 + percent) * F.col("d")
    light = d.groupBy("hub").agg(F.max(F.struct(spare.alias("spare"), F.col("node").alias("node_b"), "comp")).alias("best"))
    inner = d.filter(~F.col("out")).groupBy("hub").agg(F.max(F.struct(spare.alias("spare"), F.col("node").alias("node_b"), "comp")).alias("best"))
    sure = dealt(few, light, "hub").union(dealt(few, inner, "hub")).filter((F.col("comp") != F.col("best.comp")) & (F.col("best.spare") + spare >= 0))
    pairs = share.union(sure.select("node", "best.node_b"))
    out = stored(pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct())
    discard(d, order, rows, share)
    return out


def met_by_chance(buckets: DataFrame, bounds: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) in different components of found that may link by their sizes and folded bitmaps: each class of a bucket and the
    bucket's `mid`, which is another class in each bucket.  So there is a pair at most for each row of a bucket, and a crowd of like
    texts of which few are near their hubs comes together before it is asked for all the pairs between its components."""
    of = bounds.select(F.col("a").alias("hub"), F.col("b").alias("node"), F.col("nb").alias("n"), "fold").join(found, "node", "left")
    of = stored(of.select("hub", "node", "n", "fold", F.coalesce("comp", "node").alias("comp")))
    mid = of.select("hub", F.col("node").alias("mid"), *[F.col(c).alias(f"{c}_mid") for c in ("n", "fold", "comp")])
    sized = 100 * F.least("n", "n_mid") >= percent * F.greatest("n", "n_mid")
    near = may_link({"all": F.col("fold"), "any": F.col("fold"), "n": F.col("n")}, {"all": F.col("fold_mid"), "any": F.col("fold_mid"), "n": F.col("n_mid")}, percent)
    two = buckets.join(of, ["hub", "node"]).join(mid, ["hub", "mid"]).filter((F.col("comp") != F.col("comp_mid")) & sized & near)
    pairs = stored(two.select(F.least("node", "mid").alias("a"), F.greatest("node", "mid").alias("b")).distinct())
    discard(of)
    return pairs


def far_buckets(family: DataFrame, buckets: DataFrame) -> DataFrame:
    """(sig, node, comp, n, fold) of the classes far from the hub of a bucket."""
    beyond = family.filter(F.col("d").isNull() | (F.col("d") > cut(F.col("na")))).select("hub", "node", "comp", "n", "fold")
    return buckets.join(beyond, ["hub", "node"]).select("sig", "node", "comp", "n", "fold")


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80, repeated: bool | None = None, turns: int = 1) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the smallest doc_id that links of at least that similarity reach.
    repeated: whether rows share an id, if that is known.  turns: in how many parts signatures are shuffled, one after the other;
    more take less disk at a time and make the signatures as often."""
    sets = stored(shingle_sets(docs, words))
    known = sets.filter("n > 0 and doc_id is not null")
    repeated = known.groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0 if repeated is None else repeated
    classes = stored(known.groupBy(F.col("h1").alias("node"), "h2", "n").agg(F.min("doc_id").alias("rep"), F.any_value("bits").alias("bits")))
    held = []
    for turn in range(turns):
        # One shuffle, by signature: the hubs are found and joined back where the rows already are.
        rows = signature_rows(docs, words, percent, turn, turns).filter("node is not null and sig is not null").repartition("sig")
        mid = F.min(F.col("node").bitwiseXOR(F.col("sig"))).bitwiseXOR(F.col("sig"))
        shared = rows.groupBy("sig").agg(F.min("node").alias("hub"), F.max("node").alias("top"), mid.alias("mid")).filter("hub < top").select("sig", "hub", "mid")
        held.append(stored(rows.join(shared, "sig").filter("node > hub")))
    buckets = reduce(DataFrame.union, held)
    bounds = bounded(buckets.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), classes)
    reach = cut(F.col("na")) + most_apart(F.col("nb"), percent)
    tried = verified(bounds.filter(F.col("least") <= reach), classes, docs, words, percent, repeated)
    links = tried.filter("link").select("a", "b")
    found = components(links)
    met = bounded(met_by_chance(buckets, bounds, found, percent), classes)
    linked = F.col("least") * (100 + percent) <= (100 - percent) * (F.col("na") + F.col("nb"))
    chance = verified(met.filter(linked), classes, docs, words, percent, repeated)
    if chance.filter("link").limit(1).count():
        found = stored(joined_components(found, chance.filter("link").select("a", "b")))

    comp_a = found.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
    comp_b = found.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    exact = tried.select("a", "b", F.size("apart").cast("long").alias("d"))
    family = bounds.join(exact, ["a", "b"], "left").join(comp_b, "b", "left").join(comp_a, "a", "left")
    ca, cb = F.coalesce("ca", "a"), F.coalesce("cb", "b")
    family = stored(family.select(F.col("a").alias("hub"), F.col("b").alias("node"), "na", F.col("nb").alias("n"), "d", "fold", cb.alias("comp"), (ca != cb).alias("out")))
    close = family.filter(F.col("d") <= cut(F.col("na")) + most_apart(F.col("n"), percent)).drop("na")
    # Few around a hub, or in a bucket far from it, are paired at once; the elements in which more differ tell which of them to pair.
    # Each step's rows are stored, as a plan of several steps at once takes much of the driver's memory and makes rows anew.
    by_hub, crowd = told_apart(close, "hub", percent)
    by_hub, near = stored(by_hub), near_candidates(crowd, tried, percent)
    beyond = stored(far_buckets(family, buckets))
    by_sig, crowd = told_apart(beyond, "sig", percent)
    by_sig, nodes = stored(by_sig), stored(crowd.select("node", "comp", "fold").distinct())
    away = far_candidates(nodes, classes, docs, words, percent, repeated)
    candidates = stored(by_hub.union(by_sig).union(near).union(away).distinct())
    more = bounded(candidates, classes)
    again = verified(more.filter(linked), classes, docs, words, percent, repeated)
    if again.filter("link").limit(1).count():
        found = stored(joined_components(found, again.filter("link").select("a", "b")))
    discard(*held, bounds, tried, met, chance, family, by_hub, near, beyond, by_sig, nodes, away, candidates, more, again)

    comp = classes.join(found, "node", "left").select("node", "h2", "n", "rep", F.coalesce("comp", "node").alias("comp"))
    least = comp.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of = comp.join(least, "comp").select(F.col("node").alias("h1"), "h2", "n", "component_id")
    return sets.select("doc_id", "h1", "h2", "n").join(of, ["h1", "h2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )


def drop_near(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs, in the same columns: of each group one row stays, that with the smallest id, and the first of these; rows without an
    id are grouped like the others and come last."""
    numbered = stored(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")))
    groups = stored(near_groups(numbered.select(F.col("row").alias("doc_id"), "doc.text"), words, percent, repeated=False, turns=2))
    of = groups.select(F.col("doc_id").alias("row"), "component_id")
    ids = numbered.select("row", F.col("doc.doc_id").alias("id"))
    first = of.join(ids, "row").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    gone = stored(of.join(first.select(F.col("first.row").alias("row")), "row", "left_anti").select("row"))
    return numbered.join(gone, "row", "left_anti").select("doc.*")
