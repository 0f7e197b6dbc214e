"""Text quality by a generalised additive model with pairwise interactions.

Every feature is cut into bins; cyclic boosting visits the features in turn and adds a small step from a shallow tree over the
feature's bins to that feature's lookup table; then the feature pairs that explain most of what is left get tables of their own.
A score is the logistic of the sum of the looked-up values: one vectorised addition for each table.

Rows: a null text counts as empty; repeated rows are each scored; labels that are null are not learnt from, repeated labels of one
document count once; without usable labels of both kinds every score is the smoothed share of the label; an empty table gives
no rows; further columns are ignored."""

from __future__ import annotations

from dataclasses import dataclass, field
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import map_slices, remainder

FEATURES = (
    "log_words", "word_length", "upper", "digits", "marks", "signs", "bars", "lines", "distinct_words", "repeats", "distinct_lines",
    "long_words", "no_ascii", "bangs", "capitals", "stops", "chars_a_line", "top_char",
)


def _classes() -> np.ndarray:
    c = np.zeros(256, np.int64)  # 0 other
    c[97:123], c[65:91], c[48:58], c[128:] = 1, 2, 3, 4
    for b in b" \t\r\f\v":
        c[b] = 5
    c[10] = 6
    for b in b",;:'\"()-":
        c[b] = 7
    c[ord(".")] = c[ord("?")] = 8
    c[ord("|")], c[ord("!")] = 9, 10
    for b in b"#$%&*+/<=>@[\\]^_`{}~":
        c[b] = 11
    return c


CLASSES = _classes()


def features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    c = np.bincount(CLASSES, counts, 12)
    words, lines = raw.split(), raw.split(b"\n")
    m = max(1, len(words))
    letters = max(1.0, c[1] + c[2] + c[4])
    return [
        np.log1p(len(words)), (n - c[5] - c[6]) / m, c[2] / letters, c[3] / n, c[7] / m, c[11] / m, c[9] / m, np.log1p(len(lines)),
        len(set(words)) / m, sum(map(eq, words, words[1:])) / m, len(set(lines)) / len(lines), sum(len(w) > 18 for w in words) / m,
        c[4] / n, c[10] / m, sum(w[:1].isupper() for w in words) / m, c[8] / m, np.log1p(n / len(lines)), counts[:32].sum() / n + counts.max() / n,
    ]


@dataclass
class Gam:
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)  # bin -> coarse bin, for the pairs
    pair_tables: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not self.tables:
            return out
        b = self.bins(x)
        for j, t in enumerate(self.tables):
            out += t[b[:, j]]
        for (j, k), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[self.coarse[j][b[:, j]], self.coarse[k][b[:, k]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def tree_step(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> tuple[np.ndarray, float]:
    """Newton step for each bin from the tree with that many leaves that greedy splits of the bin sequence give; its gain."""
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    edges, gain = [0, len(g)], 0.0
    for _ in range(leaves - 1):
        best = (1e-9, 0)
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a < 2:
                continue
            s = np.arange(a + 1, b)
            left, right = (G[s] - G[a]) ** 2 / (H[s] - H[a] + ridge), (G[b] - G[s]) ** 2 / (H[b] - H[s] + ridge)
            v = left + right - (G[b] - G[a]) ** 2 / (H[b] - H[a] + ridge)
            i = int(v.argmax())
            best = max(best, (float(v[i]), int(s[i])))
        if not best[1]:
            break
        gain += best[0]
        edges = sorted([*edges, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(edges, edges[1:], strict=False):
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + ridge)
    return out, gain


def fit_gam(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 80, pair_rounds: int = 30, pairs: int = 6, rate: float = 0.15, leaves: int = 3, ridge: float = 2.0) -> Gam:
    m = Gam()
    p = (y.sum() + 1) / (len(y) + 2)
    m.base = float(np.log(p / (1 - p)))
    if len(y) == 0 or y.min() == y.max():
        return m
    m.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    b = m.bins(x)
    sizes = [len(c) + 1 for c in m.cuts]
    m.tables = [np.zeros(s) for s in sizes]
    f = np.full(len(y), m.base)

    def slope():
        q = 1 / (1 + np.exp(-f))
        return y - q, np.maximum(q * (1 - q), 1e-6)

    for _ in range(rounds):
        for j, s in enumerate(sizes):
            r, h = slope()
            step, _ = tree_step(np.bincount(b[:, j], r, s), np.bincount(b[:, j], h, s), leaves, ridge)
            m.tables[j] += rate * step
            f += rate * step[b[:, j]]
    m.coarse = [np.minimum(np.arange(s) * 8 // s, 7) for s in sizes]
    c = np.stack([m.coarse[j][b[:, j]] for j in range(len(sizes))], 1)
    r, h = slope()
    found = []
    for j in range(len(sizes)):
        for k in range(j):
            cell = c[:, j] * 8 + c[:, k]
            g2, h2 = np.bincount(cell, r, 64), np.bincount(cell, h, 64)
            found.append((float((g2**2 / (h2 + ridge)).sum()), j, k))
    m.pairs = [(j, k) for _, j, k in sorted(found, reverse=True)[:pairs]]
    m.pair_tables = [np.zeros((8, 8)) for _ in m.pairs]
    for _ in range(pair_rounds):
        for t, (j, k) in zip(m.pair_tables, m.pairs, strict=True):
            r, h = slope()
            cell = c[:, j] * 8 + c[:, k]
            g2, h2 = np.bincount(cell, r, 64).reshape(8, 8), np.bincount(cell, h, 64).reshape(8, 8)
            cut, _ = tree_step(g2.sum(1), h2.sum(1), 2, ridge)  # one split of the first feature, then one of the second in each half
            step = np.zeros((8, 8))
            for half in {float(v) for v in cut}:
                rows = cut == half
                step[rows] = tree_step(g2[rows].sum(0), h2[rows].sum(0), 2, ridge)[0]
            t += rate * step
            f += rate * step[c[:, j], c[:, k]]
    return m


def labelled(docs: DataFrame, labels: DataFrame, label: str, n: int, out: int, most: int) -> DataFrame:
    """(text, y) of at most `most` labelled documents whose remainder isn't `out`, those with the smallest id hashes."""
    rule = remainder(F.col("doc_id"), n) != out
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & rule).groupBy("doc_id").agg(F.max(label).alias("y"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").cast("double").alias("y"))


def train_quality(docs: DataFrame, labels: DataFrame, most: int = 12_000) -> Gam:
    """The model from at most `most` labelled documents outside the held-out fold."""

    def run(b):
        return {"doc_id": b.column("doc_id"), "x": [features(t) for t in b.column("text").to_pylist()], "y": b.column("y")}

    rows = map_slices(labelled(docs, labels, "quality", 4, 2, most).withColumn("doc_id", F.col("doc_id").cast("long")), run, "doc_id long, x array<double>, y double").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return fit_gam(np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES)), np.array([r["y"] for r in rows]))


def score_quality(docs: DataFrame, model: Gam, threshold: float = 0.7) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(b):
        x = np.array([features(t) for t in b.column("text").to_pylist()]).reshape(-1, len(FEATURES))
        s = shared.value.score(x)
        return {"doc_id": b.column("doc_id"), "score": s, "predicted": (s >= threshold).astype(np.int32)}

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = map_slices(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double, predicted int")
    return scored.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
