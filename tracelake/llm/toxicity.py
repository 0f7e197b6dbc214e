"""Toxicity by a small bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its own vector (for the words that training picked), plus the mean vector of its hashed character 3-grams; the
gates' input products are computed once for each word and kept.  A text is read in windows of 32 words, of which each shares 8 with the next; all
windows of all texts of a batch go through the network step by step together.  A text's score is that of its worst window.

Rows: a null text and a text without words score as one empty window; repeated rows are each scored; null labels are not learnt
from, repeated labels of one document count once; without labels of both kinds every score is the smoothed share of the label;
an empty table gives no rows; further columns are ignored."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import alnum_words, caches, forget, map_slices, remainder, slices
from tracelake.llm.quality import labelled

WIDTH, STEP = 32, 24
SIZE, GRAMS = 8, 4096  # hidden units each way; rows of the character table


def gram_rows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character 3-grams of <word> (every word has one at least), and where each word's begin."""
    flat = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.int64)
    size = np.array([len(w) for w in words], np.int64)
    first = np.concatenate([[0], np.cumsum(size + 2)[:-1]])
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    at = np.arange(size.sum()) + np.repeat(first - start, size)
    return (flat[at] * 7919 + flat[at + 1] * 104729 + flat[at + 2] * 1299709) % GRAMS, start


def windows_of(ids: list[np.ndarray], blank: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows (rows of WIDTH ids, padded with blank) of all texts, and the text that each belongs to."""
    counts = np.array([max(1, -(-(len(x) - (WIDTH - STEP)) // STEP)) for x in ids], np.int64)
    owner = np.repeat(np.arange(len(ids)), counts)
    need = counts * STEP + WIDTH - STEP
    flat = np.full(int(need.sum()), blank, np.int64)
    base = np.concatenate([[0], np.cumsum(need)[:-1]])
    for b, x in zip(base.tolist(), ids, strict=True):
        flat[b : b + len(x)] = x
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return flat[(base[owner] + nth * STEP)[:, None] + np.arange(WIDTH)], owner


def squash(x: np.ndarray) -> np.ndarray:
    """Hard logistic, in place: a quarter of x plus a half, between 0 and 1."""
    x *= 0.25
    x += 0.5
    return np.clip(x, 0, 1, out=x)


@dataclass
class Network:
    words: dict[bytes, int]  # row 0 is any other word
    p: dict[str, np.ndarray]
    base: float = 0.0
    fitted: bool = False
    #: From a window's raw value to the logit of a text whose worst window it is.
    scale: float = 1.0
    shift: float = 0.0

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """Vector of each word."""
        rows, start = gram_rows(words)
        size = np.diff(np.append(start, len(rows)))
        own = self.p["word"][[self.words.get(w, 0) for w in words]]
        return own + np.add.reduceat(self.p["gram"][rows], start, axis=0) / size[:, None].astype(np.float32)

    def products(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Gate inputs of each word, forward and backward."""
        x = self.inputs(words)
        return x @ self.p["in_f"] + self.p["b_f"], x @ self.p["in_b"] + self.p["b_b"]

    def logits(self, tables: list[np.ndarray], windows: np.ndarray) -> np.ndarray:
        """Of windows whose ids are rows of the tables."""
        n, h = len(windows), SIZE
        steps = np.ascontiguousarray(windows.T)
        states = np.empty((WIDTH, 2, n, h), np.float32)
        for way, u in enumerate("fb"):
            gate, cand = np.ascontiguousarray(self.p[f"rec_{u}"][:, : 2 * h]), np.ascontiguousarray(self.p[f"rec_{u}"][:, 2 * h :])
            s = np.zeros((n, h), np.float32)
            for t in range(WIDTH) if way == 0 else range(WIDTH - 1, -1, -1):
                x = tables[way].take(steps[t], axis=0)
                gates = s @ gate
                gates += x[:, : 2 * h]
                squash(gates)
                c = (gates[:, h:] * s) @ cand
                c += x[:, 2 * h :]
                np.clip(c, -1, 1, out=c)
                c -= s
                c *= gates[:, :h]
                s = np.add(s, c, out=states[t, way])
        e = states[:, 0] @ self.p["att"][:h] + states[:, 1] @ self.p["att"][h:]
        v = states[:, 0] @ self.p["out"][:h] + states[:, 1] @ self.p["out"][h:]
        a = np.exp(e - e.max(0))
        return ((a * v).sum(0) / a.sum(0) + self.p["out_b"][0]) * self.scale + self.shift


class Scorer:
    """A network with the gate inputs of the words that it has met."""

    def __init__(self, net: Network, most: int = 100_000):
        self.net, self.most = net, most
        self.clear()

    def clear(self):
        self.known: dict[bytes, int] = {}
        self.tables = [np.zeros((1024, 3 * SIZE), np.float32) for _ in "fb"]
        for table, u in zip(self.tables, "fb", strict=True):
            table[0] = self.net.p[f"b_{u}"] if self.net.fitted else 0  # row 0: no word

    def scores(self, texts: list[str | None]) -> np.ndarray:
        net = self.net
        if not net.fitted:
            return np.full(len(texts), 1 / (1 + np.exp(-net.base)))
        if len(self.known) > self.most:
            self.clear()
        known, ids = self.known, []
        words = [alnum_words(t) for t in texts]
        new = list(set().union(*words).difference(known)) if words else []
        if new:
            first, need = len(known) + 1, len(known) + 1 + len(new)
            more = max(need, 2 * len(self.tables[0])) - len(self.tables[0])
            for way, x in enumerate(net.products(new)):
                if need > len(self.tables[way]):
                    self.tables[way] = np.concatenate([self.tables[way], np.zeros((more, 3 * SIZE), np.float32)])
                self.tables[way][first:need] = x
            known.update(zip(new, range(first, need), strict=True))
        get = known.__getitem__
        ids = [np.fromiter(map(get, w), np.int64, len(w)) for w in words]
        windows, owner = windows_of(ids, 0)
        out = np.full(len(texts), -1e9)
        for i in range(0, len(windows), 1024):
            np.maximum.at(out, owner[i : i + 1024], net.logits(self.tables, windows[i : i + 1024]).astype(float))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit_network(texts: list[str | None], y: np.ndarray, vocabulary: int = 8000, rounds: int = 3, batch: int = 128, rate: float = 0.02, seed: int = 7) -> Network:
    """Windows of toxic texts in which a word of toxic texts stands are positive, windows of clean texts negative.

    A word's first input is its smoothed log ratio between toxic and clean texts, which training then goes on from."""
    rng = np.random.default_rng(seed)
    share = (y.sum() + 1) / (len(y) + 2)
    net = Network({}, {}, float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return net
    known: dict[bytes, bytes] = {}  # a word is held once, not once for each place
    split = [[known.setdefault(w, w) for w in alnum_words(t)] for t in texts]
    bad, good = Counter(), Counter()
    for w, v in zip(split, y, strict=True):
        (bad if v else good).update(set(w))
    n1, n0 = y.sum(), len(y) - y.sum()
    ratio = {w: np.log((bad[w] + 0.5) / (n1 + 1)) - np.log((good[w] + 0.5) / (n0 + 1)) for w in {*bad, *good} if bad[w] + good[w] >= 3}
    weight = {w: v * np.sqrt(bad[w] + good[w]) for w, v in ratio.items()}
    chosen = sorted(weight, key=lambda w: (-abs(weight[w]), w))[:vocabulary]
    net.words = {w: i + 1 for i, w in enumerate(chosen)}
    h, d = SIZE, 8
    r = lambda *s, k=0.3: rng.normal(0, k, s).astype(np.float32)
    p = net.p = {"word": r(len(chosen) + 1, d, k=0.05), "gram": r(GRAMS, d, k=0.05), "in_f": r(d, 3 * h), "in_b": r(d, 3 * h), "rec_f": r(h, 3 * h), "rec_b": r(h, 3 * h), "b_f": np.zeros(3 * h, np.float32), "b_b": np.zeros(3 * h, np.float32), "att": r(2 * h), "out": r(2 * h), "out_b": np.zeros(1, np.float32)}
    p["word"][0, 0] = -0.3
    p["word"][1:, 0] = [np.clip(ratio[w], -1, 4) if bad[w] >= 4 or ratio[w] < 0 else 0.0 for w in chosen]
    for u in "fb":
        p[f"in_{u}"][0, 2 * h :] = np.abs(p[f"in_{u}"][0, 2 * h :]) + 0.2
    p["att"][:], p["out"][:] = np.abs(p["att"]) + 0.5, np.abs(p["out"]) + 0.5
    strong = {w for w in chosen if bad[w] >= 4 and ratio[w] > 2.0}
    windows, label = [], []
    for w, v in zip(split, y, strict=True):
        hits = [i for i, x in enumerate(w) if x in strong]
        if v:
            for i in hits[:4]:
                a = max(0, i - int(rng.integers(0, WIDTH)))
                windows.append(w[a : a + WIDTH])
                label.append(1.0)
            if not hits and len(w) <= WIDTH:
                windows.append(w)
                label.append(1.0)
        else:
            for a in {0, int(rng.integers(0, max(1, len(w) - WIDTH + 1))), *(max(0, i - WIDTH // 2) for i in hits[:2])}:
                part = w[a : a + int(rng.integers(1, WIDTH + 1))]
                windows.append(part)
                label.append(0.0)
    label = np.array(label, np.float32)
    if not label.any():
        return net
    net.fitted = True
    train(net, windows, np.array(label), rounds, batch, rate, rng)
    # Clean texts' worst windows and toxic texts' best ones join the training; then values become logits of whole texts.
    for again in range(2):
        worst, at = text_maxima(net, split)
        if again:
            break
        hard = np.flatnonzero((y == 0) & (worst > np.quantile(worst[y == 0], 0.7)))
        windows += [split[i][at[i] * STEP : at[i] * STEP + WIDTH] for i in hard]
        label = np.concatenate([label, np.zeros(len(hard), np.float32)])
        train(net, windows, label, rounds, batch, rate / 2, rng)
    net.scale, net.shift = platt(worst, y)
    return net


def text_maxima(net: Network, split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Each text's highest window value and that window's number."""
    words = sorted(set().union(*split))
    place = {w: i + 1 for i, w in enumerate(words)}
    tables = [np.concatenate([net.p[f"b_{u}"][None], x]).astype(np.float32) for u, x in zip("fb", net.products(words), strict=True)]
    best, at = np.full(len(split), -1e9), np.zeros(len(split), np.int64)
    for i in range(0, len(split), 256):
        ids = [np.fromiter((place[w] for w in x), np.int64, len(x)) for x in split[i : i + 256]]
        windows, owner = windows_of(ids, 0)
        v = np.concatenate([net.logits(tables, windows[k : k + 1024]) for k in range(0, len(windows), 1024)])
        first = np.searchsorted(owner, np.arange(len(ids)))
        for j, (a, b) in enumerate(zip(first, [*first[1:], len(v)], strict=True)):
            k = int(v[a:b].argmax())
            best[i + j], at[i + j] = v[a + k], k
    return best, at


def platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the logistic that fits y from x, both kinds weighing the same."""
    mean, sd = x.mean(), x.std() + 1e-6
    z, w = (x - mean) / sd, np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    a, b = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([(w * (q - y) * z).sum() + 1e-4 * a, (w * (q - y)).sum()])
        s = w * q * (1 - q) + 1e-9
        H = np.array([[(s * z * z).sum() + 1e-4, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        da, db = np.linalg.solve(H, g)
        a, b = max(0.05, a - np.clip(da, -1, 1)), b - float(np.clip(db, -1, 1))
    return float(a / sd), float(b - a * mean / sd)


def train(net: Network, windows: list[list[bytes]], label: np.ndarray, rounds: int, batch: int, rate: float, rng) -> None:
    p = net.p
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    ones, zeros = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    steps = rounds * max(90, min(150, 2 * len(ones) // batch))
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(ones, batch // 2), rng.choice(zeros, batch // 2)])
        grads = gradients(net, [windows[i] for i in pick], label[pick])
        k = rate * (0.1 + 0.9 * (1 - step / steps))
        for name, g in grads.items():
            m = moment[name]
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.001 * (g * g - m[1])
            p[name] -= (k * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def gradients(net: Network, windows: list[list[bytes]], y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean logistic loss over the windows."""
    p, h, n = net.p, SIZE, len(windows)
    words = sorted({w for x in windows for w in x})
    place = {w: i + 1 for i, w in enumerate(words)}
    ids = np.zeros((n, WIDTH), np.int64)
    for i, x in enumerate(windows):
        ids[i, : len(x)] = [place[w] for w in x]
    d = p["word"].shape[1]
    X = np.zeros((len(words) + 1, d), np.float32)
    if words:
        X[1:] = net.inputs(words)
    states, kept = np.zeros((WIDTH, n, 2 * h), np.float32), {}
    for way, u in enumerate("fb"):
        s = np.zeros((n, h), np.float32)
        for t in range(WIDTH) if way == 0 else range(WIDTH - 1, -1, -1):
            x = X[ids[:, t]] @ p[f"in_{u}"] + p[f"b_{u}"]
            raw = x[:, : 2 * h] + s @ p[f"rec_{u}"][:, : 2 * h]
            gates = np.clip(0.25 * raw + 0.5, 0, 1)
            z, r = gates[:, :h], gates[:, h:]
            pre = x[:, 2 * h :] + (r * s) @ p[f"rec_{u}"][:, 2 * h :]
            c = np.clip(pre, -1, 1)
            kept[u, t] = s, raw, z, r, pre, c
            s = s + z * (c - s)
            states[t, :, way * h : way * h + h] = s
    e = states @ p["att"]
    a = np.exp(e - e.max(0))
    a /= a.sum(0)
    pooled = (states * a[:, :, None]).sum(0)
    q = 1 / (1 + np.exp(-np.clip(pooled @ p["out"] + p["out_b"][0], -30, 30)))
    g = {k: np.zeros_like(v) for k, v in p.items()}
    do = ((q - y) / n).astype(np.float32)
    g["out"], g["out_b"][0] = pooled.T @ do, do.sum()
    dpool = do[:, None] * p["out"]
    da = (states * dpool[None]).sum(2)
    de = a * (da - (a * da).sum(0))
    g["att"] = np.einsum("tnk,tn->k", states, de)
    dstates = a[:, :, None] * dpool[None] + de[:, :, None] * p["att"]
    dX = np.zeros_like(X)
    inside = lambda v, k: (np.abs(v) < k).astype(np.float32) + 0.05  # noqa: E731  a little slope outside keeps units alive
    for way, u in enumerate("fb"):
        U, W = p[f"rec_{u}"], p[f"in_{u}"]
        ds = np.zeros((n, h), np.float32)
        for t in range(WIDTH - 1, -1, -1) if way == 0 else range(WIDTH):
            s, raw, z, r, pre, c = kept[u, t]
            ds = ds + dstates[t, :, way * h : way * h + h]
            dc = ds * z * inside(pre, 1)
            dz = ds * (c - s)
            drs = dc @ U[:, 2 * h :].T
            dr = drs * s
            draw = np.concatenate([dz, dr], 1) * 0.25 * inside(raw, 2)
            g[f"rec_{u}"][:, 2 * h :] += (r * s).T @ dc
            g[f"rec_{u}"][:, : 2 * h] += s.T @ draw
            dx = np.concatenate([draw, dc], 1)
            g[f"b_{u}"] += dx.sum(0)
            g[f"in_{u}"] += X[ids[:, t]].T @ dx
            np.add.at(dX, ids[:, t], dx @ W.T)
            ds = ds * (1 - z) + drs * r + draw @ U[:, : 2 * h].T
    if words:
        np.add.at(g["word"], [net.words.get(w, 0) for w in words], dX[1:])
        rows, start = gram_rows(words)
        size = np.diff(np.append(start, len(rows)))
        np.add.at(g["gram"], rows, np.repeat(dX[1:] / size[:, None], size, axis=0))
    return g


def train_toxicity(docs: DataFrame, labels: DataFrame, most: int = 6000, longest: int = 20_000) -> Network:
    """The network from at most `most` labelled documents outside the held-out fold; longer ones than `longest` characters are
    left out of training only, so that what the driver gets is bounded."""
    rows = labelled(docs.filter(F.length("text") <= longest), labels, "toxic", 5, 0, most).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return fit_network([r["text"] for r in rows], np.array([r["y"] for r in rows]))


_scorers: dict[int, Scorer] = {}
caches.append(_scorers)


def scorer(shared) -> Scorer:
    """One for each broadcast network and Python worker."""
    key = id(shared.value)
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(shared.value)
    return _scorers[key]


def score_toxicity(docs: DataFrame, net: Network, threshold: float = 0.5) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(b):
        s = scorer(shared).scores(b.column("text").to_pylist())
        return {"doc_id": b.column("doc_id"), "score": s, "predicted": (s >= threshold).astype(np.int32)}

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = map_slices(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double, predicted int")
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, net: Network, threshold: float = 0.5) -> DataFrame:
    """docs, in the same columns, without those that score the threshold or more."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for b in slices(batches):
            s = scorer(shared).scores(b.column("text").to_pylist())
            yield b.filter(pa.array(s < threshold, pa.bool_()))
        forget()

    return docs.mapInArrow(run, docs.schema)
