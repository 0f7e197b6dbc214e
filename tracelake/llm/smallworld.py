"""Hierarchical navigable small-world graph of unit vectors, built and searched for many vectors in step.

Each node stands in layer 0 and, with a chance of 1 in `links`, in each further one.  A search walks down the layers with a beam of
the best nodes seen; beams of a batch of queries move together, so that each move is a few array operations for all of them.
Nodes come in batches: those of a batch find their neighbours by a search in the graph so far and among themselves, and keep diverse
ones (no neighbour is nearer to another one kept than to the node, as far as enough are left)."""

from __future__ import annotations

import io
from dataclasses import dataclass, field

import numpy as np

NONE = -1


@dataclass
class SmallWorld:
    x: np.ndarray  # unit vectors, float32; rows from `size` on are not yet in the graph
    links: int = 16
    size: int = 0
    nbr: list[np.ndarray] = field(default_factory=list)  # for each layer: node -> neighbours or NONE
    entry: int = 0
    top: int = 0

    def degree(self, layer: int) -> int:
        return self.links if layer else 2 * self.links

    def beam(self, layer: int, q: np.ndarray, entry: np.ndarray, width: int, moves: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The `width` best nodes found for each query (NONE where there are fewer) and their cosines, from entry nodes."""
        x, nbr = self.x, self.nbr[layer]
        n, width = len(q), max(width, entry.shape[1])
        seen = np.zeros((n, self.size), bool)
        ids = np.full((n, width), NONE, np.int64)
        sim = np.full((n, width), -np.inf, np.float32)
        open_ = np.zeros((n, width), bool)
        e = entry.shape[1]
        ids[:, :e] = entry
        known = entry >= 0
        r, c = np.nonzero(known)
        seen[r, entry[r, c]] = True
        sim[r, c] = np.einsum("ij,ij->i", x[entry[r, c]], q[r])
        open_[r, c] = True
        at = np.arange(n)
        moves = min(moves, width)
        while len(at):
            waiting = np.where(open_[at], sim[at], -np.inf)
            top = np.argpartition(-waiting, moves - 1, axis=1)[:, :moves] if moves < width else np.broadcast_to(np.arange(width), waiting.shape)
            live = np.take_along_axis(waiting, top, 1) > -np.inf
            some = live.any(1)
            at, top, live = at[some], top[some], live[some]
            if not len(at):
                break
            rows = at[:, None]
            open_[rows, top] &= ~live
            found, fresh = [], []
            for j in range(top.shape[1]):
                near = nbr[np.where(live[:, j], ids[at, top[:, j]], 0)]
                new = live[:, j, None] & (near >= 0) & ~seen[rows, near]
                r, c = np.nonzero(new)
                seen[at[r], near[r, c]] = True
                found.append(near)
                fresh.append(new)
            near, new = np.concatenate(found, 1), np.concatenate(fresh, 1)
            r, c = np.nonzero(new)
            s = np.full(near.shape, -np.inf, np.float32)
            s[r, c] = np.einsum("ij,ij->i", x[near[r, c]], q[at[r]])
            all_sim = np.concatenate([sim[at], s], 1)
            best = np.argpartition(-all_sim, width - 1, axis=1)[:, :width]
            all_ids = np.concatenate([ids[at], np.where(new, near, NONE)], 1)
            all_open = np.concatenate([open_[at], new], 1)
            sim[at], ids[at], open_[at] = (np.take_along_axis(a, best, 1) for a in (all_sim, all_ids, all_open))
        return ids, sim

    def descend(self, q: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Beams of all layers, layer 0 first."""
        out, entry = [], np.full((len(q), 1), self.entry, np.int64)
        for layer in range(len(self.nbr) - 1, -1, -1):
            ids, sim = self.beam(layer, q, entry, width if layer == 0 else min(width, self.links))
            out.append((ids, sim))
            few = np.argsort(-sim, axis=1, kind="stable")[:, :4]
            entry = np.take_along_axis(ids, few, 1)
        return out[::-1]

    def search(self, q: np.ndarray, width: int, batch: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """The nodes found for each query, and their cosines."""
        width = min(width, self.size)
        found = [self.descend(q[i : i + batch], width)[0] for i in range(0, len(q), batch)]
        wide = max((f[0].shape[1] for f in found), default=0)
        pad = [(np.pad(i, ((0, 0), (0, wide - i.shape[1])), constant_values=NONE), np.pad(s, ((0, 0), (0, wide - s.shape[1])), constant_values=-np.inf)) for i, s in found]
        return (np.concatenate([i for i, _ in pad]), np.concatenate([s for _, s in pad])) if pad else (np.empty((0, 0), np.int64), np.empty((0, 0), np.float32))

    def diverse(self, cand: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates, best first, up to `most` that are no nearer to one kept than to the row's node, and the best of the
        others behind them."""
        order = np.argsort(-sim, axis=1, kind="stable")
        cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
        valid = np.isfinite(sim)
        v = self.x[np.where(valid, cand, 0)]
        closer = v @ v.transpose(0, 2, 1) > sim[:, :, None]
        keep = np.zeros(cand.shape, bool)
        for c in range(cand.shape[1]):
            keep[:, c] = valid[:, c] & ~(closer[:, c] & keep).any(1) & (keep.sum(1) < most)
        rank = np.argsort(np.where(keep, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :most]
        out = np.where(np.take_along_axis(valid, rank, 1), np.take_along_axis(cand, rank, 1), NONE)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=NONE)

    def connect(self, layer: int, nodes: np.ndarray, cand: np.ndarray, sim: np.ndarray) -> None:
        """Gives nodes their neighbours among candidates, and those the way back."""
        nbr, most = self.nbr[layer], self.degree(layer)
        nbr[nodes] = self.diverse(cand, sim, most)
        r, c = np.nonzero(nbr[nodes] >= 0)
        to, back = nbr[nodes][r, c], nodes[r]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        ends, first, count = np.unique(to, return_index=True, return_counts=True)
        more = np.full((len(ends), min(int(count.max(initial=0)), most)), NONE, np.int64)
        place = np.arange(len(to)) - np.repeat(first, count)
        keep = place < more.shape[1]
        more[np.repeat(np.arange(len(ends)), count)[keep], place[keep]] = back[keep]
        both = np.concatenate([nbr[ends], more], 1)
        both[:, most:][(both[:, :most, None] == more[:, None]).any(1)] = NONE  # the way back is there
        held = (both >= 0).sum(1)
        fits = held <= most
        packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
        nbr[ends[fits]] = packed[fits][:, :most]
        full = np.flatnonzero(~fits)
        for i in range(0, len(full), 512):
            at = full[i : i + 512]
            own = packed[at][:, : int(held[at].max())]
            s = np.where(own >= 0, np.einsum("ncd,nd->nc", self.x[np.maximum(own, 0)], self.x[ends[at]]), -np.inf)
            nbr[ends[at]] = self.diverse(own, s, most)

    def add(self, nodes: np.ndarray, level: np.ndarray, beams: list[tuple[np.ndarray, np.ndarray]], among: int = 16) -> None:
        """Puts the next nodes into the graph, with the beams of a search for them in the graph so far."""
        self.size = int(nodes[-1]) + 1
        while len(self.nbr) <= level.max():
            self.nbr.append(np.full((len(self.x), self.degree(len(self.nbr))), NONE, np.int64))
        own = self.x[nodes] @ self.x[nodes].T
        np.fill_diagonal(own, -np.inf)
        for layer in range(int(level.max()) + 1):
            at = np.flatnonzero(level >= layer)
            s = own[np.ix_(at, at)]
            few = np.argsort(-s, axis=1, kind="stable")[:, :among]
            cand, sim = nodes[at][few], np.take_along_axis(s, few, 1)
            if layer < len(beams):
                cand, sim = np.concatenate([cand, beams[layer][0][at]], 1), np.concatenate([sim, beams[layer][1][at]], 1)
            self.connect(layer, nodes[at], cand, sim)
        top = int(level.max())
        if nodes[0] == 0 or top > self.top:
            self.entry, self.top = int(nodes[int(level.argmax())]), top

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, size=self.size, entry=self.entry, links=self.links, layers=len(self.nbr), **{f"n{i}": a[: self.size].astype(np.int32) for i, a in enumerate(self.nbr)})
        return out.getvalue()


def loaded(blob: bytes, x: np.ndarray) -> SmallWorld:
    z = np.load(io.BytesIO(blob))
    nbr = [z[f"n{i}"].astype(np.int64) for i in range(int(z["layers"]))]
    return SmallWorld(x, int(z["links"]), int(z["size"]), nbr, int(z["entry"]))


def levels(n: int, links: int, seed: int) -> np.ndarray:
    """The highest layer of each node."""
    u = np.random.default_rng(seed).random(n)
    return np.minimum(np.floor(-np.log1p(-u) / np.log(links)), 6).astype(np.int64)
