"""Vector best-fit packing of token pieces into sequences.

Each sequence has three capacities: tokens, documents and attention cost (the sum of squared lengths).  Pieces are dealt over
tasks by a hash; a task packs its pieces in chunks of bounded size, longest first: each goes to the open sequence that can take
it under every capacity and that scores best, by the weighted norm of what would remain there or by the weighted dot product of
demand and residual.  The few sequences that a chunk leaves partly filled are then packed once more, as units, across chunks.

With the default capacities tokens alone can reject: a piece has a token at least, and the squares of lengths that add up to 4096
add up to 4096 squared at most, which a whole piece needs.  Documents and cost then decide among the sequences that a piece fits,
through their weights; lower capacities of theirs reject, too.

Rows: a null text counts as empty (one piece with the closing id alone); repeated rows are packed each; an empty table gives no
rows; further columns are ignored.  No piece is dropped: one that exceeds a capacity alone raises an error."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import map_slices, shuffle_partitions, stored, task_number


@dataclass(frozen=True)
class Capacity:
    tokens: int = 4096
    documents: int = 4096
    cost: float = 4096.0**2
    #: Weights of the three in the score.
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    #: "norm" or "dot".
    score: str = "norm"
    #: Pieces that one packing step holds.
    chunk: int = 8192
    #: A sequence with this share of its tokens free is packed once more.
    loose: float = 0.01


class WordIds(dict):
    """Word (bytes) -> its token ids as little-endian bytes; no token reaches over a blank, so texts are made of their words.

    A word of letters between ASCII signs goes to the vocabulary's merge model directly, as its pre-tokeniser would cut it
    just so; any other word goes through the whole tokeniser."""

    plain = re.compile(r"([!-&(-/:;=-@\[-`{}~]*)([^\W\d_]*)([!-&(-/:;=-@\[-`{}~]*)")

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.single = Tokenizer.from_file(path), most, {}
        self.model = self.tokenizer.model
        spare = iter(range(256, 512))  # byte-level vocabularies write a byte that is no printable sign as one of these
        self.signs = {b: b if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else next(spare) for b in range(256)}

    def whole(self, s: str) -> list[int]:
        return self.tokenizer.encode(s, add_special_tokens=False).ids

    def part(self, s: str) -> list[int]:
        if len(s) == 1:
            if s not in self.single:
                self.single[s] = self.whole(s)
            return self.single[s]
        return [t.id for t in self.model.tokenize(s if s.isascii() else s.encode().decode("latin1").translate(self.signs))]

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        if word[-1:] in (b",", b".", b"|") and word[-2:-1].isalpha():  # a sign after a letter is a token of its own
            out = self[word] = self[word[:-1]] + self[word[-1:]]
            return out
        s, m = word.decode(), None
        if len(word) > 1 and word.isalpha() and word.islower():  # ASCII letters
            out = self[word] = array("I", [t.id for t in self.model.tokenize(s)]).tobytes()
            return out
        if s.isascii() or "Σ" not in s and "İ" not in s and is_normalized("NFC", s):
            low = s.lower()
            m = self.plain.fullmatch(low)
            if m and (m[2] and not m[2].isalpha() or not m[2] and m[3] or "<|" in low):
                m = None
        ids = self.whole(s) if m is None else [i for x in m.groups() if x for i in self.part(x)]
        out = self[word] = array("I", ids).tobytes()
        return out

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        get, out = self.__getitem__, []
        for t in texts:
            raw = (t or "").encode()
            out.append(np.frombuffer(b"".join(map(get, (raw if b"<|" in raw else raw.lower()).split())), "<u4"))
        return out


_word_ids: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _word_ids:
        _word_ids[path] = WordIds(path)
    return _word_ids[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, most: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece of at most `most` ids of each document; the document's ids end with end_id."""

    def make(path):
        enc = word_ids(path)
        tail = np.array([end_id], "<u4")

        def run(b):
            out = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc, ids in zip(b.column("doc_id").to_pylist(), enc.ids(b.column("text").to_pylist()), strict=True):
                ids = np.concatenate([ids, tail])
                for k, s in enumerate(range(0, len(ids), most)):
                    part = ids[s : s + most]
                    for c, v in zip(out, (doc, k, s, len(part), zlib.crc32(part.tobytes())), strict=True):
                        out[c].append(v)
            return out

        return run

    return map_slices(docs.select(F.col("doc_id").cast("long"), "text"), make, PIECES, 256, lambda: tokenizer)


def best_fit(length: np.ndarray, docs: np.ndarray, cost: np.ndarray, cap: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each item (numbered from 0) and its offset there; items are taken longest first, ties by position."""
    n = len(length)
    full = np.array([cap.tokens, cap.documents, cap.cost], float)
    demand = np.stack([length, docs, cost], 1) / full
    if n and (demand > 1 + 1e-12).any():
        raise ValueError("a piece exceeds a capacity by itself")
    w = np.array(cap.weights)
    bins, offset = np.empty(n, np.int64), np.zeros(n, np.int64)
    room, used, number = np.empty((256, 3)), np.empty(256, np.int64), np.empty(256, np.int64)
    size = made = 0
    order = np.argsort(-length, kind="stable")
    for at, i in enumerate(order):
        d, best = demand[i], -1
        if length[i] < cap.tokens and size:
            r = room[:size]
            fits = np.flatnonzero((r[:, 0] >= d[0] - 1e-12) & (r[:, 1] >= d[1] - 1e-12) & (r[:, 2] >= d[2] - 1e-12))
            if len(fits):
                r = r[fits]
                left = r - d
                s = (left * left) @ w if cap.score == "norm" else -((r * d) @ w)
                best = fits[np.argmin(s)]
        if best < 0:
            if size == len(room):
                room, used, number = np.concatenate([room, room]), np.concatenate([used, used]), np.concatenate([number, number])
            best, room[size], used[size], number[size] = size, 1.0, 0, made
            size, made = size + 1, made + 1
        bins[i], offset[i] = number[best], used[best]
        room[best] -= d
        used[best] += length[i]
        if at % 64 == 63 and at + 1 < n:  # full ones go
            least = length[order[-1]] / cap.tokens
            keep = np.flatnonzero(room[:size, 0] >= least - 1e-12)
            if len(keep) < size:
                size = len(keep)
                room[:size], used[:size], number[:size] = room[keep], used[keep], number[keep]
    return bins, offset


def chunks(frames: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for f in frames:
        while len(f):
            part, f = f.iloc[: rows - n], f.iloc[rows - n :]
            held.append(part)
            n += len(part)
            if n == rows:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


PLACED = PIECES.replace("doc_id long", "doc_id string") + ", sequence_id long, offset long, fill long, loose boolean"


def pack(pieces: DataFrame, cap: Capacity = Capacity()) -> DataFrame:
    """pieces with sequence_id, offset and n_tokens (the sequence's fill)."""
    spark = pieces.sparkSession
    n = shuffle_partitions(spark)

    def first(frames):
        made = task_number() << 32
        for f in chunks(frames, cap.chunk):
            length = f["length"].to_numpy(np.int64)
            bins, offset = best_fit(length, np.ones(len(f)), length.astype(float) ** 2, cap)
            fill = np.bincount(bins, length).astype(np.int64)
            f = f[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(
                sequence_id=bins + made, offset=offset, fill=fill[bins], loose=fill[bins] < (1 - cap.loose) * cap.tokens
            )
            made += len(fill)
            yield f

    key = F.xxhash64("doc_id", "piece", "ids_crc32")
    placed = stored(
        pieces.select("*", key.alias("__key"))
        .withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas has no whole numbers beside nulls
        .repartition(n, "__key")
        .sortWithinPartitions("__key", "doc_id", "piece", "length")
        .mapInPandas(first, PLACED)
    )
    units = (
        placed.filter("loose")
        .groupBy("sequence_id")
        .agg(F.max("fill").alias("fill"), F.count("*").alias("docs"), F.sum(F.col("length") * F.col("length")).alias("cost"))
    )

    def second(frames):
        made = (1 << 62) + (task_number() << 32)
        for f in chunks(frames, cap.chunk):
            fill = f["fill"].to_numpy(np.int64)
            bins, offset = best_fit(fill, f["docs"].to_numpy(float), f["cost"].to_numpy(float), cap)
            yield pd.DataFrame({"old": f["sequence_id"], "new": bins + made, "base": offset, "all": np.bincount(bins, fill).astype(np.int64)[bins]})
            made += int(bins.max()) + 1 if len(bins) else 0

    moved = stored(units.repartition(max(1, n // 32)).mapInPandas(second, "old long, new long, base long, `all` long"))
    joined = placed.filter("loose").join(moved, F.col("sequence_id") == F.col("old"))
    columns = [F.col("doc_id").cast(pieces.schema["doc_id"].dataType).alias("doc_id"), "piece", "start", "length", "ids_crc32"]
    return (
        placed.filter("not loose")
        .select(*columns, "sequence_id", "offset", F.col("fill").alias("n_tokens"))
        .unionByName(
            joined.select(
                *columns,
                F.col("new").alias("sequence_id"),
                (F.col("offset") + F.col("base")).alias("offset"),
                F.col("all").alias("n_tokens"),
            )
        )
    )


def pack_documents(docs: DataFrame, tokenizer: str, cap: Capacity = Capacity(), end_id: int = 1) -> DataFrame:
    return pack(token_pieces(docs, tokenizer, cap.tokens, end_id), cap)
