"""Benchmark decontamination by winnowing.

A text's 5-gram hashes are thinned to the smallest of each 6 in a row, on both sides alike; so two texts that share 10 words in a
row share a kept hash there.  Where a document has a kept hash of the benchmark, the 10-word windows around it are compared with
the benchmark's windows, which extends each hit to all the words that it covers.  Items of fewer than 10 words are one window and
are looked up by their own length.

The windows' hashes are broadcast while the index takes at most `most_bytes`; a larger benchmark goes through a join of the
kept hashes and a second join of the windows.

Rows: a null text has no words; an item without words has no window; repeated rows each count, a repeated item_id once; an item
with a null item_id has windows like any other, but no id to be named or counted by; an empty benchmark hits nothing; further
columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import alnum_words, gram_hashes, map_slices, slices, stored, word_hashes

GRAM, RUN = 5, 6
WINDOW = GRAM + RUN - 1


def winnowed(grams: np.ndarray) -> np.ndarray:
    """Positions of the (leftmost) smallest of each RUN grams in a row."""
    n = len(grams) - RUN + 1
    if n <= 0:
        return np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, RUN)
    return np.unique(view.argmin(1) + np.arange(n))


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, size, window, marks): the hash of each distinct window of each item, with the kept hashes inside it; the id is
    text."""

    def run(b):
        out = {"item_id": [], "size": [], "window": [], "marks": []}
        for item, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            h = word_hashes.of(alnum_words(text))
            if not len(h):
                continue
            size = min(len(h), WINDOW)
            grams = gram_hashes(h, GRAM)
            for i, w in enumerate(as_long(gram_hashes(h, size)).tolist()):
                part = grams[i : i + RUN] if size == WINDOW else grams[:0]
                mark = as_long(part[part.argmin() : part.argmin() + 1]).tolist() if len(part) else []
                for c, v in zip(out, (item, size, w, mark), strict=True):
                    out[c].append(v)
        return out

    items = benchmark.select(F.col("item_id").cast("string"), "text")
    return map_slices(items, run, "item_id string, size int, window long, marks array<long>").distinct()


#: Largest index that is sent to all tasks.
MOST_BYTES = 64 << 20


class Index:
    """A benchmark's windows as sorted arrays: for each size the hashes, and where each one's items begin among the items' numbers."""

    def __init__(self, windows: pa.Table):
        ids = windows.column("item_id").combine_chunks().dictionary_encode()
        self.names = ids.dictionary.to_pylist()
        items = ids.indices.fill_null(-1).to_numpy()  # an item without an id is hit, but not listed
        self.marks = np.unique(windows.column("marks").combine_chunks().flatten().to_numpy())
        size, window = windows.column("size").to_numpy(), windows.column("window").to_numpy()
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in np.unique(size).tolist():
            own = np.flatnonzero(size == n)
            own = own[np.argsort(window[own], kind="stable")]
            keys, first = np.unique(window[own], return_index=True)
            self.sizes[n] = keys, np.append(first, len(own)), items[own]

    def listed(self, items: set[int]) -> list[str]:
        return sorted(self.names[i] for i in items if i >= 0)


def index_bytes(windows: DataFrame) -> int:
    """About what the index takes: its arrays, and the ids as text."""
    return windows.agg(F.sum(F.length(F.coalesce("item_id", F.lit(""))) + 40)).first()[0] or 0


def found_in(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place of each x among the keys, or -1."""
    if not len(sorted_keys) or not len(x):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == x, at, -1)


def around(marks: np.ndarray, n: int) -> np.ndarray:
    """Starts of the windows that hold the gram at one of the marks."""
    starts = (marks[:, None] - np.arange(RUN)[None, :]).ravel()
    return np.unique(starts[(starts >= 0) & (starts <= n - WINDOW)])


def covered(starts: np.ndarray, size: np.ndarray | int, n: int) -> int:
    """Words inside at least one of the windows."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def scan(text: str | None, index: Index) -> tuple[int, int, set]:
    """Words, hit words and the numbers of the items hit."""
    h = word_hashes.of(alnum_words(text))
    n, starts, sizes, items = len(h), [], [], set()
    for size, (keys, first, of) in index.sizes.items():
        if size > n:
            continue
        if size == WINDOW:
            grams = as_long(gram_hashes(h, GRAM))
            kept = winnowed(grams.view(np.uint64))
            marks = kept[found_in(index.marks, grams[kept]) >= 0]
            if not len(marks):
                continue
            at = around(marks, n)
            w = as_long(gram_hashes(h, WINDOW, at))
        else:
            w = as_long(gram_hashes(h, size))
            at = np.arange(len(w))
        place = found_in(keys, w)
        ok = place >= 0
        if ok.any():
            starts.append(at[ok])
            sizes.append(np.full(ok.sum(), size))
            for p in np.unique(place[ok]).tolist():
                items.update(of[first[p] : first[p + 1]].tolist())
    if not starts:
        return n, 0, items
    return n, covered(np.concatenate(starts), np.concatenate(sizes), n), items


def find_leaks(docs: DataFrame, benchmark: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """docs' doc_id with n_words, n_hit and items (the ids, as sorted strings).

    The index of a benchmark is sent to all tasks if it takes up to most_bytes (some 40 bytes a window); a larger one is joined,
    with the same rows."""
    windows = stored(item_windows(benchmark))
    if index_bytes(windows) > most_bytes:
        return find_leaks_joined(docs, windows)
    shared = docs.sparkSession.sparkContext.broadcast(Index(windows.toArrow()))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make(_):
        index = shared.value

        def run(b):
            got = [scan(t, index) for t in b.column("text").to_pylist()]
            return {
                "doc_id": b.column("doc_id"),
                "n_words": [x[0] for x in got],
                "n_hit": [x[1] for x in got],
                "items": [index.listed(x[2]) for x in got],
            }

        return run

    schema = f"doc_id {kind}, n_words long, n_hit long, items array<string>"
    return map_slices(docs.select("doc_id", "text"), make, schema, 256, lambda: None)


def find_leaks_joined(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """The same rows for a benchmark of any size."""
    return numbered_leaks(stored(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))), windows).drop("row")


def numbered_leaks(numbered: DataFrame, windows: DataFrame) -> DataFrame:
    """The same rows, with their row numbers: documents are told apart by a number that is stored with them."""
    numbered = numbered.select("doc_id", "text", "row")
    small = [r["size"] for r in windows.filter(F.col("size") < WINDOW).select("size").distinct().collect()]  # 9 at most
    marks = windows.select(F.explode("marks").alias("mark")).distinct()

    def kept(b):
        out = {"row": [], "pos": [], "mark": []}
        for row, text in zip(b.column("row").to_pylist(), b.column("text").to_pylist(), strict=True):
            grams = gram_hashes(word_hashes.of(alnum_words(text)), GRAM)
            pos = winnowed(grams)
            out["row"] += [row] * len(pos)
            out["pos"] += pos.tolist()
            out["mark"] += as_long(grams[pos]).tolist()
        return out

    hits = map_slices(numbered, kept, "row long, pos int, mark long").join(marks, "mark", "left_semi")
    hits = hits.groupBy("row").agg(F.collect_set("pos").alias("pos"))  # at most one for each word of the document

    def candidates(b):
        out = {"row": [], "size": [], "start": [], "window": []}
        for row, text, pos in zip(*(b.column(c).to_pylist() for c in ("row", "text", "pos")), strict=True):
            h = word_hashes.of(alnum_words(text))
            for size in [*small, WINDOW]:
                w = as_long(gram_hashes(h, size))
                at = np.arange(len(w)) if size < WINDOW else around(np.array(sorted(pos or []), np.int64), len(h))
                out["row"] += [row] * len(at)
                out["size"] += [size] * len(at)
                out["start"] += at.tolist()
                out["window"] += w[at].tolist()
        return out

    near = map_slices(numbered.join(hits, "row", "left"), candidates, "row long, size int, start int, window long")
    known = windows.select("size", "window").distinct()
    places = near.join(known, ["size", "window"], "left_semi").groupBy("row").agg(
        F.collect_list(F.struct("start", "size")).alias("places")
    )
    items = near.join(windows, ["size", "window"]).select("row", F.col("item_id").alias("item")).distinct()
    items = items.groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))

    def counted(b):
        out = {"row": b.column("row"), "doc_id": b.column("doc_id"), "items": b.column("items"), "n_words": [], "n_hit": []}
        for text, places in zip(b.column("text").to_pylist(), b.column("places").to_pylist(), strict=True):
            n = len(alnum_words(text))
            at = np.array([(p["start"], p["size"]) for p in places or []], np.int64).reshape(-1, 2)
            out["n_words"].append(n)
            out["n_hit"].append(covered(at[:, 0], at[:, 1], n) if len(at) else 0)
        return out

    kind = numbered.schema["doc_id"].dataType.simpleString()
    return map_slices(
        numbered.join(places, "row", "left").join(items, "row", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>"))),
        counted,
        f"row long, doc_id {kind}, n_words long, n_hit long, items array<string>",
    )


def leak_digest(docs: DataFrame, benchmark: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    return find_leaks(docs, benchmark, most_bytes).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """docs, in the same columns, without those in which a window of the benchmark occurs.  Where the benchmark is small
    the rows are filtered as they are read; else by their stored row numbers."""
    windows = stored(item_windows(benchmark))
    if index_bytes(windows) > most_bytes:
        numbered = stored(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")))
        bad = numbered_leaks(numbered.select("doc.doc_id", "doc.text", "row"), windows).filter("n_hit > 0").select("row")
        return numbered.join(bad, "row", "left_anti").select("doc.*")
    shared = docs.sparkSession.sparkContext.broadcast(Index(windows.toArrow()))

    def run(batches):
        for b in slices(batches):
            clean = pa.array([not scan(t, shared.value)[1] for t in b.column("text").to_pylist()], pa.bool_())
            yield b.filter(clean)

    return docs.mapInArrow(run, docs.schema)
