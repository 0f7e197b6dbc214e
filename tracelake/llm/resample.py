"""Importance resampling towards a target: documents drawn by how much likelier the target makes their words, with noise.

Words are hashed to a fixed number of buckets.  Counts of the buckets in the corpus and in the target give an array of gains, whose
size is a parameter, and a document's weight is the floored mean of its words' gains.  A noise that depends on the id alone turns the
highest scores into a weighted draw without replacement.

Ranks come from parallel sorting by regular sampling.  Every run (a partition of the scored table) is sorted locally and gives a
fixed number of its rows at regular places; the sorted samples of all runs give regular splitters, each of them weighted by
the rows it stands for.  Splitters cut the order into segments, and counts of the segments' rows, summed up, give each one's first
rank.  Only segments that the draw reaches are exchanged; each is merged where it lands, and a row's rank is its place there behind
the segment's first one.  The order is total (score, doc_id, place in the stored table), so that equal rows are cut apart like others
and no segment depends on ties.

Rows: a null text has no words, weight 0 and no rank; a null doc_id draws the noise of an empty id and comes behind others of its
score; repeated rows are drawn each, in any order among themselves; an empty table gives no rows; a target without words makes no
difference between words but their rareness; further columns are ignored."""

from __future__ import annotations

import hashlib
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import alnum_words, caches, forget, map_slices, shuffle_partitions, slices, stored

#: Words -> bucket, in each Python worker; emptied when it holds too many words, and at a task's end.
_buckets: dict[tuple[bytes, ...], int] = {}
caches.append(_buckets)


def buckets_of(words: list[bytes], n: int, longest: int, most: int = 300_000) -> np.ndarray:
    """The bucket of every run of 1 to `longest` consecutive words, joined by a blank."""
    if len(_buckets) > most:
        _buckets.clear()
    out = np.empty(sum(max(0, len(words) - k) for k in range(longest)), np.int64)
    i = 0
    for k in range(1, longest + 1):
        for run in zip(*(words[j:] for j in range(k)), strict=False):
            b = _buckets.get(run)
            if b is None:
                b = _buckets[run] = zlib.crc32(b" ".join(run))
            out[i] = b
            i += 1
    return out % n


def bucket_counts(docs: DataFrame, n: int, longest: int) -> np.ndarray:
    """How many features of all texts fall into each bucket; a task gives its sums once."""

    def run(batches):
        total = np.zeros(n, np.int64)
        for b in slices(batches):
            for text in b.column("text").to_pylist():
                total += np.bincount(buckets_of(alnum_words(text), n, longest), minlength=n)
        forget()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    sums = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n, np.int64)  # as many as buckets
    out[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of how much likelier a bucket is in the target, every bucket counted once more."""
    n = len(corpus)
    return np.floor(1000 * np.log(((target + 1) * (int(corpus.sum()) + n)) / ((corpus + 1) * (int(target.sum()) + n)))).astype(np.int64)


def noise(doc_id: int | None, seed: str) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return int(np.floor(-1000 * np.log(-np.log((h + 0.5) / 4294967296))))


def scored(docs: DataFrame, gains: np.ndarray, longest: int, seed: str) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight, score) of docs (row, doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def run(b):
        out = {"row": b.column("row"), "doc_id": b.column("doc_id"), "n_words": [], "n_features": [], "weight": [], "score": []}
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            words = alnum_words(text)
            at = buckets_of(words, len(shared.value), longest)
            weight = int(shared.value[at].sum()) // len(at) if len(at) else 0
            for c, x in (("n_words", len(words)), ("n_features", len(at)), ("weight", weight), ("score", weight + noise(doc_id, seed))):
                out[c].append(x)
        return out

    schema = "row long, doc_id long, n_words long, n_features long, weight long, score long"
    return map_slices(docs.select("row", F.col("doc_id").cast("long"), "text"), run, schema)


def packed(keys: list[np.ndarray]) -> np.ndarray:
    """Keys of several 64-bit numbers as strings of bytes in the same order."""
    flipped = np.stack([k.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63) for k in keys], 1)
    return flipped.astype(">u8").view(f"S{8 * len(keys)}").ravel()


def regular_samples(runs: DataFrame, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows at regular places of every sorted run, and how many rows each one stands for.  A task keeps every stride-th row and
    doubles the stride when it holds twice as many as asked."""
    names = runs.columns

    def run(batches):
        kept, stride, n = np.empty((0, len(names)), np.int64), 1, 0
        for b in batches:
            rows = np.stack([b.column(i).to_numpy() for i in range(len(names))], 1)
            kept = np.concatenate([kept, rows[(np.arange(n + 1, n + 1 + len(rows)) % stride) == 0]])
            n += len(rows)
            while len(kept) > 2 * samples:
                kept, stride = kept[1::2], 2 * stride
        if len(kept):
            yield pa.RecordBatch.from_arrays([*(pa.array(kept[:, i]) for i in range(len(names))), pa.array(np.full(len(kept), stride))], [*names, "stands"])

    got = runs.mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "stands"])).toArrow()
    keys = packed([got.column(c).to_numpy() for c in names])
    order = np.argsort(keys, kind="stable")
    return keys[order], got.column("stands").to_numpy()[order]


def ranked(rows: DataFrame, order: list[Column], draw: int, samples: int = 64, most_samples: int = 200_000, segments: int | None = None) -> DataFrame:
    """rows with `rank`, from 1 in the order of these columns - whole numbers, never null, no two rows alike in all of them - and null
    behind the first `draw` rows.

    rows should be a stored table, as it is read for samples, counts and the exchange.  The driver gets at most twice `samples`
    rows of a run, fewer where there are many runs (about `most_samples` in all), and a count for each segment."""
    if not draw:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    segments = segments or 4 * shuffle_partitions(rows.sparkSession)
    names = [f"_key{i}" for i in range(len(order))]
    keyed = rows.select(F.struct("*").alias("_row"), *[c.cast("long").alias(n) for n, c in zip(names, order, strict=True)])
    runs = keyed.select(*names).sortWithinPartitions(*names)
    keys, stands = regular_samples(runs, max(2, min(samples, most_samples // max(1, runs.rdd.getNumPartitions()))))
    places = np.searchsorted(np.cumsum(stands), np.arange(1, segments) * (stands.sum() / segments))
    splitters = np.unique(keys[np.minimum(places, len(keys) - 1)])  # the last row of each segment but the last one

    def cut(batches):
        for b in batches:
            if b.num_rows:
                key = packed([b.column(c).to_numpy() for c in names])
                segment = np.searchsorted(splitters, key, side="left").astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(segment)], [*b.schema.names, "_segment"])

    kinds = ", ".join(f"{n} long" for n in names)
    cut_keys = keyed.select(*names).mapInArrow(cut, f"{kinds}, _segment int")
    counts = np.zeros(len(splitters) + 1, np.int64)
    for r in cut_keys.groupBy("_segment").count().collect():  # one for each segment
        counts[r["_segment"]] = r["count"]
    before = np.cumsum(counts) - counts
    reached = int(np.searchsorted(before, draw, side="left"))  # segments that begin within the draw

    whole = keyed.mapInArrow(cut, f"_row {rows.schema.simpleString()}, {kinds}, _segment int")
    # Each segment is merged by itself; its places follow the rows of those before it.
    place = F.row_number().over(Window.partitionBy("_segment").orderBy(*names))
    first = F.get(F.lit(before[:reached].tolist()).cast("array<long>"), F.col("_segment"))
    near = whole.filter(F.col("_segment") < reached).select("_row.*", (first + place).alias("rank"))
    near = near.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    return near.unionByName(whole.filter(F.col("_segment") >= reached).select("_row.*", F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024") -> DataFrame:
    """(row, doc_id, n_features, weight, score, rank) of every row of docs, row being its number if docs has one.  Of the documents
    of at least `least_words` words, the `percent` of them with the highest scores are drawn and get their ranks."""
    if "row" not in docs.columns:
        docs = docs.withColumn("row", F.monotonically_increasing_id())
    gains = gains_of(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    table = stored(scored(docs, gains, longest, seed))
    able = F.col("n_words") >= least_words
    draw = table.filter(able).count() * percent // 100
    # Equal scores stand by id, rows without one last, and equal rows by their place.
    order = [-F.col("score"), F.coalesce("doc_id", F.lit((1 << 63) - 1)), F.col("row")]
    out = ranked(table.filter(able), order, draw).unionByName(table.filter(~able).withColumn("rank", F.lit(None).cast("long")))
    return out.select("row", "doc_id", "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of docs that are drawn, in their columns."""
    numbered = stored(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")))
    ranks = resample(numbered.select("row", "doc.doc_id", "doc.text"), target, **how)
    return numbered.join(ranks.filter("rank is not null").select("row"), "row", "left_semi").select("doc.*")


def resample_digest(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_features, weight, score, rank)."""
    return resample(docs.select("doc_id", "text"), target).drop("row")


@cache
def resample_sql(buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024") -> str:
    """The same for single words: crc32 byte by byte for each distinct word."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    shift = "case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end"
    steps = "".join(f"select k, {shift} as x from (" for _ in range(8)) + "select k, k as x from range(256) t(k)" + ")" * 8
    return f"""with crc as (select list(cast(x as bigint) order by k) as c from ({steps})),
docs as (select row_number() over () as r, doc_id, {words} as w from documents),
corpus as (select word, count(*) as n from (select unnest(w) as word from docs) group by word),
target as (select word, count(*) as n from (select unnest({words}) as word from benchmark) group by word),
known as (select word from corpus union select word from target),
hashed as (select word, xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(1, 2 * octet_length(encode(word)), 2), lambda i: cast('0x' || substr(hex(encode(word)), i, 2) as bigint))),
  lambda a, b: xor(a >> 8, c[(xor(a, b) & 255) + 1])), 4294967295) % {buckets} as bucket from known, crc),
s as (select bucket, sum(n) as n from corpus join hashed using (word) group by bucket),
t as (select bucket, sum(n) as n from target join hashed using (word) group by bucket),
gains as (select bucket, cast(floor(1000 * ln(cast((coalesce(t.n, 0) + 1) * (coalesce((select sum(n) from s), 0) + {buckets}) as double)
  / cast((s.n + 1) * (coalesce((select sum(n) from t), 0) + {buckets}) as double))) as bigint) as gain from s left join t using (bucket)),
sums as (select r, cast(sum(gain) as bigint) as g from (select r, unnest(w) as word from docs) join hashed using (word) join gains using (bucket) group by r),
weights as (select r, doc_id, len(w) as n, case when len(w) = 0 then 0 else (g - ((g % len(w)) + len(w)) % len(w)) // len(w) end as weight from docs left join sums using (r)),
scores as (select r, doc_id, n, weight, weight + cast(floor(-1000 * ln(-ln((cast('0x' || sha256('{seed}:' || coalesce(cast(doc_id as varchar), ''))[1:8] as bigint) + 0.5) / 4294967296))) as bigint) as score from weights),
ranks as (select r, row_number() over (order by score desc, doc_id nulls last, r) as rank from scores where n >= {least_words})
select doc_id, cast(n as bigint) as n_features, cast(weight as bigint) as weight, cast(score as bigint) as score,
  case when rank <= (select count(*) from ranks) * {percent} // 100 then rank end as rank from scores left join ranks using (r)"""
