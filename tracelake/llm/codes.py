"""Product codes of vectors, trained in whole numbers.

Components become whole numbers, and vectors are cut into equal parts.  Rows are stored in blocks of bounded length, of which each
dimension has a dictionary of the distinct numbers it holds there, and a code into it for each row.  In each round a dimension's
squared differences between its dictionary and all codebook entries are tabulated once for a block; a part's distances to all
entries are then the sums of the table rows that its dimensions' codes name.  So what is computed grows with the distinct numbers,
and a row costs but gathers and adds.  Rounds read the blocks; a task gives one row for each entry's component and count, and the
driver holds the codebooks, whose size is fixed by parameters.

All arithmetic is exact: tables have 32 bits where a block's numbers allow it, else 64, else any number of digits, and sums travel in
limbs of 31 bits.

Rows: those whose vector is null or holds null or non-finite components are dropped, and so are those of another length than most
(ties: the longest) or of a length that the parts don't divide; zero vectors stay.  A null vec_id stays and counts as the largest;
repeated rows are coded each; an error beyond 64 bits is null; an empty table gives no rows; further columns are ignored."""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import map_slices, slices, stored

LIMB = 31


def whole(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * v), as 64-bit numbers where a block's sums of them fit, too, else as Python's."""
    if (np.abs(v) < 2.0**45 / scale).all():
        return np.floor(v * scale).astype(np.int64)

    def exact(x: float) -> int:
        a, b = x.as_integer_ratio()
        return a * scale // b

    return np.array([[exact(x) for x in row] for row in v.tolist()], object)


def block_of(numbers: np.ndarray) -> dict:
    """A block's dictionaries and codes, dimension by dimension."""
    values, codes = zip(*(np.unique(column, return_inverse=True) for column in numbers.T), strict=True)
    wide = numbers.dtype == object
    flat = np.concatenate(values)
    text = ",".join(map(str, flat.tolist())).encode() if wide else flat.tobytes()
    return {"wide": wide, "sizes": [len(x) for x in values], "values": text, "codes": np.stack(codes).astype(np.uint16).tobytes()}


class Block:
    def __init__(self, row: dict):
        flat = np.array([int(x) for x in row["values"].split(b",")], object) if row["wide"] else np.frombuffer(row["values"], np.int64)
        self.values = np.split(flat, np.cumsum(row["sizes"])[:-1])
        self.codes = np.frombuffer(row["codes"], np.uint16).reshape(len(row["sizes"]), -1)
        self.most = max(abs(int(flat.max())), abs(int(flat.min())))

    def assigned(self, books: list[np.ndarray], rows: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of every part of every row: parts x rows."""
        best, least = [], []
        at = 0
        for book in books:
            size = book.shape[1]
            bound = size * (self.most + max(abs(int(book.max())), abs(int(book.min())))) ** 2
            kind = np.int32 if bound < 2**31 else np.int64 if bound < 2**63 else object
            tables = [(self.values[at + j].astype(kind)[:, None] - book[:, j].astype(kind)[None]) ** 2 for j in range(size)]
            entry, apart = [], []
            for i in range(0, self.codes.shape[1], rows):
                total = tables[0][self.codes[at, i : i + rows]]
                for j in range(1, size):
                    total = total + tables[j][self.codes[at + j, i : i + rows]]
                e = total.argmin(1)  # the first of equal ones
                entry.append(e)
                apart.append(total[np.arange(len(e)), e])
            best.append(np.concatenate(entry))
            least.append(np.concatenate(apart).astype(np.int64 if kind != object else object))
            at += size
        return np.stack(best), np.stack(least)

    def totals(self, best: np.ndarray, entries: int, size: int) -> dict[int, int]:
        """Slot -> sum, of every component of an entry, and of the parts that are nearest to it."""
        out: dict[int, int] = {}
        for p, e in enumerate(best):
            for k, n in enumerate(np.bincount(e, minlength=entries).tolist()):
                if n:
                    out[(p * entries + k) * (size + 1) + size] = n
            for j in range(size):
                x = self.values[p * size + j][self.codes[p * size + j]]
                sums = np.zeros(entries, x.dtype)
                np.add.at(sums, e, x)
                for k in np.flatnonzero(sums != 0).tolist():
                    out[(p * entries + k) * (size + 1) + j] = int(sums[k])
        return out


def limbs(x: int) -> list[int]:
    """x in 31-bit digits, the last one signed."""
    out = []
    while not -(1 << LIMB) <= x < 1 << LIMB:
        out.append(x & (1 << LIMB) - 1)
        x >>= LIMB
    return [*out, x]


def blocks_of(good: DataFrame, scale: int, rows: int) -> DataFrame:
    kind = good.schema["label"].dataType.simpleString()

    def run(b):
        v = b.column("v")
        x = v.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
        return {c: [y] for c, y in ({"ids": b.column("vec_id").to_pylist(), "labels": b.column("label").to_pylist()} | block_of(whole(x, scale))).items()}

    return map_slices(good, run, f"ids array<long>, labels array<{kind}>, wide boolean, sizes array<int>, `values` binary, codes binary", rows)


def vector_codes(embeddings: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, rows: int = 4096, vector: str = "embedding") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector kept: the entry of each part in two hex digits, its
    squared distance to them, the sum of those of its label, and a digest of the codebooks."""
    if not 0 < entries <= 256 or rows > 1 << 16:
        raise ValueError("at most 256 entries, and blocks of at most 65,536 rows")
    spark = embeddings.sparkSession
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = embeddings.filter(F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long"), "label", v.alias("v"))
    kind = good.schema["label"].dataType.simpleString()
    lengths = good.filter((F.size("v") > 0) & (F.size("v") % parts == 0)).groupBy(F.size("v").alias("d")).count()
    first = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    if first is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    good = good.filter(F.size("v") == first["d"])
    size = first["d"] // parts
    begin = good.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").toArrow().column("v")
    numbers = whole(np.array(begin.to_pylist(), float), scale)
    books = [numbers[:, p * size : (p + 1) * size] for p in range(parts)]
    k = len(numbers)
    blocks = stored(blocks_of(good, scale, rows))
    for _ in range(rounds):
        books = next_books(blocks, books, k, size)

    def coded(b):
        out = {"vec_id": [], "label": [], "code": [], "error": []}
        for row in b.to_pylist():
            best, least = Block(row).assigned(books)
            out["vec_id"] += row["ids"]
            out["label"] += row["labels"]
            text = best.T.astype(np.uint8).tobytes().hex()
            out["code"] += [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
            out["error"] += [x if x < 1 << 63 else None for x in least.astype(object).sum(0).tolist()]
        return out

    done = stored(map_slices(blocks, coded, f"vec_id long, label {kind}, code string, error long", 1))
    text = ",".join(str(x) for b in books for row in b.tolist() for x in row)
    # Sums by label, brought back to the rows; Spark broadcasts them where they are few.
    by_label = done.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"), F.max(F.col("error").isNull()).alias("wide"))
    by_label = by_label.select(F.col("label").alias("of"), F.when(~F.col("wide"), F.col("label_error")).alias("label_error"))
    out = done.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))


def next_books(blocks: DataFrame, books: list[np.ndarray], entries: int, size: int) -> list[np.ndarray]:
    """The codebooks after a round: each entry that parts are nearest to becomes their floored mean."""

    def run(batches):
        total: dict[int, int] = {}
        for b in slices(batches, 1):
            block = Block(b.to_pylist()[0])
            for slot, x in block.totals(block.assigned(books)[0], entries, size).items():
                total[slot] = total.get(slot, 0) + x
        rows = [(slot, i, x) for slot, t in total.items() for i, x in enumerate(limbs(t))]
        cols = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64())], ["slot", "limb", "x"])

    sums = blocks.mapInArrow(run, "slot int, limb int, x long").groupBy("slot", "limb").agg(F.sum("x").alias("x"))
    total: dict[int, int] = {}
    for slot, limb, x in zip(*(c.to_pylist() for c in sums.toArrow().columns), strict=True):  # as many as the codebooks have numbers
        total[slot] = total.get(slot, 0) + (x << LIMB * limb)
    out = []
    for p, book in enumerate(books):
        new = book.astype(object)
        for k in range(entries):
            at = (p * entries + k) * (size + 1)
            if n := total.get(at + size):
                new[k] = [total.get(at + j, 0) // n for j in range(size)]
        far = max(abs(int(new.max())), abs(int(new.min()))) >= 2**52
        out.append(new if far else new.astype(np.int64))
    return out


@cache
def codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The same in SQL: each round is a step of its own."""
    down = "(({s} - (({s} % {n}) + {n}) % {n}) // {n})"
    steps = [
        f"""good as (select row_number() over (order by vec_id nulls last, embedding) as r, vec_id, label, embedding as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(embedding) > 0 and len(embedding) % {parts} = 0),
size as (select len(v) as d from good group by 1 order by count(*) desc, 1 desc limit 1),
kept as (select row_number() over (order by r) as r, vec_id, label, v from good, size where len(v) = d),
cells as (select r, (i - 1) // (d // {parts}) as p, (i - 1) % (d // {parts}) as j, cast(floor(cast(v[i] as double) * {scale}) as bigint) as x
  from (select r, v, d, unnest(range(1, d + 1)) as i from kept, size)),
book0 as (select p, r - 1 as k, j, x from cells where r <= {entries})"""
    ]
    for n in range(rounds + 1):
        steps.append(f"""apart{n} as (select r, p, k, sum((c.x - b.x) * (c.x - b.x)) as s from cells c join book{n} b using (p, j) group by r, p, k),
near{n} as (select r, p, min(s) as s, arg_min(k, s * {entries} + k) as k from apart{n} group by r, p)""")
        if n < rounds:
            steps.append(f"""mean{n} as (select p, k, j, sum(x) as s, count(*) as n from cells join near{n} using (r, p) group by p, k, j),
book{n + 1} as (select p, k, j, cast(coalesce({down.format(s="m.s", n="m.n")}, b.x) as bigint) as x from book{n} b left join mean{n} m using (p, k, j))""")
    steps.append(f"""coded as (select r, string_agg(lpad(lower(to_hex(k)), 2, '0'), '' order by p) as code, sum(s) as error from near{rounds} group by r),
rows as (select vec_id, label, code, cast(error as bigint) as error from kept join coded using (r)),
labels as (select label, cast(sum(error) as bigint) as label_error from rows group by label),
digest as (select sha256(string_agg(cast(x as varchar), ',' order by p, k, j)) as codebooks_sha256 from book{rounds})""")
    return "with " + ",\n".join(steps) + "\nselect vec_id, code, error, label_error, codebooks_sha256 from rows join labels on rows.label is not distinct from labels.label, digest"
