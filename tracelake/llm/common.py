"""Helpers that the training-data operators share: word splitting, Arrow mapping, stored intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes A-Z to a-z, and every ASCII byte that is no letter or digit to a blank; bytes from 0x80 on stay.
_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def blank_words(text: str | None) -> list[bytes]:
    """Words between ASCII blanks, A-Z lower-cased; no text has no words."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased; no text has no words."""
    return text.encode("utf-8", "surrogatepass").translate(_ALNUM).split() if text else []


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash, kept for the next lookups; emptied when it holds too many words."""

    most = 200_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: One cache per Python worker process; emptied with the others at the end of a task, as workers serve later stages too.
word_hashes = WordHashes()
caches: list[dict] = [word_hashes]


def forget() -> None:
    for c in caches:
        c.clear()


def gram_hashes(h: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of every n consecutive word hashes, or of those that begin at the places given: a sum of products with odd multipliers,
    then mixed."""
    size = len(h) - n + 1 if at is None else len(at)
    if size <= 0:
        return np.empty(0, np.uint64)
    out, k = np.zeros(size, np.uint64), 1
    for i in range(n):
        k = k * 0x9E3779B97F4A7C15 + 2 * i + 1 | 1
        k &= (1 << 64) - 1
        out += (h[i : i + size] if at is None else h[at + i]) * np.uint64(k)
    return mixed(out)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, without repeats."""
    s = np.sort(x)
    return s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit of the input reaches every bit of the output."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, so that long texts are not all decoded at once."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def map_slices(
    df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str, rows: int = 256, setup: Callable | None = None
) -> DataFrame:
    """df through fn, which gets few rows at a time and returns a column -> values mapping (or None for no rows)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = fn if setup is None else fn(setup())
        for b in slices(batches, rows):
            out = f(b)
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[x.name], x.type) for x in arrow], schema=arrow)
        forget()

    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Where none is set, only a session on one machine gets a temporary one."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="tracelake-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


#: With it the shuffle files of a write go from the executors' disks when it is done.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and a lost executor costs no rework.  Tables stay
    until discard() or the end of the folder, as what an operator returns may still read them."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tracelake-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, was)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "stored_at", None):
            at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def task_number() -> int:
    ctx = TaskContext.get()
    return ctx.partitionId() if ctx else 0


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
