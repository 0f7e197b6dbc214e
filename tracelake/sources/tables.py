"""Scans of system-activity CSVs, system specifications, archives and trace tables."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import BinaryIO

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import CID
from tracelake.sources.text import found_once

#: Columns by kind, behind hostname, interval and timestamp; inner names replace the signs.
SAR = {
    "cpu": ("CPU", "%user", "%system", "%iowait", "%idle"),
    "io": ("tps", "rkB/s", "wkB/s", "await", "%util", "avgrq-sz", "avgqu-sz"),
    "disk": ("DEV", "tps", "rkB/s", "wkB/s", "avgrq-sz", "avgqu-sz", "await", "%util"),
    "network": ("IFACE", "%ifutil", "rxkB/s", "txkB/s"),
    "memory": ("kbmemfree", "kbmemused", "%memused", "%commit"),
    "paging": ("pgpgin/s", "pgpgout/s", "majflt/s", "pswpin/s", "pswpout/s"),
    "load": ("runq-sz", "plist-sz", "ldavg-1", "ldavg-5", "ldavg-15"),
    "cswch": ("cswch/s", "nvcswch/s"),
}
TEXT = {"CPU", "DEV", "IFACE", "hostname", "timestamp"}


def inner_name(column: str) -> str:
    return column.replace("%", "pct_").replace("/", "_").replace("-", "_").lower()


def sar_rows(lines: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """A series from lines (collection_id, ord, value) of ;-separated text whose header is the first line with a # (without one,
    the first line).  Lines before it and further header lines, which a restart leaves, are dropped.

    columns: those wanted, by their names in the file, wherever a collection's header has them; a column that a header lacks is 0.
    Without columns: hostname, interval, timestamp and a map of all fields."""
    marked = F.col("value").startswith("#")
    head = lines.groupBy(CID).agg(F.coalesce(F.min_by("value", F.when(marked, F.col("ord"))), F.min_by("value", "ord")).alias("head"), F.coalesce(F.min(F.when(marked, F.col("ord"))), F.min("ord")).alias("at"))
    names = F.transform(F.split(F.regexp_replace("head", r"^#\s*", ""), ";"), lambda x: F.trim(x))
    d = lines.join(head.select(CID, names.alias("names"), "at"), CID).filter((F.col("ord") > F.col("at")) & ~marked & (F.trim("value") != ""))
    fields = F.split("value", ";")
    d = d.filter(F.size(fields) == F.size("names")).select(CID, "ord", F.map_from_arrays("names", fields).alias("m"))
    base = [F.col("m")["hostname"].alias("hostname"), F.col("m")["interval"].try_cast("int").alias("interval"), F.col("m")["timestamp"].alias("timestamp")]
    if not columns:
        return d.select(CID, *base, "m")

    def typed(c: str) -> Column:
        v = F.try_element_at("m", F.lit(c))
        return (v if c in TEXT else F.coalesce(v.try_cast("double"), F.when(F.array_contains(F.map_keys("m"), c), F.lit(None).cast("double")).otherwise(0.0))).alias(inner_name(c))

    return d.select(CID, *base, *[typed(c) for c in columns])


def sar(lines: DataFrame, kind: str) -> DataFrame:
    """A series of one kind; CPU -1 is 'all'."""
    d = sar_rows(lines, SAR[kind])
    return d.withColumn("cpu", F.when(F.col("cpu") == "-1", "all").otherwise(F.col("cpu"))) if kind == "cpu" else d


#: The parts of a system specification that the operators read.
SPEC = (
    "cpu_info map<string,string>, numa_info struct<numa_topology:map<string,string>>, "
    "disk_info struct<block_devices:array<struct<name:string,rotational:string,size_bytes:bigint,fs_usage:struct<percent:double,mount:string>,"
    "partitions:array<struct<name:string,size_bytes:bigint,fs_usage:struct<percent:double,mount:string>>>>>>"
)


def as_json(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(collection_id, text) of YAML to (collection_id, js)."""
    import yaml

    for f in frames:
        yield pd.DataFrame({CID: f[CID], "js": [json.dumps(yaml.safe_load(t) or {}, default=str) for t in f["text"]]})


def system_specs(files: DataFrame) -> DataFrame:
    """Nested records from (collection_id, file, text): a collection's static_info.yaml, else its spec_info.yaml."""
    rank = F.when(F.col("file") == "static_info.yaml", 0).when(F.col("file") == "spec_info.yaml", 1)
    best = files.filter(rank.isNotNull()).groupBy(CID).agg(F.min_by("text", rank).alias("text"))
    return best.mapInPandas(as_json, f"{CID} string, js string").select(CID, F.from_json("js", SPEC).alias("s")).select(CID, "s.*")


def topology(specs: DataFrame) -> DataFrame:
    return specs.select(CID, F.explode("numa_info.numa_topology").alias("node", "cpus"))


def devices(specs: DataFrame) -> DataFrame:
    """Block devices in the shape that the disk operators take."""
    d = specs.select(CID, F.explode("disk_info.block_devices").alias("d"))
    parts = F.coalesce(F.transform("d.partitions", lambda p: F.struct(p["name"].alias("name"), p["size_bytes"].alias("size_bytes"), p["fs_usage"]["percent"].alias("fs_percent"), p["fs_usage"]["mount"].alias("mount"))), F.array().cast("array<struct<name:string,size_bytes:bigint,fs_percent:double,mount:string>>"))
    return d.select(CID, "d.name", "d.rotational", "d.size_bytes", F.col("d.fs_usage.percent").alias("fs_percent"), F.col("d.fs_usage.mount").alias("mount"), parts.alias("partitions"))


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """(collection_id, file, size, text) of the members of tar archives; see `unpacked`."""
    return unpacked(spark.read.format("binaryFile").load(path))


def data_folder(name: str, names: Iterable[str]) -> str:
    """The folder of an archive that counts: the only one, else the first whose name begins with attach_session."""
    tops = sorted({n.removeprefix("./").split("/")[0] for n in names if "/" in n.removeprefix("./")})
    own = tops if len(tops) == 1 else [t for t in tops if t.startswith("attach_session")]
    if not own:
        raise ValueError(f"{name} has no data folder")
    return own[0]


def opened(path: str) -> BinaryIO:
    """A file in any store that Arrow's file systems reach, as a handle."""
    fs, at = FileSystem.from_uri(path)
    return fs.open_input_stream(at)


def members(name: str, handle: Callable[[], BinaryIO]) -> Iterator[tuple[str, int, BinaryIO]]:
    """(file, size, handle) of the members of the data folder, in the archive's order.  The archive is streamed twice, for the names and
    for the members, and never held."""
    with handle() as f, tarfile.open(fileobj=f, mode="r|*") as tar:
        own = data_folder(name, (m.name for m in tar if m.isfile()))
    with handle() as f, tarfile.open(fileobj=f, mode="r|*") as tar:
        for m in tar:
            top, _, rest = m.name.removeprefix("./").partition("/")
            if m.isfile() and top == own and rest:
                yield rest, m.size, tar.extractfile(m)


def line_chunks(cid: str, name: str, handle: Callable[[], BinaryIO], rows: int = 4096, size: int = 1 << 22) -> Iterator[pd.DataFrame]:
    """The lines of an archive's members in pieces of so many rows, or of about so many bytes."""
    out: list[tuple[str, str, int, str]] = []
    held = 0
    for file, _, member in members(name, handle):
        for i, line in enumerate(member):
            out.append((cid, file, i, line.rstrip(b"\n").removesuffix(b"\r").decode("utf-8", "replace")))
            held += len(line)
            if len(out) >= rows or held >= size:
                yield pd.DataFrame(out, columns=LINE_COLUMNS)
                out, held = [], 0
    yield pd.DataFrame(out, columns=LINE_COLUMNS)


LINE_COLUMNS = [CID, "file", "ord", "value"]


def named(path: str) -> str:
    """The collection of an archive: its name up to the first dot."""
    return path.rsplit("/", 1)[-1].split(".")[0]


def archive_lines(spark: SparkSession, path: str, handle: Callable[[str], BinaryIO] = opened) -> DataFrame:
    """(collection_id, file, ord, value): the lines of all members of tar archives, plain or compressed, for the parsers of text.

    Spark lists the archives, without their content; each is streamed by a task from a file handle, so that neither an archive nor
    a member is ever whole in memory.  handle: opens a path where Arrow's file systems don't know the store."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p in f["path"]:
                yield from line_chunks(named(p), p, lambda p=p: handle(p))

    listed = spark.read.format("binaryFile").load(path).select("path")
    return listed.repartition(F.col("path")).mapInPandas(run, f"{CID} string, file string, ord bigint, value string")


def unpacked_lines(archives: DataFrame) -> DataFrame:
    """The same from (path, content), for archives that stand in a table."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, content in zip(f["path"], f["content"], strict=True):
                yield from line_chunks(named(p), p, lambda content=content: io.BytesIO(content))

    return archives.select("path", "content").mapInPandas(run, f"{CID} string, file string, ord bigint, value string")


def unpacked(archives: DataFrame) -> DataFrame:
    """(collection_id, file, size, text) from (path, content), one task for each archive: the members of the data folder, whole, for
    small files such as specifications (`archive_lines` is for the others)."""

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f["path"], f["content"], strict=True):
                for file, size, member in members(name, lambda content=content: io.BytesIO(content)):
                    yield pd.DataFrame({CID: [named(name)], "file": [file], "size": [size], "text": [member.read().decode("utf-8", "replace")]})

    return archives.select("path", "content").mapInPandas(unpack, f"{CID} string, file string, size bigint, text string")


def member_lines(members: DataFrame, file: str) -> DataFrame:
    """A member's lines as (collection_id, ord, value), for the parsers of text."""
    d = members.filter(F.col("file") == file)
    return d.select(CID, F.posexplode(F.split("text", r"\r?\n")).alias("ord", "value"))


#: Columns of the trace tables, all bigint but for those named here.
TRACE_TYPES = {"name": "string", "root_dir": "string", "comm": "string", "short_name": "string", "long_name": "string", "build_id": "string", "exec_flag": "boolean", "in_tx": "boolean", "pid": "int", "tid": "int", "binding": "int", "cpu": "int", "branch_type": "int", "flags": "int"}
SAMPLE_HEAD = "id evsel_id machine_id thread_id comm_id dso_id symbol_id sym_offset ip time cpu to_dso_id to_symbol_id to_sym_offset to_ip"
SAMPLE_TAIL = "branch_type in_tx call_path_id insn_count cyc_count flags"
TRACE = {
    "selected_events": "id name", "machines": "id pid root_dir", "threads": "id machine_id process_id pid tid", "comms": "id comm c_thread_id c_time exec_flag",
    "comm_threads": "id comm_id thread_id", "dsos": "id machine_id short_name long_name build_id", "symbols": "id dso_id sym_start sym_end binding name",
    "branch_types": "id name", "samples": f"{SAMPLE_HEAD} period weight transaction_ data_src {SAMPLE_TAIL}", "call_paths": "id parent_id symbol_id ip",
    "calls": "id thread_id comm_id call_path_id call_time return_time branch_count call_id return_id parent_call_path_id flags parent_id insn_count cyc_count",
    "ptwrite": "id payload exact_ip", "cbr": "id cbr mhz percent", "mwait": "id hints extensions", "pwre": "id cstate subcstate hw", "exstop": "id exact_ip",
    "pwrx": "id deepest_cstate last_cstate wake_reason",
    "context_switches": "id machine_id time cpu thread_out_id comm_out_id thread_in_id comm_in_id flags",
}


def trace_schema(table: str) -> str:
    return ", ".join(f"{c} {TRACE_TYPES.get(c, 'bigint')}" for c in TRACE[table].split())


def typed(fields: Sequence[tuple[str, Column]]) -> list[Column]:
    return [x.try_cast(TRACE_TYPES.get(c, "bigint")).alias(c) for c, x in fields]


def sample_rows(lines: DataFrame) -> DataFrame:
    """The trace's samples from lines (value) of comma-separated fields, whatever their number: 21 fields are the branch form, which
    has no period, weight, transaction_ and data_src (NULL here); others are filled up with 0 to the 25 of the whole form, or cut to
    them.  Empty fields are NULL, and so are fields that are no numbers; lines without text are left out."""
    names, head = TRACE["samples"].split(), len(SAMPLE_HEAD.split())
    gap = len(names) - head - len(SAMPLE_TAIL.split())
    d = lines.filter(F.trim("value") != "").select(found_once(F.split("value", ",", -1)))
    none, zeros = F.array(*[F.lit(None).cast("string")] * gap), F.array(*[F.lit("0")] * len(names))
    branch = F.concat(F.slice("f", 1, head), none, F.slice("f", head + 1, len(names) - head - gap))
    whole = F.slice(F.concat("f", zeros), 1, len(names))
    d = d.select(found_once(F.when(F.size("f") == len(names) - gap, branch).otherwise(whole)))
    return d.select(*typed([(c, F.trim(F.get("f", F.lit(i)))) for i, c in enumerate(names)]))


def trace_rows(lines: DataFrame, table: str) -> DataFrame:
    """A trace table from lines (value) of CSV without a header; rows may be short (NULL) or long (cut)."""
    if table == "samples":
        return sample_rows(lines)
    names = TRACE[table].split()
    row = F.from_csv("value", F.lit(", ".join(f"{c} string" for c in names)), {"escape": '"', "mode": "PERMISSIVE"})
    d = lines.filter(F.trim("value") != "").select(row.alias("r"))
    return d.select(*typed([(c, F.trim(F.col(f"r.{c}")) if TRACE_TYPES.get(c) != "string" else F.col(f"r.{c}")) for c in names]))


def trace_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A trace table from headerless CSV files.  Records that hold line breaks in quotes need `spark.read.csv`; no trace table does."""
    return trace_rows(spark.read.text(path), table)


def fetch_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def run_query(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(sql)
