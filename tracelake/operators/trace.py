"""Views over exported trace tables, as joins with their dimension tables; Spark broadcasts those that are small by its own check.

Ids of a dimension are unique in a collection; an absent id gives NULL (left joins) or no row where the view is one of matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.text import hex_text

#: Texts of flags.
CALL_FLAGS = {0: "", 1: "no call", 2: "no return", 3: "no call/return", 6: "jump"}
SWITCH_FLAGS = {0: "in", 1: "out", 3: "out preempt"}
WAKE_REASONS = {1: "Interrupt", 2: "Timer Deadline", 4: "Monitored Address", 8: "HW"}


def flag_text(c: Column, texts: dict[int, str]) -> Column:
    """The text of a flag; other values as they are."""
    out = c.cast("string")
    for k, v in texts.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def truth(c: Column) -> Column:
    return F.when(c == 0, "False").otherwise("True")


def look_up(df: DataFrame, dimension: DataFrame, key: str, **names: str) -> DataFrame:
    """df with columns of the dimension row whose id is df's key: new name = its column."""
    d = dimension.select(F.col("id").alias("__id"), *[F.col(c).alias(n) for n, c in names.items()])
    return df.join(d, F.col(key) == F.col("__id"), "left").drop("__id")


def machines_view(machines: DataFrame) -> DataFrame:
    kind = F.when(F.col("id") == 0, "unknown").when(F.col("pid") == -1, "host").otherwise("guest")
    return machines.select("id", "pid", "root_dir", kind.alias("host_or_guest"))


def dsos_view(dsos: DataFrame, machines: DataFrame) -> DataFrame:
    d = look_up(dsos, machines_view(machines), "machine_id", host_or_guest="host_or_guest")
    return d.select("id", "machine_id", "host_or_guest", "short_name", "long_name", "build_id")


def symbols_view(symbols: DataFrame, dsos: DataFrame) -> DataFrame:
    kind = F.when(F.col("binding") == 0, "local").when(F.col("binding") == 1, "global").otherwise("weak")
    return look_up(symbols, dsos, "dso_id", dso="short_name").select("id", "name", "dso", "dso_id", "sym_start", "sym_end", kind.alias("binding"))


def threads_view(threads: DataFrame, machines: DataFrame) -> DataFrame:
    return look_up(threads, machines_view(machines), "machine_id", host_or_guest="host_or_guest").select("id", "machine_id", "host_or_guest", "process_id", "pid", "tid")


def comm_threads_view(comm_threads: DataFrame, comms: DataFrame, threads: DataFrame) -> DataFrame:
    d = look_up(look_up(comm_threads, comms, "comm_id", command="comm"), threads, "thread_id", pid="pid", tid="tid")
    return d.select("comm_id", "command", "thread_id", "pid", "tid")


def call_paths_view(call_paths: DataFrame, symbols: DataFrame, dsos: DataFrame) -> DataFrame:
    """Call paths that have a parent, with both sides' symbols and modules."""
    s = symbols_view(symbols, dsos)
    p = call_paths.select(F.col("id").alias("parent_id"), F.col("symbol_id").alias("parent_symbol_id"), hex_text(F.col("ip")).alias("parent_ip"))
    d = call_paths.join(p, "parent_id")
    d = look_up(d, s, "symbol_id", symbol="name", dso_id="dso_id", dso_short_name="dso")
    d = look_up(d, s, "parent_symbol_id", parent_symbol="name", parent_dso_id="dso_id", parent_dso_short_name="dso")
    return d.select(
        "id", hex_text(F.col("ip")).alias("ip"), "symbol_id", "symbol", "dso_id", "dso_short_name", "parent_id", "parent_ip", "parent_symbol_id", "parent_symbol", "parent_dso_id", "parent_dso_short_name"
    )


def ipc() -> Column:
    """Instructions a cycle, rounded half up to two digits; 0 without cycles."""
    return F.when(F.col("cyc_count") == 0, F.lit(0.0)).otherwise(F.round(F.try_divide(F.col("insn_count").cast("double"), F.col("cyc_count").cast("double")), 2))


def calls_view(calls: DataFrame, call_paths: DataFrame, threads: DataFrame, comms: DataFrame, symbols: DataFrame) -> DataFrame:
    p = call_paths.select(F.col("id").alias("call_path_id"), "symbol_id", hex_text(F.col("ip")).alias("ip"))
    d = look_up(calls.join(p, "call_path_id"), threads, "thread_id", pid="pid", tid="tid")
    d = look_up(look_up(d, comms, "comm_id", command="comm"), symbols, "symbol_id", symbol="name")
    return d.select(
        "id", "thread_id", "pid", "tid", "command", "call_path_id", "ip", "symbol_id", "symbol", "call_time", "return_time", (F.col("return_time") - F.col("call_time")).alias("elapsed_time"),
        "branch_count", "insn_count", "cyc_count", ipc().alias("IPC"), "call_id", "return_id", flag_text(F.col("flags"), CALL_FLAGS).alias("flags"), "parent_call_path_id", "parent_id",
    )


def samples_view(samples: DataFrame, threads: DataFrame, comms: DataFrame, events: DataFrame, symbols: DataFrame, dsos: DataFrame, branch_types: DataFrame) -> DataFrame:
    d = look_up(samples, threads, "thread_id", pid="pid", tid="tid")
    for dim, key, names in (
        (comms, "comm_id", {"command": "comm"}), (events, "evsel_id", {"event": "name"}), (symbols, "symbol_id", {"symbol": "name"}), (dsos, "dso_id", {"dso_short_name": "short_name"}),
        (symbols, "to_symbol_id", {"to_symbol": "name"}), (dsos, "to_dso_id", {"to_dso_short_name": "short_name"}), (branch_types, "branch_type", {"branch_type_name": "name"}),
    ):
        d = look_up(d, dim, key, **names)
    return d.select(
        "id", "time", "cpu", "pid", "tid", "command", "event", hex_text(F.col("ip")).alias("ip_hex"), "symbol", "sym_offset", "dso_short_name", hex_text(F.col("to_ip")).alias("to_ip_hex"),
        "to_symbol", "to_sym_offset", "to_dso_short_name", "branch_type_name", "in_tx", "insn_count", "cyc_count", ipc().alias("IPC"), "flags",
    )


def at_sample(events: DataFrame, samples: DataFrame, *columns: str | Column) -> DataFrame:
    """Power events with the time and CPU of their sample."""
    return events.join(samples.select("id", "time", "cpu"), "id").select("id", "time", "cpu", *columns)


def ptwrite_view(ptwrite: DataFrame, samples: DataFrame) -> DataFrame:
    return at_sample(ptwrite, samples, hex_text(F.col("payload")).alias("payload_hex"), truth(F.col("exact_ip")).alias("exact_ip"))


def cbr_view(cbr: DataFrame, samples: DataFrame) -> DataFrame:
    return at_sample(cbr, samples, "cbr", "mhz", "percent")


def mwait_view(mwait: DataFrame, samples: DataFrame) -> DataFrame:
    return at_sample(mwait, samples, hex_text(F.col("hints")).alias("hints_hex"), hex_text(F.col("extensions")).alias("extensions_hex"))


def pwre_view(pwre: DataFrame, samples: DataFrame) -> DataFrame:
    return at_sample(pwre, samples, "cstate", "subcstate", truth(F.col("hw")).alias("hw"))


def exstop_view(exstop: DataFrame, samples: DataFrame) -> DataFrame:
    return at_sample(exstop, samples, truth(F.col("exact_ip")).alias("exact_ip"))


def pwrx_view(pwrx: DataFrame, samples: DataFrame) -> DataFrame:
    return at_sample(pwrx, samples, "deepest_cstate", "last_cstate", flag_text(F.col("wake_reason"), WAKE_REASONS).alias("wake_reason"))


def power_events_view(samples: DataFrame, events: DataFrame, cbr: DataFrame, mwait: DataFrame, pwre: DataFrame, exstop: DataFrame, pwrx: DataFrame) -> DataFrame:
    """Samples of the five power events with the fields of theirs; the other events' fields are ''."""
    e = events.filter(F.col("name").isin("cbr", "mwait", "pwre", "exstop", "pwrx")).select(F.col("id").alias("evsel_id"), F.col("name").alias("event"))
    d = samples.select("id", "time", "cpu", "evsel_id").join(e, "evsel_id")
    fields = {
        "cbr": (cbr, {"cbr": F.col("cbr"), "mhz": F.col("mhz"), "percent": F.col("percent")}),
        "mwait": (mwait, {"hints_hex": hex_text(F.col("hints")), "extensions_hex": hex_text(F.col("extensions"))}),
        "pwre": (pwre, {"cstate": F.col("cstate"), "subcstate": F.col("subcstate"), "hw": F.col("hw")}),
        "exstop": (exstop, {"exact_ip": F.col("exact_ip")}),
        "pwrx": (pwrx, {"deepest_cstate": F.col("deepest_cstate"), "last_cstate": F.col("last_cstate"), "wake_reason": flag_text(F.col("wake_reason"), WAKE_REASONS)}),
    }
    out = ["id", "time", "cpu", "event"]
    for name, (table, cols) in fields.items():
        d = d.join(table.select("id", *[c.cast("string").alias(f"__{n}") for n, c in cols.items()]), "id", "left")
        d = d.select("*", *[F.when(F.col("event") == name, F.col(f"__{n}")).otherwise("").alias(n) for n in cols]).drop(*[f"__{n}" for n in cols])
        out += list(cols)
    return d.select(*out)


def context_switches_view(switches: DataFrame, threads: DataFrame, comms: DataFrame) -> DataFrame:
    d = switches
    for side in ("out", "in"):
        t = threads.select(F.col("id").alias(f"thread_{side}_id"), F.col("pid").alias(f"pid_{side}"), F.col("tid").alias(f"tid_{side}"))
        c = comms.select(F.col("id").alias(f"comm_{side}_id"), F.col("comm").alias(f"comm_{side}"))
        d = d.join(t, f"thread_{side}_id").join(c, f"comm_{side}_id")
    return d.select("id", "machine_id", "time", "cpu", "pid_out", "tid_out", "comm_out", "pid_in", "tid_in", "comm_in", flag_text(F.col("flags"), SWITCH_FLAGS).alias("flags"))


def little_endian(raw: Column, at: int, size: int) -> Column:
    """The unsigned number in raw's bytes at..at+size, as bigint bits."""
    hexed = F.hex(F.substring(raw, at + 1, size))
    turned = F.concat(*[F.substring(hexed, 2 * i + 1, 2) for i in range(size - 1, -1, -1)])
    return F.conv(turned, 16, -10).cast("bigint")


def power_fields(payload: Column) -> dict[str, dict[str, Column]]:
    """Bit fields of a 64-bit payload by kind of event."""

    def bits(shift: int, mask: int) -> Column:
        return (F.shiftrightunsigned(payload, shift) if shift else payload).bitwiseAND(F.lit(mask)).cast("int")

    return {
        "mwait": {"hints": bits(0, 0xFF), "extensions": bits(32, 3)},
        "pwre": {"cstate": bits(12, 0xF), "subcstate": bits(8, 0xF), "hw": bits(7, 1)},
        "pwrx": {"deepest_cstate": bits(0, 0xF), "last_cstate": bits(4, 0xF), "wake_reason": bits(8, 0xF)},
    }


def decode_power(raw: DataFrame) -> dict[str, DataFrame]:
    """Tables of the six kinds from raw events (id, config, raw): config 0 ptwrite, 1 mwait, 2 pwre, 3 exstop, 4 pwrx, 5 cbr."""
    flags, payload = little_endian(F.col("raw"), 0, 4), little_endian(F.col("raw"), 4, 8)
    of = {k: raw.filter(F.col("config") == i) for i, k in enumerate(("ptwrite", "mwait", "pwre", "exstop", "pwrx", "cbr"))}
    exact = flags.bitwiseAND(F.lit(1)).cast("int").alias("exact_ip")
    out = {"ptwrite": of["ptwrite"].select("id", payload.alias("payload"), exact), "exstop": of["exstop"].select("id", exact)}
    for kind, cols in power_fields(payload).items():
        out[kind] = of[kind].select("id", *[c.alias(n) for n, c in cols.items()])
    cbr, top, khz = (little_endian(F.col("raw"), at, n) for at, n in ((0, 1), (2, 1), (4, 4)))
    mhz, ratio = F.floor((khz + 500) / 1000), F.floor(F.try_divide(cbr * 1000, top))
    out["cbr"] = of["cbr"].select("id", cbr.cast("int").alias("cbr"), mhz.cast("int").alias("mhz"), F.floor((ratio + 5) / 10).cast("int").alias("percent"))
    return out


def with_calls_flag(comms: DataFrame, calls: DataFrame) -> DataFrame:
    """comms with has_calls: true where a call has it, else NULL."""
    has = calls.select(F.col("comm_id").alias("id")).distinct().withColumn("has_calls", F.lit(True))
    return comms.join(has, "id", "left")


def with_unknown(dimension: DataFrame, **values) -> DataFrame:
    """A dimension with a row of id 0 for what is unknown, so that joins find one; columns not named are NULL."""
    row = dimension.sparkSession.range(1).select(*[F.lit(0 if c == "id" else values.get(c)).cast(t).alias(c) for c, t in dimension.dtypes])
    return dimension.filter(F.col("id") != 0).unionByName(row)
