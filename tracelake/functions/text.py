"""Column functions for CPU lists, byte sizes and hex text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cpu_set(text: Column) -> Column:
    """'0-2,5' -> ['0', '1', '2', '5'], distinct, in order of appearance; parts that are no number or range are skipped."""
    part = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x))

    def ids(p: Column) -> Column:
        low = F.regexp_extract(p, r"^\s*(\d+)", 1).try_cast("int")
        high = F.regexp_extract(p, r"-\s*(\d+)\s*$", 1).try_cast("int")
        numbers = F.when(p.rlike(r"^\d+$"), F.array(low)).when(
            p.rlike(r"^\d+\s*-\s*\d+$") & (low <= high), F.sequence(low, F.greatest(low, high))
        )
        return F.coalesce(numbers, F.array().cast("array<int>"))

    return F.array_distinct(F.transform(F.flatten(F.transform(part, ids)), lambda x: x.cast("string")))


def natural_sorted(names: Column) -> Column:
    """Names that are no number first, as text; then numbers by value."""
    keyed = F.transform(names, lambda x: F.struct(F.coalesce(x.try_cast("bigint"), F.lit(-1)).alias("n"), x.alias("name")))
    return F.transform(F.array_sort(keyed), lambda x: x["name"])


def cpu_ranges(names: Column) -> Column:
    """['0', '1', '2', '4', 'all'] -> 'all,0-2,4'; 'None' if there is none.  Runs of numbers are found from each number's distance
    to its place in the sorted list."""
    distinct = F.array_distinct(F.coalesce(names, F.array().cast("array<string>")))
    words = F.array_sort(F.filter(distinct, lambda x: x.try_cast("bigint").isNull()))
    numbers = F.array_sort(F.filter(F.transform(distinct, lambda x: x.try_cast("bigint")), lambda x: x.isNotNull()))
    keyed = F.transform(numbers, lambda x, i: F.struct((x - i).alias("run"), x.alias("x")))
    runs = F.array_sort(F.array_distinct(F.transform(keyed, lambda x: x["run"])))

    def text(run: Column) -> Column:
        own = F.transform(F.filter(keyed, lambda x: x["run"] == run), lambda x: x["x"])
        low, high = F.array_min(own).cast("string"), F.array_max(own).cast("string")
        return F.when(low == high, low).otherwise(F.concat_ws("-", low, high))

    out = F.concat(words, F.transform(runs, text))
    return F.when(F.size(out) > 0, F.array_join(out, ",")).otherwise("None")


def byte_text(size: Column) -> Column:
    """1536 MiB -> '1.50 GB'; below one MiB the plain number."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for unit, power in (("MB", 2), ("GB", 3), ("TB", 4)):
        out = F.when(size >= 1024**power, F.format_string(f"%.2f {unit}", size / float(1024**power))).otherwise(out)
    return out


def hex_text(x: Column) -> Column:
    return F.lower(F.hex(x))


def before_last_plus(symbol: Column) -> Column:
    """'f+0x10' -> 'f'; a symbol without a plus stays."""
    return F.when(F.instr(symbol, "+") > 0, F.regexp_extract(symbol, r"^(.*)\+[^+]*$", 1)).otherwise(symbol)


def after_last_plus(symbol: Column) -> Column:
    return F.when(F.instr(symbol, "+") > 0, F.regexp_extract(symbol, r"\+([^+]*)$", 1))


def hex_number(text: Column) -> Column:
    """'0x10' -> 16 as decimal(20,0): kernel addresses exceed a signed 64-bit number."""
    return F.conv(F.regexp_replace(text, "^0x", ""), 16, 10).try_cast("decimal(20,0)")
