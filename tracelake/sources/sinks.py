"""Writers: folded text, CSV of statistics, JSON records.  Each writes a folder of part files, ordered where readers expect order."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.operators import CID


def folded_lines(stacks: DataFrame) -> DataFrame:
    """(collection_id, value): 'stack weight' in byte order of the stacks."""
    return stacks.orderBy(CID, "stack").select(CID, F.concat_ws(" ", "stack", F.col("weight").cast("string")).alias("value"))


def write_folded(stacks: DataFrame, path: str) -> None:
    """A folder of text for each collection."""
    folded_lines(stacks).write.partitionBy(CID).text(path)


def percent_text(c: str | Column) -> Column:
    return F.format_string("%.2f%%", (F.col(c) if isinstance(c, str) else c).cast("double"))


def with_percent_text(stats: DataFrame, *costs: str, totals: DataFrame | None = None) -> DataFrame:
    """stats with {cost}_pct as text: from such a column, else from the collections' totals above 0; without either as it is."""
    if all(f"{c}_pct" in stats.columns for c in costs):
        return stats.withColumns({f"{c}_pct": percent_text(f"{c}_pct") for c in costs})
    if totals is None:
        return stats
    d = stats.join(totals, CID).filter(F.col("total") > 0)
    return d.withColumns({f"{c}_pct": percent_text(F.col(c) * 100.0 / F.col("total")) for c in costs}).drop("total")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, also of an empty table."""
    df.write.option("header", True).csv(path)


def _with_pct(stats: DataFrame, first: tuple[str, ...], costs: tuple[str, ...]) -> DataFrame:
    cols = [x for c in costs for x in (c, f"{c}_pct") if x in stats.columns]
    return stats.select(CID, *first, *cols)


def symbol_stats_csv(stats: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """symbol, inclusive[, inclusive_pct], leaf[, leaf_pct]"""
    return _with_pct(with_percent_text(stats, "inclusive", "leaf", totals=totals), ("symbol",), ("inclusive", "leaf"))


def stack_stats_csv(stats: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """stack, weight[, weight_pct]"""
    return _with_pct(with_percent_text(stats, "weight", totals=totals), ("stack",), ("weight",))


def path_stats_csv(stats: DataFrame) -> DataFrame:
    """path, count, percent"""
    return stats.select(CID, F.array_join("path", ";").alias("path"), "count", percent_text("percent").alias("percent"))


def write_all_csv(tables: Mapping[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        write_csv(df, f"{folder}/{name}")


def exported_to_csv(path: str) -> Callable:
    """Decorator: what the function returns is also written as CSV."""

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(f)
        def run(*a, **k):
            df = f(*a, **k)
            write_csv(df, path)
            return df

        return run

    return wrap


def rounded_records(df: DataFrame, digits: int = 2) -> DataFrame:
    """Fractions rounded half to even."""
    return df.select(*[F.bround(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def write_records(df: DataFrame, path: str) -> None:
    rounded_records(df).write.json(path)


def groups_json(groups: DataFrame) -> DataFrame:
    """(collection_id, js): a module's cluster and functions as one JSON text."""
    return groups.select(CID, F.to_json(F.struct("cluster", "dso", "functions")).alias("js"))
