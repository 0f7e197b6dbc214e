"""A tree of rules over context rows: each rule has a condition; a rule holds if it and all rules above it hold."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.operators import CID
from tracelake.operators.conditions import condition

#: The thresholds of the default rules.
CONFIG = {
    "ON_CPU_THRESHOLD_PERCENT": 50, "CPU_CLUSTER_IDLE_THRESHOLD": 10.0, "CPU_CLUSTER_BUSY_THRESHOLD": 40.0, "CPU_MAX_UTIL_HIGH_THRESHOLD": 80.0,
    "NUMA_IMBALANCE_THRESHOLD": 20.0, "IO_QUEUE_LOW_THRESHOLD": 10.0, "IO_QUEUE_HIGH_THRESHOLD": 80.0, "IO_UTIL_HIGH_THRESHOLD": 75.0,
    "IO_WAIT_HIGH_THRESHOLD": 10.0, "IO_AWAIT_HDD_THRESHOLD": 30.0, "IO_AWAIT_SATA_SSD_THRESHOLD": 5.0, "IO_AWAIT_NVME_SSD_THRESHOLD": 1.0,
    "IO_LARGE_REQ_SIZE_THRESHOLD": 64.0, "IO_SMALL_REQ_SIZE_THRESHOLD": 16.0,
}


@dataclass(frozen=True)
class Rule:
    name: str
    precondition: str = "True"
    finding: str = ""
    sub_rules: tuple["Rule", ...] = field(default=())


#: The names, order and conditions of the default rules, which must hold for the same cases; a caller's own come from a
#: file (`load_rules`).  Findings name their figures in braces.
RULES = (
    Rule("affinity audit", "affinity_check_enabled", "affinity is checked", (
        Rule("affinity holds", "affinity_leakage_count == 0 and affinity_absent_count == 0", "the busy cores are the expected ones"),
        Rule("leakage", "affinity_leakage_count > 0", "{affinity_leakage_count} unexpected busy cores: {leakage_cores_str}"),
        Rule("absence", "affinity_absent_count > 0", "{affinity_absent_count} expected cores are not busy: {absent_cores_str}"),
    )),
    Rule("diagnosis", "True", "", (
        Rule("OFF-CPU", "total_cpu <= ON_CPU_THRESHOLD_PERCENT", "OFF-CPU: load {total_cpu:.2f}%, threshold {ON_CPU_THRESHOLD_PERCENT}%"),
        Rule("ON-CPU", "total_cpu > ON_CPU_THRESHOLD_PERCENT", "ON-CPU: load {total_cpu:.2f}%, threshold {ON_CPU_THRESHOLD_PERCENT}%"),
        Rule("architecture", "is_cpu_imbalanced or (numa_nodes_count > 1 and numa_max_diff > NUMA_IMBALANCE_THRESHOLD)", "", (
            Rule("core imbalance", "is_cpu_imbalanced", "cores fall into {cpu_clusters_count} classes"),
            Rule("node imbalance", "numa_nodes_count > 1 and numa_max_diff > NUMA_IMBALANCE_THRESHOLD", "nodes differ by {numa_max_diff:.1f}%: {numa_status_msg}"),
        )),
        Rule("disk I/O", "(p95_disk_util > IO_UTIL_HIGH_THRESHOLD or p95_avgqu_sz > IO_QUEUE_HIGH_THRESHOLD) or (((busiest_disk_subtype == 'HDD' and p95_disk_await > IO_AWAIT_HDD_THRESHOLD) or (busiest_disk_subtype == 'SATA_SSD' and p95_disk_await > IO_AWAIT_SATA_SSD_THRESHOLD) or (busiest_disk_subtype == 'NVME_SSD' and p95_disk_await > IO_AWAIT_NVME_SSD_THRESHOLD)) and p95_single_core_iowait > IO_WAIT_HIGH_THRESHOLD)", "disk I/O limits: {busiest_disk_name} ({busiest_disk_subtype}), utilisation {p95_disk_util:.2f}%, queue {p95_avgqu_sz:.2f}, latency {p95_disk_await:.2f} ms of {effective_await_threshold} ms", (
            Rule("saturation", "p95_disk_util > IO_UTIL_HIGH_THRESHOLD and (((busiest_disk_subtype == 'HDD' and p95_disk_await > IO_AWAIT_HDD_THRESHOLD) or (busiest_disk_subtype == 'SATA_SSD' and p95_disk_await > IO_AWAIT_SATA_SSD_THRESHOLD) or (busiest_disk_subtype == 'NVME_SSD' and p95_disk_await > IO_AWAIT_NVME_SSD_THRESHOLD)) or p95_single_core_iowait > IO_WAIT_HIGH_THRESHOLD)", "the device is saturated at {p95_disk_util:.2f}%", (
                Rule("synchronous I/O", "avg_avgqu_sz < IO_QUEUE_LOW_THRESHOLD and p95_avgqu_sz < IO_QUEUE_LOW_THRESHOLD and p95_single_core_iowait > IO_WAIT_HIGH_THRESHOLD", "short queue {avg_avgqu_sz:.2f}, {iowait_core_count} cores wait"),
                Rule("small requests", "avg_avgrq_sz_kb < IO_SMALL_REQ_SIZE_THRESHOLD", "many requests of {avg_avgrq_sz_kb:.1f} KB"),
                Rule("large requests", "avg_avgrq_sz_kb > IO_LARGE_REQ_SIZE_THRESHOLD", "requests of {avg_avgrq_sz_kb:.1f} KB"),
            )),
            Rule("congestion", "p95_avgqu_sz > IO_QUEUE_HIGH_THRESHOLD", "queue {p95_avgqu_sz:.2f}, threshold {IO_QUEUE_HIGH_THRESHOLD}"),
        )),
    )),
    Rule("idle system", "total_cpu < 5.0 and p95_disk_util < 10.0 and avg_ifutil < 10.0", "the system is idle"),
)


def rules_of(text: str) -> tuple[tuple[Rule, ...], dict]:
    """Rules and thresholds of YAML text with `rules` and `config`; a rule without a condition always holds."""
    import yaml

    data = yaml.safe_load(text) or {}

    def made(node: Mapping) -> Rule:
        return Rule(str(node.get("name", "Unnamed")), str(node.get("precondition", "True")), node.get("finding") or "", tuple(made(x) for x in node.get("sub_rules") or ()))

    return tuple(made(x) for x in data.get("rules") or ()), dict(data.get("config") or {})


def load_rules(path: str) -> tuple[tuple[Rule, ...], dict]:
    """The same of a file, which is small and read by the driver; a missing file has none."""
    import os

    if not os.path.exists(path):
        return (), {}
    with open(path, encoding="utf-8") as f:
        return rules_of(f.read())


def flattened(rules: Sequence[Rule] = RULES) -> list[dict]:
    """Rules in pre-order: (rule_id, parent_id, depth, ord, path, root, name, precondition, finding)."""
    out: list[dict] = []

    def add(r: Rule, parent: int | None, depth: int, path: str, root: str) -> None:
        own, root = len(out), root or r.name
        out.append({"rule_id": own, "parent_id": parent, "depth": depth, "ord": own, "path": path + r.name, "root": root, "name": r.name, "precondition": r.precondition, "finding": r.finding})
        for x in r.sub_rules:
            add(x, own, depth + 1, f"{path}{r.name}/", root)

    for r in rules:
        add(r, None, 0, "", "")
    return out


def finding_text(template: str, names: set[str]) -> Column:
    """The template with its figures: {x:.2f} as a number with two decimals, {x} as text."""
    parts: list[Column] = []
    for literal, name, digits in re.findall(r"([^{}]*)(?:\{(\w+)(?::\.(\d)f)?\})?", template):
        if literal:
            parts.append(F.lit(literal))
        if name:
            if name not in names:
                return F.lit(f"the finding needs {name}")
            parts.append(F.format_string(f"%.{digits}f", F.col(name).cast("double")) if digits else F.col(name).cast("string"))
    return F.concat(*parts) if parts else F.lit("")


def evaluate(context: DataFrame, rules: Sequence[Rule] = RULES, config: Mapping[str, float] = CONFIG) -> DataFrame:
    """(collection_id, rule_id, path, root, depth, active, finding) for every rule: one pass over the context, a column for each rule.

    Conditions are Python's (`conditions`); one that names what the context lacks, or that fails otherwise, makes a rule inactive."""
    d = context.select("*", *[F.lit(v).alias(k) for k, v in config.items() if k not in context.columns])
    nodes = flattened(rules)
    held: list[Column] = []
    rows = []
    for n in nodes:
        own = F.coalesce(condition(n["precondition"], d.schema), F.lit(False))
        held.append(own if n["parent_id"] is None else held[n["parent_id"]] & own)
        text = F.when(held[-1], finding_text(n["finding"], set(d.columns)))
        rows.append(F.struct(F.lit(n["rule_id"]).alias("rule_id"), F.lit(n["path"]).alias("path"), F.lit(n["root"]).alias("root"), F.lit(n["depth"]).alias("depth"), held[-1].alias("active"), text.alias("finding")))
    return d.select(CID, F.explode(F.array(*rows)).alias("r")).select(CID, "r.*")


def findings(evaluated: DataFrame, audit: str = "affinity audit") -> dict[str, DataFrame]:
    """Active rules: the audit's subtree, the rest of the tree, and the findings with a text."""
    on = evaluated.filter("active")
    return {"audit": on.filter(F.col("root") == audit), "tree": on.filter(F.col("root") != audit), "findings": on.filter(F.col("finding") != "")}
