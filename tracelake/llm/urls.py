"""Url filter by a path-template tree.

Explicit rules judge the urls that they fit, the longest rule first; what they say are the labels of the urls that they fit.  The
others are judged by templates.  Under each host the segments of the paths form a tree; segments of digits, hex or dates become
wildcards, and so do the rare values of a place that has many (segments beyond `levels` by their kind only).  Of the branches of
one place, those whose labelled shares don't differ statistically from that of all are merged: each takes the counts of all of
them.  Purity goes down the tree: a host starts from the share of its urls that are bad, urls without a label counting half as
much and as the prior; each branch smooths its own (merged) share with that of the place above, so that one without labels has
the purity of what is above it.  A template is rejected where its purity reaches the threshold, if its host has at least `least`
labelled urls.

Rows: a null url, or one without ://, has an empty host and path; repeated rows each count; an empty table gives no rows; further
columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import discard, stored
from tracelake.llm.licences import LOWER, UPPER

#: Rule -> verdict; a rule is a host (with its subdomains) and the beginning of a path.
RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.locate("://", url) > 0, url.substr(F.locate("://", url) + 3, F.length(url))).otherwise("")
    after = F.coalesce(after, F.lit(""))
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):
        h, _, p = rule.partition("/")
        out = F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}"), rule).otherwise(out)
    return out


def general(segment: Column) -> Column:
    """A segment, or the wildcard for its kind; an ending stays."""
    s = F.regexp_replace(segment, r"^\d{4}-\d\d?(-\d\d?)?(?=\.|$)", "{date}")
    s = F.regexp_replace(s, r"^\d+(?=\.|$)", "{n}")
    s = F.regexp_replace(s, r"^(?=[0-9a-f-]*\d)[0-9a-f]{8}[0-9a-f-]*(?=\.|$)", "{hex}")
    return F.regexp_replace(s, r"\d{3,}", "{n}")


def templates(shapes: DataFrame, many: int = 12, rare: float = 20.0, levels: int = 8) -> DataFrame:
    """(host, segs, n, labelled, bad) with the nodes of each shape from the host to its template: (level, t), and its template."""
    now = last = shapes.withColumn("t", F.col("host")).withColumn("nodes", F.array(F.struct(F.lit(0).alias("level"), F.col("host").alias("t"))))
    deepest = shapes.agg(F.max(F.size("segs"))).first()[0] or 0
    for i in range(min(deepest, levels)):
        seg = F.get("segs", F.lit(i))
        by = now.filter(F.size("segs") > i).groupBy("t", seg.alias("seg")).agg(F.sum("n").alias("n"))
        wide = by.groupBy("t").agg(F.count("*").alias("kinds"), (F.sum("n") / F.count("*")).alias("mean")).filter((F.col("kinds") > many) & (F.col("mean") < rare))
        low = by.join(wide.select("t"), "t").filter(F.col("n") < rare).select("t", "seg", F.lit("*").alias("low"))
        now = now.withColumn("seg", seg).join(low, ["t", "seg"], "left")
        t = F.concat("t", F.lit("/"), F.coalesce("low", "seg"))
        deeper = F.size("segs") > i
        now = now.withColumn("t", F.when(deeper, t).otherwise(F.col("t"))).drop("low", "seg")
        now = now.withColumn("nodes", F.when(deeper, F.concat("nodes", F.array(F.struct(F.lit(i + 1).alias("level"), F.col("t").alias("t"))))).otherwise(F.col("nodes")))
        now = stored(now)  # the next level reads it several times
        discard(last)
        last = now
    beyond = F.size("segs") > levels
    rest = F.concat("t", F.lit("/"), F.array_join(F.slice("segs", levels + 1, F.greatest(F.size("segs"), F.lit(1))), "/"))
    now = now.withColumn("t", F.when(beyond, rest).otherwise(F.col("t")))
    end = F.array(F.struct(F.lit(levels + 1).alias("level"), F.col("t").alias("t")))
    return now.withColumn("nodes", F.when(beyond, F.concat("nodes", end)).otherwise(F.col("nodes")))


def purities(tree: DataFrame, prior: float, strength: float, z: float) -> DataFrame:
    """(t, purity, seen) of every template; seen: the labelled urls of its host."""
    counts = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
    steps = tree.select("n", "labelled", "bad", F.explode(F.zip_with("nodes", F.concat(F.array(F.lit(None).cast("struct<level:int,t:string>")), F.col("nodes")), lambda x, up: F.struct(x.level.alias("level"), x.t.alias("t"), up.t.alias("up")))).alias("x"))
    node = steps.filter("x.t is not null").groupBy("x.level", "x.t", "x.up").agg(*counts)
    pool = node.filter("labelled > 0").groupBy("level", "up").agg(F.sum("labelled").alias("pl"), F.sum("bad").alias("pb"))
    p = F.col("pb") / F.col("pl")
    error = F.sqrt(F.greatest(p * (1 - p), F.lit(0.01)) / F.col("labelled"))
    like = (F.col("labelled") > 0) & (F.abs(F.col("bad") / F.col("labelled") - p) <= z * error)
    judged = node.filter("level > 0").join(pool, ["level", "up"], "left").select("level", "t", "up", "labelled", "bad", F.coalesce(like, F.lit(False)).alias("like"))
    merged = judged.filter("like").groupBy("level", "up").agg(F.sum("labelled").alias("ml"), F.sum("bad").alias("mb"))
    one = judged.join(merged, ["level", "up"], "left").select("t", F.when(F.col("like"), F.col("ml")).otherwise(F.col("labelled")).alias("labelled"), F.when(F.col("like"), F.col("mb")).otherwise(F.col("bad")).alias("bad"))
    unsaid = 0.5 * (F.col("n") - F.col("labelled")) + strength
    hosts = node.filter("level = 0").select("t", F.col("labelled").alias("seen"), ((F.col("bad") + prior * unsaid) / (F.col("labelled") + unsaid)).alias("start"))
    leaves = tree.groupBy("t").agg(F.any_value("host").alias("host"), F.any_value("nodes").alias("nodes"))  # the same in all rows of a template
    at = leaves.select(F.col("t").alias("leaf"), "host", F.explode("nodes").alias("x")).filter("x.level > 0").select("leaf", "host", "x.level", "x.t")
    down = at.join(one, "t").groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("level", "labelled", "bad"))).alias("steps"))
    whole = leaves.select("t", "host").join(hosts.withColumnRenamed("t", "host"), "host").join(down.withColumnRenamed("leaf", "t"), "t", "left")
    purity = F.aggregate(F.coalesce("steps", F.array().cast("array<struct<level:int,labelled:bigint,bad:bigint>>")), F.col("start"), lambda above, x: (x.bad + strength * above) / (x.labelled + strength))
    return whole.select("t", purity.alias("purity"), "seen")


def judge_urls(
    pages: DataFrame, rules: dict[str, str] | None = None, threshold: float = 0.7, least: int = 3, prior: float = 0.2, strength: float = 2.0, z: float = 1.96, levels: int = 8
) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every row; what the rules say are the labels."""
    rules = RULES if rules is None else rules
    host, path = host_and_path(F.col("url"))
    d = pages.select("page_id", host.alias("host"), path.alias("path"))
    d = d.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    said = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        said = F.when(F.col("rule") == rule, verdict).otherwise(said)
    d = d.withColumn("said", said).withColumn("segs", F.transform(F.filter(F.split("path", "/"), lambda x: x != ""), general))
    shapes = stored(d.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count("said").alias("labelled"), F.count(F.when(F.col("said") == "block", 1)).alias("bad")))
    tree = stored(templates(shapes, levels=levels))
    of = tree.select("host", "segs", "t").join(purities(tree, prior, strength, z), "t")
    reject = (F.col("seen") >= least) & (F.col("purity") >= threshold)
    return d.join(of, ["host", "segs"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("said", F.when(reject, "block").otherwise("allow")).alias("verdict"), F.col("t").alias("template"), "purity"
    )
