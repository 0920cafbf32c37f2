"""URL rules by a sort-merge range join.

A host's canonical key is its labels in reverse order, each followed by a dot, so a host and all its subdomains
are the interval of keys that begin with the host's. Sorted, the intervals nest. A sweep over the sorted keys of
hosts and rules carries the last rule host passed with its stack, the rule hosts that enclose it; a host's active
rules are those of the stack that have not ended, that is whose key begins its own.

The sweep is dealt out by ranges of keys, and each range begins with the stack that the ranges before it leave.
Only distinct hosts take part, however many URLs each has. A URL's rule is the longest of its host's active rules
whose path begins the URL's path; equally long ones are decided by text, the smaller first.

A null URL, or one without ``://``, has an empty host and path, fits no rule and gets the default verdict, like
every URL that no rule fits. Repeated URLs each get their row; of rules given twice the first verdict by text
counts. An empty table of pages or of rules is allowed. Input columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.common import without
from tallyline.session import cut_lineage

RESULTS = ("host", "path", "rule", "verdict")


def lower_ascii(host: Column) -> Column:
    """A-Z in lower case; other letters stay, in hosts of URLs and of rules alike."""
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#``, ASCII letters in lower case."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels in reverse order, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def enclosing(key: Column) -> Column:
    """The keys of a host and of its parent domains, shortest first."""
    labels = F.split(F.rtrim(key, F.lit(".")), r"\.", -1)
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit("."))
    )


def rule_stacks(rules: DataFrame) -> DataFrame:
    """One row per rule host: its key and the stack of rules (host key, path, rule, verdict) that enclose it.

    ``rules`` has host, path and verdict. A rule host's stack holds its own rules and those of its parent domains.
    """
    each = (
        rules.withColumn("host", lower_ascii(F.col("host")))
        .groupBy("host", "path")
        .agg(F.min("verdict").alias("verdict"))
        .select(host_key(F.col("host")).alias("key"), "path", F.concat("host", "path").alias("rule"), "verdict")
    )
    parents = each.select("key").distinct().select("key", F.explode(enclosing(F.col("key"))).alias("parent"))
    entry = F.struct(F.col("parent").alias("key"), "path", "rule", "verdict")
    return (
        parents.join(each.withColumnRenamed("key", "parent"), "parent")
        .groupBy("key")
        .agg(F.sort_array(F.collect_list(entry)).alias("stack"))
    )


def active_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """The hosts (column ``key``, distinct) inside some rule's interval, with the rules active there."""
    stacks = rule_stacks(rules)
    none = stacks.schema["stack"].dataType
    # Rules come before hosts of the same key.
    events = hosts.select("key", F.lit(1).alias("kind"), F.lit(None).cast(none).alias("stack")).unionByName(
        stacks.select("key", F.lit(0).alias("kind"), "stack")
    )
    # The ranges of keys are drawn by sampling: written down before anything depends on them.
    dealt = cut_lineage(events.repartitionByRange("key", "kind").withColumn("part", F.spark_partition_id()))
    in_order = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    # One row per range that has a rule, at most as many as there are partitions.
    ends = dealt.where("kind = 0").groupBy("part").agg(F.max(F.struct("key", "stack"))["stack"].alias("left_by"))
    every = dealt.select("part").distinct().join(ends, "part", "left")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select("part", F.last("left_by", ignorenulls=True).over(before).alias("carried"))
    swept = dealt.withColumn("passed", F.last("stack", ignorenulls=True).over(in_order)).where("kind = 1")
    return (
        swept.join(carried, "part")
        .select("key", F.coalesce("passed", "carried").alias("stack"))
        .withColumn("stack", F.filter("stack", lambda r: F.startswith(F.col("key"), r["key"])))
        .where(F.size("stack") > 0)
    )


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, the rule that fits (null if none) and the verdict."""
    kept = [f"`{c}`" for c in without(pages, [r for r in RESULTS if r != url])]
    pages = pages.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if url.lower() in RESULTS:
        pages = pages.drop(url)
    pages = pages.withColumn("_host_key", F.when(F.col("host") != "", host_key(F.col("host"))))
    hosts = pages.where("_host_key IS NOT NULL").select(F.col("_host_key").alias("key")).distinct()
    active = active_rules(hosts, rules).select(F.col("key").alias("_host_key"), F.col("stack").alias("_stack"))
    fitting = F.filter("_stack", lambda r: F.startswith(F.col("path"), r["path"]))
    ranked = F.transform(
        fitting,
        lambda r: F.struct((-F.length(r["rule"])).alias("order"), r["rule"].alias("rule"), r["verdict"].alias("verdict")),
    )
    best = F.array_min(ranked)
    return (
        pages.join(active, "_host_key", "left")
        .withColumn("_best", best)
        .withColumn("rule", F.col("_best.rule"))
        .withColumn("verdict", F.coalesce("_best.verdict", F.lit(default)))
        .drop("_host_key", "_stack", "_best")
    )
