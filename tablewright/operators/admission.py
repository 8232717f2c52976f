"""URL admission by crawl rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import urls

MAX_BROADCAST_BYTES = 64 * 1024 * 1024
MAX_HOST_RULES = 1_000  # rules of one host that every URL of it is compared with


def _fitting(rules: DataFrame, agent: str) -> DataFrame:
    """(host, own, seq, allow, path_prefix) of the rules for this agent; ``own``: named, not ``*``."""
    product = agent.split("/")[0].lower()
    fits = (F.col("agent") == "*") | F.lit(product).contains(F.lower("agent"))
    own = (F.col("agent") != "*").alias("own")
    return rules.filter(fits).select(F.lower("host").alias("_host"), own, "seq", "allow", "path_prefix")


def _rules_by_host(fitting: DataFrame) -> DataFrame:
    """One row per host with its rules in file order; the table is bounded before it is made.

    Rules of a named agent replace those of ``*``.
    """
    rule = F.struct("seq", "allow", "path_prefix")
    grouped = fitting.groupBy("_host").agg(
        F.sort_array(F.collect_list(F.when(F.col("own"), rule))).alias("named"),
        F.sort_array(F.collect_list(F.when(~F.col("own"), rule))).alias("shared"),
    )
    return grouped.select("_host", F.when(F.size("named") > 0, F.col("named")).otherwise(F.col("shared")).alias("_rules"))


def _decision(path: Column) -> Column:
    """First rule whose prefix matches; an empty prefix forbids nothing."""
    matching = F.filter("_rules", lambda r: path.startswith(r["path_prefix"]))
    first = F.get(matching, F.lit(0))
    return F.coalesce(first["allow"] | (first["path_prefix"] == ""), F.lit(True))


def _decided_by_prefix(frontier: DataFrame, fitting: DataFrame, url: str) -> DataFrame:
    """(url, allowed) of every different URL that a rule matches.

    A rule is found by its host and prefix: a URL asks for the prefixes of its
    path that have a length which its host's rules have.  No host's rules are
    gathered; what is kept per host are lengths, of which there are no more
    than characters in the longest prefix.
    """
    first = fitting.groupBy("_host", "own", "path_prefix").agg(F.min(F.struct("seq", "allow")).alias("_rule"))
    size = F.length("path_prefix")
    hosts = first.groupBy("_host").agg(
        F.bool_or("own").alias("own"),
        F.collect_set(F.when(F.col("own"), size)).alias("_named"),
        F.collect_set(F.when(~F.col("own"), size)).alias("_shared"),
    )
    asking = frontier.select(F.col(url).alias("_url")).distinct()
    asking = asking.withColumn("_host", urls.host_of(F.col("_url"))).withColumn("_path", urls.path_of(F.col("_url")))
    sizes = F.when(F.col("own"), F.col("_named")).otherwise(F.col("_shared"))
    keyed = asking.join(hosts, "_host").withColumn("_size", F.explode(sizes)).filter(F.col("_size") <= F.length("_path"))
    keyed = keyed.select("_url", "_host", "own", F.substring(F.col("_path"), F.lit(1), F.col("_size")).alias("path_prefix"))
    hits = keyed.join(first, ["_host", "own", "path_prefix"])
    rule = F.struct("_rule.seq", (F.col("_rule.allow") | (F.col("path_prefix") == "")).alias("allowed"))
    return hits.groupBy("_url").agg(F.min(rule)["allowed"].alias("allowed"))


def admit_urls(
    frontier: DataFrame, rules: DataFrame, agent: str = "*", url: str = "url"
) -> DataFrame:
    """Add ``allowed`` to every URL; a host without rules allows everything.

    While all rules fit ``MAX_BROADCAST_BYTES`` and no host has more than
    ``MAX_HOST_RULES`` (both measured first), they become one broadcast row
    per host and nothing is shuffled.  Beyond that rules are joined by host and
    prefix; different URLs are decided once and joined back.
    """
    fitting = _fitting(rules, agent)
    row_bytes = (F.octet_length("_host") + F.octet_length("path_prefix") + 64).cast("bigint")
    per_host = fitting.groupBy("_host").agg(F.sum(row_bytes).alias("bytes"), F.count(F.lit(1)).alias("rules"))
    size = per_host.agg(F.sum("bytes"), F.max("rules")).first()
    if (size[0] or 0) <= MAX_BROADCAST_BYTES and (size[1] or 0) <= MAX_HOST_RULES:
        joined = frontier.withColumn("_host", urls.host_of(F.col(url))).join(F.broadcast(_rules_by_host(fitting)), "_host", "left")
        allowed = _decision(urls.path_of(F.col(url)))
        return joined.withColumn("allowed", allowed).select(*frontier.columns, "allowed")
    decided = _decided_by_prefix(frontier, fitting, url)
    joined = frontier.join(decided.withColumnRenamed("allowed", "_allowed"), F.col(url) == F.col("_url"), "left")
    return joined.select(*[frontier[f"`{c}`"] for c in frontier.columns], F.coalesce("_allowed", F.lit(True)).alias("allowed"))
