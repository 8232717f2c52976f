"""URL filtering by association rules that FP-growth mines from the verdicts of given host and path rules."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import table, written

#: The given rules: (verdict, host suffix, path prefix).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: A mined rule holds for so large a share of the labelled urls at least, and of those with its tokens.
MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.8
#: And for so many labelled urls.
MIN_ROWS = 8
#: Verdict of a url that no rule matches.
DEFAULT = "allow"
_LABEL = "verdict="


def host_of(url: Column) -> Column:
    """What stands behind the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule whose host is the url's or above it and whose path starts the url's."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, suffix, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest last, so outermost
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(suffix + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Tokens of a url: scheme, host labels with their place from the end, path words, numbers as one token, query names."""
    labels = F.filter(F.reverse(F.split(host, r"\.")), lambda x: x != "")
    hosts = F.transform(labels, lambda x, i: F.concat(F.lit("host"), i.cast("string"), F.lit("="), x))
    hyphens = F.transform(F.filter(F.split(host, r"[.\-]"), lambda x: x != ""), lambda x: F.concat(F.lit("part="), x))
    words = F.filter(F.split(F.lower(path), r"[/._\-]+"), lambda x: x != "")
    paths = F.transform(words, lambda x: F.concat(F.lit("path="), F.when(x.rlike("^[0-9]+$"), F.lit("#")).otherwise(x)))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query="), F.substring_index(x, "=", 1)))
    scheme = F.array(F.concat(F.lit("scheme="), F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(.*?)://", 1))))
    return F.array_distinct(F.concat(scheme, hosts, hyphens, paths, names))


def token_classes(labelled: DataFrame) -> DataFrame:
    """(token, item): tokens that the same labelled urls have, told by count and two hash sums over the urls, are one
    item, named by the first of them. Rules cannot tell such tokens apart, and sets of them double with each one.
    ``labelled`` (url, tokens) holds different urls."""
    marks = [F.bit_xor(F.xxhash64("url", F.lit(i))).alias(f"x{i}") for i in range(2)]
    seen = labelled.select("url", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), *marks)
    first = seen.groupBy("n", "x0", "x1").agg(F.min("token").alias("item"))
    return seen.join(first, ["n", "x0", "x1"]).select("token", "item")


def with_items(urls: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """``urls`` (key, tokens and more) with the items of their tokens, ``items``; tokens that no class has are left out."""
    named = urls.select(key, F.explode("tokens").alias("token")).join(classes, "token").groupBy(key).agg(F.collect_set("item").alias("items"))
    return urls.join(named, key, "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))


def mine(labelled: DataFrame, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE, rows: int = MIN_ROWS) -> DataFrame:
    """(items, verdict, confidence, support) of the token combinations that imply a verdict.

    ``labelled`` has ``tokens`` (or items of them) and ``verdict``. A rule stays only if its verdict is more frequent
    with its tokens than without regard to them, and no rule over part of its tokens is as confident. Rules are written
    once, before they are compared.
    """
    baskets = labelled.select(F.array_append("tokens", F.concat(F.lit(_LABEL), F.col("verdict"))).alias("items"))
    least = min(1.0, max(support, rows / max(1, labelled.count())))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=confidence).fit(baskets)
    rules = model.associationRules.filter(F.col("consequent")[0].startswith(_LABEL) & ((F.col("lift") > 1) | (F.col("confidence") == 1))).select(
        F.array_sort("antecedent").alias("items"), F.substring_index(F.col("consequent")[0], "=", -1).alias("verdict"), "confidence", "support"
    )
    rules = written(rules, "rules")
    shorter = rules.select(F.col("items").alias("_items"), F.col("verdict").alias("_verdict"), F.col("confidence").alias("_confidence"))
    subsets = rules.withColumn("_rule", F.monotonically_increasing_id()).select("_rule", "items", "verdict", "confidence", F.explode("items").alias("_token"))
    indexed = shorter.withColumn("_token", F.element_at("_items", 1))
    redundant = subsets.join(indexed, "_token").filter(
        (F.col("verdict") == F.col("_verdict")) & (F.size("_items") < F.size("items")) & (F.col("_confidence") >= F.col("confidence")) & (F.size(F.array_except("_items", "items")) == 0)
    )
    return rules.join(redundant.select("items", "verdict").distinct(), ["items", "verdict"], "left_anti")


def match(urls: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, verdict, confidence) of the best mined rule of each url of ``urls`` (key, tokens) that one matches.

    Rules are indexed by their rarest token; a url's tokens look them up in one equi-join, whose urls' side adaptive
    execution splits where a token is common, and the other tokens are compared on the spot. Best is the most
    confident, then the best supported rule, then a block, then the first by its tokens; a maximum per key, combined
    before the shuffle.
    """
    counts = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    posted = rules.withColumn("_rule", F.monotonically_increasing_id())
    placed = posted.select("*", F.explode("items").alias("token")).join(counts, "token", "left").fillna(0, ["n"])
    rarest = placed.groupBy("_rule", "items", "verdict", "confidence", "support").agg(F.min(F.struct("n", "token")).alias("rarest"))
    index = rarest.select("items", "verdict", "confidence", "support", F.col("rarest.token").alias("token"))
    met = urls.select(key, "tokens", F.explode("tokens").alias("token")).join(index, "token").filter(F.size(F.array_except("items", "tokens")) == 0)
    ranked = F.struct("confidence", "support", F.col("verdict").alias("verdict"), F.concat_ws(" ", "items").alias("items"))
    return met.groupBy(key).agg(F.max(ranked).alias("_best")).select(key, F.col("_best.verdict").alias("verdict"), F.col("_best.confidence").alias("confidence"), F.col("_best.items").alias("mined_rule"))


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(key, url, host, path, rule, verdict, mined_rule) of every row.

    Urls that a given rule fits are the labels; FP-growth learns from all of them which tokens imply a verdict, and
    urls that no given rule fits get the best mined rule's verdict, or DEFAULT. Urls are judged once each and joined
    back, so copies of a url cost a row of a join; null, empty and odd urls have empty parts and no rule. Tokens that the
    same labelled urls have count as one, so that mining does not grow with the length of urls that share their words. A
    table without labels mines nothing; an empty table gives no rows. Other columns are ignored.
    """
    rows = pages.select(F.col(key).alias(key), F.col(url).cast("string").alias("url"))
    known = rows.select("url").distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = known.withColumn("_given", matched_rule(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens(F.col("host"), F.col("path"), F.col("url")))
    known = written(known.withColumn("_url", F.xxhash64("url", F.lit(1))).withColumn("_url2", F.xxhash64("url", F.lit(2))), "urls")
    labelled = known.filter("_given is not null").select("url", "tokens", F.col("_given.verdict").alias("verdict"))
    classes = written(token_classes(labelled), "tokens")
    baskets = with_items(labelled, classes, "url").select(F.col("items").alias("tokens"), "verdict")
    mined = written(mine(baskets, support, confidence), "rules")
    open_ = with_items(known.filter("_given is null").select(F.struct("_url", "_url2").alias("_key"), "tokens"), classes, "_key")
    open_ = open_.select("_key", F.col("items").alias("tokens"))
    best = match(open_, mined, "_key").select(F.col("_key._url").alias("_url"), F.col("_key._url2").alias("_url2"), F.col("verdict").alias("_mined"), "mined_rule")
    judged = known.join(best, ["_url", "_url2"], "left").select(
        F.col("url").alias("_same"), "host", "path", F.col("_given.rule").alias("rule"), F.coalesce("_given.verdict", "_mined", F.lit(DEFAULT)).alias("verdict"), "mined_rule"
    )
    return rows.join(judged, F.col("url").eqNullSafe(F.col("_same"))).select(key, "url", "host", "path", "rule", "verdict", "mined_rule")


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "mined_rule")


QUERIES = {"op3_url_rules": op3_url_rules}
ORACLES: dict[str, str] = {}
