"""Mixing sources to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import table

#: Terms of one inverted Poisson of mean at most 1: the 53-bit uniforms end before the 19th.
TERMS = 20
#: Bytes of a table of sources that is broadcast; a larger one is joined by shuffling both sides.
BROADCAST_BYTES = 8 << 20
SEED = "mix"


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 random bits, from the MD5 of the joined parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _inverse(u: Column, mean: Column) -> Column:
    """The count whose cumulative Poisson probability first exceeds ``u``; ``mean`` is at most 1."""
    state = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("n"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        state,
        lambda s, k: F.struct(
            (s["p"] * mean / k).alias("p"),
            (s["c"] + s["p"] * mean / k).alias("c"),
            (s["n"] + (u >= s["c"]).cast("int")).alias("n"),
        ),
        lambda s: s["n"],
    )


def poisson_count(rate: Column, *key: Column, seed: str = SEED) -> Column:
    """A Poisson(rate) count fixed by the key: the sum of ceil(rate) counts of equal means at most 1."""
    parts = F.greatest(F.ceil(rate), F.lit(1)).cast("int")
    each = rate / parts
    return F.aggregate(
        F.sequence(F.lit(1), parts),
        F.lit(0),
        lambda total, i: total + _inverse(uniform(F.lit(seed), *key, i.cast("string")), each),
    )


def target_rates(docs: DataFrame, source: str = "source", weights: DataFrame | None = None) -> DataFrame:
    """(source, n, rate): the mean repetitions that bring each source to its weight at unchanged corpus size.

    ``weights`` (source, weight) holds the target; a source it does not name gets weight 0. Without it the target is
    the square root of the source's size, which lifts small sources and lowers a dominant one.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.sqrt(F.col("n").cast("double")))
    else:
        given = weights.select(F.col("source").alias("_named"), F.col("weight").cast("double").alias("weight"))
        weighed = sizes.join(given, F.col("source").eqNullSafe(F.col("_named")), "left").drop("_named").fillna(0.0, ["weight"])
    size = F.sum(F.coalesce(F.octet_length(F.col("source").cast("string")), F.lit(0)) + 64)
    total = weighed.agg(F.sum("weight").alias("weights"), F.sum("n").alias("rows"), size.alias("bytes")).first()
    rate = F.lit(0.0)
    if total["weights"]:
        rate = F.col("weight") / F.lit(float(total["weights"])) * F.lit(float(total["rows"])) / F.col("n")
    rates = weighed.select("source", "n", rate.alias("rate"))
    return F.broadcast(rates) if (total["bytes"] or 0) <= BROADCAST_BYTES else rates


def replicate(
    docs: DataFrame, key: str = "doc_id", source: str = "source", weights: DataFrame | None = None, seed: str = SEED
) -> DataFrame:
    """Every row of ``docs`` as often as a hash-seeded Poisson draw says, all rows shuffled globally.

    The draw depends on the seed and the row's key alone, so a recomputed task repeats it and equal keys (repeated
    rows) repeat together. All columns stay; ``copy`` (from 1) and ``mix_key``, the shuffle's sort key, are added and
    replace columns of these names. Rates are joined on the source, as a broadcast while the measured table of
    sources is small, so that the rows move once, by the hash of key and copy; beyond that in an equi-join of one row per
    source, where a source with a third of all rows is only a skewed side. A null source is a source of
    its own, a null key draws like the text ''; an empty table gives no rows.
    """
    docs = docs.drop("copy", "mix_key", "_rate", "_source")
    rates = target_rates(docs, source, weights).select(F.col("source").alias("_source"), F.col("rate").alias("_rate"))
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    drawn = docs.join(rates, F.col(source).eqNullSafe(F.col("_source"))).withColumn("_count", poisson_count(F.col("_rate"), name, seed=seed))
    copies = drawn.filter("_count > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_count")))).drop("_count", "_rate", "_source")
    mixed = copies.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), name, F.col("copy").cast("string")).cast("binary")))
    return mixed.repartition("mix_key").sortWithinPartitions("mix_key", key)


def op10_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate(table(spark, sf_dir, "documents"))


_COUNTS = " + ".join(f"(u >= c{k})::INT" for k in range(TERMS))
_PROBABILITIES = ", ".join(f"p{k - 1} * mean / {k} AS p{k}" for k in range(1, TERMS))
_CUMULATED = ", ".join(f"c{k - 1} + p{k} AS c{k}" for k in range(1, TERMS))

ORACLE = f"""
WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
total AS (SELECT sum(sqrt(n::DOUBLE)) AS w, sum(n)::DOUBLE AS rows FROM sizes),
rates AS (SELECT source, sqrt(n::DOUBLE) / w * rows / n AS rate FROM sizes, total),
parts AS (
  SELECT d.doc_id, d.text, unnest(range(1, greatest(ceil(rate)::BIGINT, 1) + 1)) AS i,
         rate / greatest(ceil(rate)::BIGINT, 1) AS mean
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
draws AS (
  SELECT doc_id, text, ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || i), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u,
         mean, exp(-mean) AS p0, exp(-mean) AS c0 FROM parts),
sums AS (SELECT u, doc_id, text, mean, p0, c0, {_PROBABILITIES}, {_CUMULATED} FROM draws),
counts AS (SELECT doc_id, text, sum({_COUNTS})::BIGINT AS k FROM sums GROUP BY doc_id, text),
copies AS (SELECT doc_id, text, unnest(range(1, k + 1))::INT AS copy FROM counts)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c.copy,
       md5('{SEED}|order|' || coalesce(d.doc_id::VARCHAR, '') || '|' || c.copy) AS mix_key
FROM documents d JOIN copies c ON d.doc_id IS NOT DISTINCT FROM c.doc_id AND d.text IS NOT DISTINCT FROM c.text
"""

QUERIES = {"op10_poisson_mix": op10_poisson_mix}
ORACLES = {"op10_poisson_mix": ORACLE}
