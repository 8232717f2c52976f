"""Counts of texts that are told apart by their digests.

A text can be long, and most texts occur once.  What is counted and shuffled
is a 256-bit digest and the text's first bytes as two numbers; texts themselves
are fetched only for the few digests that a report names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.operators.columns import quoted, require_batch, require_columns
from tablewright.session import materialize

HEAD_BYTES = 7  # bytes that fit a positive 64-bit integer
FEW = 10_000  # digests that are broadcast


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _head(text: Column, number: int) -> Column:
    """The first (0) or the next (1) bytes as a number that sorts like the text."""
    start = F.lit(number * HEAD_BYTES + 1)
    piece = F.rpad(F.substring(text.cast("binary"), start, F.lit(HEAD_BYTES)), HEAD_BYTES, F.lit(b"\0"))
    return F.conv(F.hex(piece), 16, 10).cast("bigint")


def _stacked(df: DataFrame, columns: Sequence[str], **parts) -> DataFrame:
    """(column number, parts) of every text that is not NULL."""
    cells = [
        F.when(quoted(c).isNotNull(), F.struct(F.lit(i).alias("column"), *[f(quoted(c)).alias(n) for n, f in parts.items()]))
        for i, c in enumerate(columns)
    ]
    return df.select(F.explode(F.array(*cells)).alias("cell")).filter("cell IS NOT NULL").select("cell.*")


def digest_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column number, digest, count, h0, h1): rows of every different text, with its first bytes."""
    stacked = _stacked(df, columns, digest=text_digest, h0=lambda t: _head(t, 0), h1=lambda t: _head(t, 1))
    return stacked.groupBy("column", "digest").agg(F.count(F.lit(1)).alias("count"), F.min("h0").alias("h0"), F.min("h1").alias("h1"))


def top_texts(df: DataFrame, columns: Sequence[str], top: int) -> tuple[dict[str, int], DataFrame]:
    """Distinct texts of each column, and (column, rank, value, count) of the ``top`` most frequent, ties by text.

    Counts decide which digests are in for sure, and their first bytes which of
    those that tie at the last count come first.  Both are fewer than ``top`` a
    column; only digests that tie in both respects can be more, and are joined
    with the rows of just these first bytes where they are too many to broadcast.
    """
    require_batch(df, "top_texts")
    columns = require_columns(df, columns)
    spark = df.sparkSession
    counts = materialize(digest_counts(df, columns), "digests")
    levels = counts.groupBy("column", "count").agg(F.count(F.lit(1)).alias("texts"))
    # as many rows as there are different counts
    running = F.sum("texts").over(Window.partitionBy("column").orderBy(F.desc("count")))
    level = F.max(F.when(F.col("reach") >= top, F.struct("count", (F.col("reach") - F.col("texts")).alias("above"))))
    found = levels.withColumn("reach", running).groupBy("column").agg(F.sum("texts").alias("texts"), level.alias("level")).collect()
    unique = dict.fromkeys(columns, 0) | {columns[r["column"]]: r["texts"] for r in found}
    marks = [(r["column"], *(r["level"] or (0, 0))) for r in found]
    mark = F.broadcast(spark.createDataFrame(marks, "column int, level long, above long"))

    marked = counts.join(mark, "column")
    tied = marked.filter("count = level")
    first = F.row_number().over(Window.partitionBy("column").orderBy("h0", "h1"))
    needed = tied.withColumn("n", first).filter(F.col("n") <= top).filter(F.col("n") <= top - F.col("above"))
    edges = needed.groupBy("column").agg(F.max(F.struct("h0", "h1")).alias("edge")).select("column", F.col("edge.h0").alias("e0"), F.col("edge.h1").alias("e1")).collect()
    edge = F.broadcast(spark.createDataFrame([tuple(r) for r in edges], "column int, e0 long, e1 long"))
    placed = tied.join(edge, "column")
    at_edge = placed.filter("h0 = e0 AND h1 = e1").select("column", "digest", "count")
    sure = marked.filter("count > level").select("column", "digest", "count").unionByName(
        placed.filter("h0 < e0 OR (h0 = e0 AND h1 < e1)").select("column", "digest", "count")
    )

    texts = _stacked(df, columns, digest=text_digest, value=lambda t: t)
    if at_edge.count() <= FEW:
        named = texts.join(F.broadcast(sure.unionByName(at_edge)), ["column", "digest"])
    else:
        near = _stacked(df, columns, h0=lambda t: _head(t, 0), h1=lambda t: _head(t, 1), digest=text_digest, value=lambda t: t)
        near = near.join(edge, "column").filter("h0 = e0 AND h1 = e1").select("column", "digest", "value")
        named = texts.join(F.broadcast(sure), ["column", "digest"]).unionByName(near.join(at_edge, ["column", "digest"]))
    order = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    ranked = named.select("column", "count", "value").distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    name = reduce(lambda c, i: c.when(F.col("column") == i, columns[i]), range(1, len(columns)), F.when(F.col("column") == 0, columns[0]))
    return unique, ranked.select(name.alias("column"), "rank", "value", "count")
