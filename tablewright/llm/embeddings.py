"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import components, table, written

SIMILARITY = 0.9
#: Vectors that the rotations are learnt from (the smallest hashes), least bits of a code, and steps of learning a rotation.
SAMPLE_ROWS, CODE_BITS, STEPS = 4000, 512, 30
#: A table's key has as many bits as the logarithm of the number of vectors, at least and at most so many.
LEAST_BITS, MOST_BITS = 8, 40
#: Least share of the pairs at the limit itself that meet in some table, and most tables for it.
LEAST_RECALL, MOST_TABLES = 0.95, 4096
#: Members of a bucket that meet at once; larger buckets are cut into pairs of tiles. Rows of a group of buckets.
TILE, GROUP_ROWS = 512, 40_000
#: Pairs compared at a time. With more than WIDE tables both numbers shrink, as a row's keys take more room.
PAIRS, WIDE = 1 << 17, 64
#: Rows whose signs are taken at a time.
SIGN_ROWS = 4096


def iterative_quantisation(sample: np.ndarray, bits: int = CODE_BITS, steps: int = STEPS, seed: int = 0) -> np.ndarray:
    """(dimensions, bits or a few more): orthogonal turns, side by side, after which signs lose least of the vectors.

    Each starts from a random turn and alternates between the signs of the turned sample and the turn that fits them
    best (orthogonal Procrustes), which balances the bits' variances.
    """
    draw, found = np.random.default_rng(seed), []
    for _ in range(-(-bits // sample.shape[1])):
        turn = np.linalg.qr(draw.normal(size=(sample.shape[1],) * 2))[0]
        for _ in range(steps if len(sample) else 0):
            u, _, v = np.linalg.svd(np.sign(sample @ turn).T @ sample)
            turn = (u @ v).T
        found.append(turn)
    return np.hstack(found)


def unit_rows(vectors: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows can link, their unit vectors): of ``size`` finite components and not zero, in double precision."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = np.array([-1 if n is None else n for n in pc.list_value_length(vectors).to_pylist()], dtype=np.int64)
    whole = lengths == size
    flat = vectors.filter(pa.array(whole)).flatten().cast(pa.float64())
    matrix = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, size) if size else np.zeros((int(whole.sum()), 0))
    good = np.isfinite(matrix).all(axis=1)
    scale = np.where(good, np.abs(np.where(np.isfinite(matrix), matrix, 0)).max(axis=1, initial=0), 0)
    good &= scale > 0
    matrix = matrix[good] / scale[good][:, None]
    rows = np.flatnonzero(whole)[good]
    return rows, matrix / np.sqrt((matrix**2).sum(axis=1))[:, None]


def table_keys(units: np.ndarray, turns: np.ndarray, bits: int) -> np.ndarray:
    """(vectors, tables): the code of each vector cut into as many keys of ``bits`` bits as it fills."""
    tables = turns.shape[1] // bits
    weights = np.int64(1) << np.arange(bits, dtype=np.int64)
    keys = np.empty((len(units), tables), dtype=np.int64)
    for first in range(0, len(units), SIGN_ROWS):
        signs = (units[first : first + SIGN_ROWS] @ turns[:, : tables * bits] > 0).astype(np.int64)
        keys[first : first + SIGN_ROWS] = signs.reshape(len(signs), tables, bits) @ weights
    return keys


def tables_needed(bits: int, similarity: float) -> int:
    """Tables of keys of so many bits in which LEAST_RECALL of the pairs of this cosine share a key at least once."""
    same = (1 - math.acos(min(1.0, max(-1.0, similarity))) / math.pi) ** bits
    return 1 if same >= LEAST_RECALL else math.ceil(math.log(1 - LEAST_RECALL) / math.log1p(-same)) if same > 1e-12 else 1 << 40


def learn(vectors: DataFrame, column: str, size: int, bits: int = CODE_BITS) -> np.ndarray:
    """Rotations to a code of ``bits`` bits or a few more, from at most SAMPLE_ROWS vectors."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, units = unit_rows(batch.column(0), size)
            yield pa.RecordBatch.from_arrays([pa.array(units.tolist(), pa.list_(pa.float64()))], names=["unit"])

    chosen = vectors.select(F.col(column)).orderBy(F.xxhash64(column), column).limit(SAMPLE_ROWS).mapInArrow(clean, "unit array<double>")
    found = [r["unit"] for r in chosen.collect()]
    return iterative_quantisation(np.array(found, dtype=np.float64).reshape(len(found), size), bits)


def near_duplicates(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", similarity: float = SIMILARITY) -> DataFrame:
    """(key, n_links, component, kept) of every row: links are pairs of rows of cosine ``similarity`` or more.

    Equal vectors are one class and count as links of each other. A class's code, its signs after the learnt
    rotations, is cut into the keys of m tables, so that classes whose codes differ in fewer than m bits share a key,
    and most that differ in more. Longer keys meet more rarely, so m grows with their length: about LEAST_RECALL of the
    pairs at the limit share a key, whatever the number of vectors. Classes that share a key are compared by their original vectors in double precision.
    A pair counts in the first table where it meets: no pair leaves a task, only sums and one smaller neighbour of
    each class and bucket. A bucket of more than TILE classes is cut into tiles and each pair of tiles is met apart,
    so that no group grows with a popular neighbourhood. Keys grow with the logarithm of the number of vectors, which
    keeps chance meetings in proportion to the input.

    Vectors that are null, empty, zero, of another length than most, or hold null or non-finite components link with
    nothing and are kept. Repeated rows of one key count as rows. An empty table gives no rows; other columns are
    ignored. Which pairs are found depends on sample and tables; none below the limit is.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("key"), F.col(column).alias("vector")).withColumn("_class", F.sha2(F.to_json(F.struct(F.transform("vector", lambda x: x.cast("double")).alias("v"))), 256))
    usual = rows.filter("size(vector) > 0").groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    if usual is None:
        return rows.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component"), F.lit(True).alias("kept"))
    size = usual["size"]
    classes = rows.groupBy("_class").agg(F.count("*").alias("n"), F.min("key").alias("first"), F.first("vector").alias("vector"))
    classes = written(classes.withColumn("_id", F.monotonically_increasing_id()), "classes")
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(2, usual["n"])))))
    while bits > 1 and tables_needed(bits, similarity) > MOST_TABLES:
        bits -= 1
    turns = learn(classes, "vector", size, max(CODE_BITS, bits * tables_needed(bits, similarity)))
    tables = turns.shape[1] // bits
    wide = max(tables, WIDE)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, units = unit_rows(batch.column(1), size)
            buckets = (np.arange(tables, dtype=np.int64)[None, :] << MOST_BITS) | table_keys(units, turns, bits)
            columns = [pa.array(buckets.ravel(), pa.int64()), batch.column(0).take(pa.array(np.repeat(good, tables)))]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "_id"])

    source = classes.select("_id", "n", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    placed = written(source.select("_id", "vector").mapInArrow(spread, "bucket long, _id long"), "buckets")
    tiles = F.ceil(F.col("members") / F.lit(TILE)).cast("int")
    counts = placed.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1").select("bucket", tiles.alias("tiles"))
    met = placed.join(counts, "bucket").withColumn("own", F.pmod(F.xxhash64("_id"), F.col("tiles")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.select("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "_id")
    groups = max(1, usual["n"] * tables // max(1, GROUP_ROWS * WIDE // wide))
    met = met.join(source, "_id").withColumn("group", F.pmod(F.xxhash64("bucket", "low", "high"), F.lit(groups)))

    def compare(group: pa.Table) -> pa.Table:
        bucket, low, high, own, ids, rows_ = (group.column(c).to_numpy() for c in ("bucket", "low", "high", "own", "_id", "n"))
        order = np.lexsort((ids, high, low, bucket))
        bucket, low, high, own, ids, rows_ = (x[order] for x in (bucket, low, high, own, ids, rows_))
        _, units = unit_rows(group.column("vector"), size)
        units = units[order]
        keys = table_keys(units, turns, bits)
        head = np.flatnonzero(np.append(True, (np.diff(bucket) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)))
        end = np.repeat(np.append(head[1:], len(ids)), np.diff(np.append(head, len(ids))))
        links, smallest = np.zeros(len(ids), np.int64), ids.copy()
        left, step, at_once = np.arange(len(ids)), 0, max(1, PAIRS * WIDE // wide)
        while len(left):
            step += 1
            left = left[left + step < end[left]]
            for first in range(0, len(left), at_once):
                i = left[first : first + at_once]
                j = i + step
                apart = (low[i] == high[i]) | (own[i] != own[j])
                i, j = i[apart], j[apart]
                fresh = (keys[i] == keys[j]).argmax(axis=1) == bucket[i] >> MOST_BITS
                i, j = i[fresh], j[fresh]
                close = np.einsum("ij,ij->i", units[i], units[j]) >= similarity
                i, j = i[close], j[close]
                np.add.at(links, i, rows_[j])
                np.add.at(links, j, rows_[i])
                np.minimum.at(smallest, j, ids[i])
        hit = np.flatnonzero(links)
        return pa.table({"_id": pa.array(ids[hit]), "links": pa.array(links[hit]), "to": pa.array(smallest[hit])})

    found = written(met.groupBy("group").applyInArrow(compare, "_id long, links long, to long"), "links")
    linked = found.groupBy("_id").agg(F.sum("links").alias("links"))
    joined = components(found.filter("_id != to").select(F.col("_id").alias("src"), F.col("to").alias("dst")))
    named = classes.join(linked, "_id", "left").join(joined.withColumnRenamed("node", "_id"), "_id", "left")
    named = named.withColumn("component", F.coalesce("component", "_id"))
    lowest = named.groupBy("component").agg(F.min("first").alias("lowest"))
    good = F.size("vector") == size
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)
    named = named.join(lowest, "component").select("_class", F.when(good & finite, F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "lowest")
    out = rows.select("key", "_class").join(named, "_class")
    component = F.when(F.col("links").isNotNull(), F.col("lowest")).otherwise(F.col("key"))
    return out.select(F.col("key").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component"), F.col("key").eqNullSafe(component).alias("kept"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("component", "component_id")


QUERIES = {"op9_embeddings": op9_embeddings}
ORACLES: dict[str, str] = {}
