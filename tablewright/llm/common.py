"""Helpers shared by the operators: tables, scratch tables, hash folds, vectorised words, components."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a kernel works on at a time; a longer text is taken alone.
CHUNK_BYTES = 1 << 20

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
#: Spans from this length on get a cryptographic hash: long regular strings collide modulo 2**64 whatever the base.
LONG_SPAN = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Let batches that go to Python end after a few MB: rows of texts differ a thousandfold in size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it is unset, a folder of the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return (folder or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch").rstrip("/")


#: Spark's setting that removes a query's shuffle files when it ends.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there and a lost executor loses nothing.

    The shuffles that made it are not needed after that and are removed. ``options`` are those of the writer.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.options(**(options or {})).parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def measured(df: DataFrame, label: str, **measures: Column) -> tuple[DataFrame, dict]:
    """``written``, and aggregates over its rows that the write itself takes, without a query more."""
    seen = Observation()
    out = written(df.observe(seen, *(column.alias(name) for name, column in measures.items())), label)
    return out, seen.get


def drop_written(*frames: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def fold_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def text_chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, UTF-8 bytes, offsets of the rows) for runs of about ``size`` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    kept = _POWERS.get(0)
    if kept is not None and len(kept[0]) >= n:
        return kept
    size = max(n, CHUNK_BYTES + 1)
    made = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        made.append(np.cumprod(steps, dtype=np.uint64))
    if size <= 4 * CHUNK_BYTES:
        _POWERS[0] = (made[0], made[1])
    return made[0], made[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, the same wherever the span stands."""
    up, down = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    hashes = mix64((prefix[ends] - prefix[starts]) * down[starts])
    for i in np.flatnonzero(ends - starts >= LONG_SPAN).tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return hashes


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the runs of bytes other than 0x20 and 0x09-0x0D."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~_WHITE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest node reachable over ``edges``, for every node that has an edge.

    Alternates two star rewirings, each a minimum per node and an equi-join of a node's edges with that one row, until
    no edge changes, which the write of a round tells. Neighbour lists are never gathered, so a node with a third of all edges is a skewed join side that
    adaptive execution splits. Every round is a table in the shared folder. Null nodes and loops are ignored.
    """
    def kept(found: DataFrame) -> tuple[DataFrame, dict]:
        return measured(found.filter("u > v").distinct(), "edges", n=F.count("*"), x=F.bit_xor(F.xxhash64("u", "v")))

    current, seen = kept(edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")))
    while seen["n"]:
        turned = current.select(F.col("v").alias("u"), F.col("u").alias("v"))
        both = current.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = turned.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after, now = kept(small)
        drop_written(current)
        current = after
        if now == seen:
            break
        seen = now
    found = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
