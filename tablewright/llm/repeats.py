"""Removal of repeated byte strings: suffix arrays over shards of the strings that can repeat."""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import CHUNK_BYTES, bounded_batches, drop_written, mix64, span_hashes, table, text_chunks, written
from tablewright.llm.suffix_arrays import common_prefixes, suffix_array

#: Bytes that must repeat, and bytes of an anchor: the byte string of least hash inside such a stretch.
LENGTH, ANCHOR = 50, 20
#: Text of a block of documents, and pieces of a shard, that one task works on.
BLOCK_BYTES, SHARD_BYTES = 8 << 20, 3 << 20
#: An anchor in so many blocks or more is common: its stretches are dealt to shards one by one, not by the anchor.
COMMON_BLOCKS = 256
#: Blocks whose hashes a bucket gathers, and bytes of a piece's place in a shuffle.
BUCKET_BLOCKS, PLACE_BYTES = 4, 40
#: Bytes of pieces and places to shuffle at a time, per byte of text.
MOVED_BYTES = 1.5
#: Pieces are cut out of overlapping stretches: what follows in a file is mostly in it already.
_PIECE_FILES = {"compression": "zstd", "parquet.enable.dictionary#piece": "false"}
_LAST = (1 << 63) - 1


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, anchor places, anchor hashes, rows) of all stretches of LENGTH bytes inside a row."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none.astype(np.uint64), none
    places = np.arange(len(data) - ANCHOR + 1)
    hashes = span_hashes(data, places, places + ANCHOR)
    shift = np.uint64(max(20, len(data).bit_length()))
    least = (hashes >> shift << shift) | places.astype(np.uint64)
    width, reach = LENGTH - ANCHOR + 1, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    starts = np.flatnonzero(np.arange(len(least)) + LENGTH <= offsets[1:][row])
    at = (least[starts] & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
    return starts, at, hashes[at] & ~np.uint64(1), row[starts]


def _runs(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of stretches with one anchor."""
    first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (rows[1:] != rows[:-1])))
    return first, np.append(first[1:], len(at)) - 1


def _originals(docs: pa.Table, copies: pa.Table) -> pa.Table:
    """The block's rows that are no copies of an earlier document's text, each once."""
    names = ["doc", "tag"]
    gone = set(zip(*(copies.column(c).to_pylist() for c in names)))
    keep = []
    for i, row in enumerate(zip(*(docs.column(c).to_pylist() for c in names))):
        if row not in gone:
            gone.add(row)
            keep.append(i)
    return docs if len(keep) == docs.num_rows else docs.take(pa.array(keep, pa.int64()))


def _packed(values: np.ndarray) -> bytes:
    """Sorted 32-bit values by bytes, the high ones first: those of neighbours hardly differ and take no room."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T[::-1].tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, dtype=np.uint8).reshape(4, -1)[::-1].T).view("<u4")[:, 0]


def _codes(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and, below it, 32 bits of each hash. Hashes of one code are taken for equal; that can only add pieces."""
    return (mix64(hashes >> np.uint64(1)) % np.uint64(buckets)) << np.uint64(32) | hashes >> np.uint64(32)


def _anchors_of_block(buckets: int):
    """Per bucket, the codes of the block's different anchors, and bits that say which of them two documents hold."""

    def of(group: pa.Table, copies: pa.Table) -> pa.Table:
        group, found, docs = _originals(group, copies), [], []
        keys = group.column("doc").to_numpy()
        for first, data, offsets in text_chunks(group.column("text")):
            _, at, hashes, rows = anchors(data, offsets)
            if len(at):
                run, _ = _runs(at, rows)
                found.append(_codes(hashes[run], buckets))
                docs.append(keys[first + rows[run]])
        if not found:
            return pa.table({"bucket": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "hashes": pa.array([], pa.binary()), "twice": pa.array([], pa.binary())})
        block = group.column("block")[0].as_py()
        codes, doc = np.concatenate(found), np.concatenate(docs)
        order = np.lexsort((doc, codes))
        codes, doc = codes[order], doc[order]
        head = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        tail = np.append(head[1:], len(codes)) - 1
        values, twice = codes[head], doc[head] != doc[tail]
        cuts = np.searchsorted(values, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
        full = np.flatnonzero(np.diff(cuts))
        blobs = [_packed(values[cuts[b] : cuts[b + 1]]) for b in full]
        bits = [np.packbits(twice[cuts[b] : cuts[b + 1]]).tobytes() for b in full]
        return pa.table({"bucket": pa.array(full, pa.int64()), "block": pa.array([block] * len(full), pa.int64()), "hashes": pa.array(blobs, pa.binary()), "twice": pa.array(bits, pa.binary())})

    return of


def _repeated_anchors(group: pa.Table) -> pa.Table:
    """To each block, those of its codes that another document has too, and bits that mark common ones."""
    bucket, blocks = group.column("bucket")[0].as_py(), group.column("block").to_numpy()
    parts = [_unpacked(b) for b in group.column("hashes").to_pylist()]
    sizes = np.array([len(p) for p in parts])
    values = np.concatenate(parts)
    both = np.concatenate([np.unpackbits(np.frombuffer(b, dtype=np.uint8), count=n) for b, n in zip(group.column("twice").to_pylist(), sizes)]) == 1
    own = np.repeat(np.arange(len(parts)), sizes)
    codes, where, counts = np.unique(values, return_inverse=True, return_counts=True)
    twice = np.zeros(len(codes), dtype=bool)
    twice[where[both]] = True
    keep = (counts > 1)[where] | twice[where]
    cuts = np.append(0, np.cumsum(np.bincount(own[keep], minlength=len(parts))))
    kept, common = values[keep], (counts >= COMMON_BLOCKS)[where[keep]]
    full = np.flatnonzero(np.diff(cuts))
    hashes = [_packed(kept[cuts[i] : cuts[i + 1]]) for i in full]
    bits = [np.packbits(common[cuts[i] : cuts[i + 1]]).tobytes() for i in full]
    return pa.table({"block": pa.array(blocks[full], pa.int64()), "bucket": pa.array([bucket] * len(full), pa.int64()), "hashes": pa.array(hashes, pa.binary()), "common": pa.array(bits, pa.binary())})


_PIECE = "key long, doc long, tag long, start long, size int, edge boolean, piece binary"


def _edges(key: np.ndarray, name: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """One row of the smallest and one of the largest document of each piece: the others tell nothing more of it."""
    edge = np.zeros(len(key), dtype=bool)
    order = np.lexsort((doc, name, key))
    k, n, d = key[order], name[order], doc[order]
    head = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (n[1:] != n[:-1])))
    tail = np.append(head[1:], len(k)) - 1
    edge[order[head]] = True
    edge[order[tail[d[tail] != d[head]]]] = True
    return edge


def _pieces_of_block(buckets: int):
    """The block's stretches with a repeated anchor, joined while they share it: a row per piece and place."""
    empty = {c: pa.array([], k) for c, k in (("key", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()), ("size", pa.int32()), ("edge", pa.bool_()), ("piece", pa.binary()))}

    def of(docs: pa.Table, lists: pa.Table) -> pa.Table:
        if not docs.num_rows or not lists.num_rows:
            return pa.table(empty)
        told = lists.filter(lists.column("hashes").is_valid())
        if not told.num_rows:
            return pa.table(empty)
        docs = _originals(docs, lists.filter(lists.column("hashes").is_null()))
        parts = [_unpacked(b) for b in told.column("hashes").to_pylist()]
        sizes = np.array([len(p) for p in parts])
        known = np.repeat(told.column("bucket").to_numpy().astype(np.uint64) << np.uint64(32), sizes) | np.concatenate(parts)
        popular = np.concatenate([np.unpackbits(np.frombuffer(b, dtype=np.uint8), count=n) for b, n in zip(told.column("common").to_pylist(), sizes)]) == 1
        order = np.argsort(known)
        known, popular = known[order], popular[order]
        keys, tags = docs.column("doc").to_numpy(), docs.column("tag").to_numpy()
        out: list[pa.Table] = []
        names: list[np.ndarray] = []
        for first, data, offsets in text_chunks(docs.column("text")):
            starts, at, hashes, rows = anchors(data, offsets)
            if not len(at):
                continue
            run, last = _runs(at, rows)
            code = _codes(hashes[run], buckets)
            place = np.minimum(np.searchsorted(known, code), len(known) - 1)
            hit = known[place] == code
            run, last, common = run[hit], last[hit], popular[place[hit]]
            if common.any():  # one piece per stretch
                spread = last[common] - run[common] + 1
                alone = np.repeat(run[common], spread) + np.arange(spread.sum()) - np.repeat(np.cumsum(spread) - spread, spread)
                run, last = np.append(run[~common], alone), np.append(last[~common], alone)
                kind = np.append(np.zeros((~common).sum(), bool), np.ones(len(alone), bool))
            else:
                kind = common
            a, b = starts[run], starts[last] + LENGTH
            name = span_hashes(data, a, b)
            key = np.where(kind, name, hashes[run]).view(np.int64)
            sizes = b - a
            bounds = np.append(0, np.cumsum(sizes))
            source = np.repeat(a - bounds[:-1], sizes) + np.arange(bounds[-1])
            body = data[source]
            piece = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(body.tobytes())])
            row = first + rows[run]
            names.append(name)
            out.append(pa.table({"key": key, "doc": keys[row], "tag": tags[row], "start": a - offsets[rows[run]], "size": sizes.astype(np.int32), "piece": piece}))
        if not out:
            return pa.table(empty)
        found = pa.concat_tables(out)
        edge = _edges(found.column("key").to_numpy(), np.concatenate(names), found.column("doc").to_numpy())
        return found.add_column(5, "edge", pa.array(edge))

    return of


def earlier_stretches(pieces: list[bytes], docs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each piece, the runs [from, to) of stretch starts whose stretch a smaller document of ``docs`` holds too."""
    sizes = np.array([len(p) for p in pieces], dtype=np.int64) + 1
    text = np.frombuffer(b"\0".join(pieces) + b"\0", dtype=np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes) - 1
    text[ends] = 0  # a piece's end; the bytes are 1 and more
    array = suffix_array(text, 257)
    shared = common_prefixes(text, array, LENGTH)[array]
    owner = np.repeat(np.arange(len(pieces)), sizes)
    group = np.cumsum(shared < LENGTH) - 1
    least = np.full(group[-1] + 1, _LAST, dtype=np.int64)
    np.minimum.at(least, group, docs[owner[array]])
    whole = ends[owner[array]] - array >= LENGTH
    covered = np.zeros(len(text) + 1, dtype=np.int8)
    covered[array[whole & (least[group] < docs[owner[array]])]] = 1
    turns = np.flatnonzero(np.diff(np.append(0, covered)))
    lows, highs = turns[::2], turns[1::2]
    mine = owner[lows]
    begin = ends - sizes + 1
    cuts = np.searchsorted(mine, np.arange(len(pieces) + 1))
    return [(lows[a:b] - begin[i], highs[a:b] - begin[i]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def _sort_shard(group: pa.Table) -> pa.Table:
    """A row per piece that several documents hold or that overlaps an earlier one: its smallest document and those runs.

    A piece alone with its key has no neighbour to share a stretch with; the others are sorted.
    """
    docs, last = group.column("low").to_numpy(), group.column("high").to_numpy()
    _, where, counts = np.unique(group.column("key").to_numpy(), return_inverse=True, return_counts=True)
    several = np.flatnonzero(counts[where] > 1)
    none = np.zeros(0, dtype=np.int64)
    runs = [(none, none)] * len(docs)
    if len(several):
        found = earlier_stretches(group.column("piece").take(pa.array(several)).to_pylist(), docs[several])
        for i, run in zip(several.tolist(), found):
            runs[i] = run
    keep = [i for i, (a, _) in enumerate(runs) if len(a) or last[i] > docs[i]]
    take = pa.array(keep, pa.int64())
    lists = [pa.array([runs[i][k].tolist() for i in keep], pa.list_(pa.int32())) for k in (0, 1)]
    return pa.table({"key": group.column("key").take(take), "name": group.column("name").take(take), "low": group.column("low").take(take), "lows": lists[0], "highs": lists[1]})


def exact_copies(rows: DataFrame) -> DataFrame:
    """(doc, tag, size) of the rows (doc, text, tag) whose whole text an earlier document has; texts are not moved."""
    known = rows.select("doc", "tag", F.octet_length("text").alias("size"), F.unhex(F.sha2("text", 256)).alias("digest"))
    first = known.groupBy("digest").agg(F.min("doc").alias("first"))
    return known.join(first, "digest").filter("doc > first").select("doc", "tag", "size").distinct()


def candidate_pieces(rows: DataFrame, copies: DataFrame, blocks: int, buckets: int) -> tuple[DataFrame, dict]:
    """Steps 1 and 2 of ``repeated_spans``: the pieces of all stretches whose anchor another document has; their number
    and the bytes of those at an edge."""
    block = F.pmod(F.xxhash64("doc", "tag"), F.lit(blocks))
    rows = rows.withColumn("block", block).repartition(blocks, "block")
    copies = copies.select(block.alias("block"), "doc", "tag")
    sent = rows.groupBy("block").cogroup(copies.groupBy("block")).applyInArrow(_anchors_of_block(buckets), "bucket long, block long, hashes binary, twice binary")
    lists = sent.groupBy("bucket").applyInArrow(_repeated_anchors, "block long, bucket long, hashes binary, common binary")
    none = {kind: F.lit(None).cast(kind) for kind in ("long", "binary")}
    told = lists.select("block", "bucket", "hashes", "common", none["long"].alias("doc"), none["long"].alias("tag"))
    told = told.union(copies.select("block", none["long"], none["binary"], none["binary"], "doc", "tag"))
    cut = rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_pieces_of_block(buckets), _PIECE)
    seen = Observation()
    cut = cut.observe(seen, F.count("*").alias("n"), F.sum(F.when(F.col("edge"), F.col("size"))).alias("size"))
    return written(cut, "pieces", _PIECE_FILES), seen.get


def _spans_of_part(cut: DataFrame, shards: int) -> DataFrame:
    """Steps 3 and 4 of ``repeated_spans`` for some of the keys."""
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")
    different = cut.filter("edge").select(shard, "key", "piece", "doc").repartition(shards, "shard")
    different = different.groupBy("shard", "key", "piece").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    named = different.withColumn("name", F.xxhash64("piece"))
    answers = written(named.groupBy("shard").applyInArrow(_sort_shard, "key long, name long, low long, lows array<int>, highs array<int>"), "answers")
    met = cut.select("key", "doc", "tag", "start", "size", F.xxhash64("piece").alias("name")).join(answers, ["key", "name"])
    whole = F.array(F.struct(F.col("start").alias("low"), (F.col("start") + F.col("size")).alias("high")))
    part = F.transform(F.arrays_zip("lows", "highs"), lambda r: F.struct((F.col("start") + r["lows"]).alias("low"), (F.col("start") + r["highs"] + (LENGTH - 1)).alias("high")))
    spans = met.select("doc", "tag", F.explode(F.when(F.col("doc") > F.col("low"), whole).otherwise(part)).alias("span"))
    found = written(spans.groupBy("doc", "tag").agg(F.collect_set("span").alias("spans")), "spans")
    drop_written(answers)
    return found


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, tag, spans): the byte spans of each text that stretches of earlier documents cover, unmerged.

    Copies of an earlier document's whole text are told by their digest and covered whole. Every stretch of LENGTH bytes
    of the other texts has an anchor, the byte string of least hash in it, so that equal stretches have equal anchors.
    (1) Blocks of documents send codes of their different anchors to buckets, which answer each block with those that
    another document has too; a code goes once per block, however many documents hold it. (2) Blocks cut out the
    stretches with a repeated anchor, joined to pieces, and mark those that tell the smallest and largest document of
    equal ones; only these move. (3) Shards of different pieces, dealt by anchor, are suffix sorted; neighbours that
    share LENGTH bytes give every stretch its smallest document. (4) Places of a piece look up its answer in an
    equi-join. Anchors in COMMON_BLOCKS blocks or more are dealt stretch by stretch, so that no shard gathers all
    contexts of a popular passage. Pieces overlap, so where much repeats they outweigh the texts: (3) and (4) then take
    the keys in parts, one after the other, each with little more to shuffle than the texts.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.filter(F.octet_length("text") >= LENGTH).withColumn("tag", F.xxhash64("text"))
    copies = written(exact_copies(rows), "copies")
    blocks = max(partitions, math.ceil(size / BLOCK_BYTES))
    cut, seen = candidate_pieces(rows, copies, blocks, max(partitions, math.ceil(blocks / BUCKET_BLOCKS)))
    moved = seen["size"] or 0
    parts = max(1, math.ceil((moved + PLACE_BYTES * seen["n"]) / max(1, MOVED_BYTES * size)))
    shards = max(partitions, math.ceil(moved / (parts * SHARD_BYTES)))
    part = F.pmod(F.xxhash64("key", F.lit(parts)), F.lit(parts))
    found = [_spans_of_part(cut.filter(part == i) if parts > 1 else cut, shards) for i in range(parts)]
    drop_written(cut)
    spans = functools.reduce(DataFrame.union, found)
    if parts > 1:
        spans = spans.groupBy("doc", "tag").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    entire = copies.select("doc", "tag", F.array(F.struct(F.lit(0).cast("long").alias("low"), F.col("size").cast("long").alias("high"))).alias("spans"))
    out = written(spans.union(entire), "spans")
    drop_written(copies, *found)
    return out


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted((s["low"], s["high"]) for s in spans or ()):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, kept, removed) of every row.

    A byte goes if a stretch of LENGTH bytes covers it that also starts in a document with a smaller key; all is judged
    on the input, and stretches never cross documents. ``kept`` is what remains, as bytes; ``removed`` lists the maximal
    removed runs. Null texts are empty; texts shorter than LENGTH bytes stay; rows without a key come last and do not
    remove each other's text, nor do repeated rows of one key. Very long texts are cut like others; an empty table
    gives no rows; other columns are ignored.
    """
    spans = repeated_spans(docs, key, text).select(F.col("doc").alias("_doc"), F.col("tag").alias("_tag"), "spans")
    rows = docs.select(F.col(key).alias(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    joined = rows.withColumn("_key", F.coalesce(F.col(key).cast("long"), F.lit(_LAST))).withColumn("_hash", F.xxhash64("_text"))
    joined = joined.join(spans, (F.col("_key") == F.col("_doc")) & (F.col("_hash") == F.col("_tag")), "left")

    @F.arrow_udf("struct<n_bytes:long,n_removed:long,n_spans:long,kept_sha256:string,kept:binary,removed:array<struct<low:long,high:long>>>")
    def cut(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out, spans_ = [], lists.to_pylist()
        for first, data, offsets in text_chunks(texts):
            raw, at = data.tobytes(), offsets.tolist()
            for i, (a, b) in enumerate(zip(at, at[1:])):
                merged, end, rest = _merged(spans_[first + i]), a, []
                for low, high in merged:
                    rest.append(raw[end : a + low])
                    end = a + high
                kept = b"".join([*rest, raw[end:b]])
                out.append({"n_bytes": b - a, "n_removed": b - a - len(kept), "n_spans": len(merged), "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept, "removed": [{"low": x, "high": y} for x, y in merged]})
        span = pa.struct([("low", pa.int64()), ("high", pa.int64())])
        kind = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("removed", pa.list_(span))])
        return pa.array(out, kind)

    return joined.withColumn("_cut", cut("_text", "spans")).select(key, "_cut.*")


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op1_repeats": op1_repeats}
ORACLES: dict[str, str] = {}
