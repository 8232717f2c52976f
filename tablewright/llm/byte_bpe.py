"""Byte-level BPE encoding by overlapping chunks whose pre-tokens resynchronise, and decoding by concatenated bytes."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.common import bounded_batches, drop_written, table, written

RANKS = "byte_bpe_50k.tiktoken"
#: Bytes of a chunk, and how far it reads into the next one. Texts of one chunk at most are encoded where they are.
CHUNK, OVERLAP = 1 << 16, 1 << 10
#: A boundary this near to a chunk's end may depend on what follows: contractions have three characters.
UNSURE = 3
#: Pre-tokens whose ids a worker remembers.
REMEMBERED = 200_000
#: Ids decoded at a time.
DECODED = 1 << 20
#: First byte of the smallest character on which the splitters' tables of letters and digits may disagree (U+0540).
LATE_LEAD = 0xD5
#: The pattern's class of neither white space, letters nor digits.
OTHER = r"[^\s\p{L}\p{N}]"

_CODECS: dict[str, ByteBpe] = {}


class ByteBpe:
    """Ids of texts, pre-token by pre-token, and bytes of ids."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.pattern = public_tokenizers.PATTERN
        self.model = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.find = regex.compile(self.pattern).findall
        self.find_late = None
        self.memory: dict[str, bytes] = {}
        self.tokens = np.frombuffer(b"".join(t for t, _ in sorted(self.ranks.items(), key=lambda x: x[1])), dtype=np.uint8)
        self.starts = np.zeros(max(self.ranks.values()) + 2, dtype=np.int64)
        for token, rank in self.ranks.items():
            self.starts[rank + 1] = len(token)
        np.cumsum(self.starts, out=self.starts)

    def _late_splitter(self):
        """A splitter for late characters: the two libraries know different versions of Unicode, the encoder's counts."""
        import regex
        import tiktoken

        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        single = {bytes([i]): i for i in range(256)}
        pattern, spans = self.pattern.replace(OTHER, "\0"), ""
        for kind in (r"\p{L}", r"\p{N}"):
            encoder = tiktoken.Encoding(kind, pat_str=kind, mergeable_ranks=single, special_tokens={})
            unknown = np.array(sorted(map(ord, set(regex.findall(kind, every)) - set(bytes(encoder.encode_ordinary(every)).decode()))))
            first, last = (unknown[np.diff(unknown, **edge) != 1] for edge in ({"prepend": -1}, {"append": 1 << 21}))
            runs = "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(first, last))
            pattern = pattern.replace(kind, f"[{kind}--[{runs}]]" if runs else kind)
            spans += runs
        return regex.compile(pattern.replace("\0", f"[{OTHER}||[{spans}]]" if spans else OTHER), regex.V1).findall

    def split(self, raw: bytes) -> list[str]:
        """The pre-tokens of UTF-8 bytes."""
        text = raw.decode()
        if text.isascii() or np.frombuffer(raw, dtype=np.uint8).max() < LATE_LEAD:
            return self.find(text)
        self.find_late = self.find_late or self._late_splitter()
        return self.find_late(text)

    def ids(self, parts: list[str]) -> bytes:
        """The little-endian 32-bit ids of pre-tokens."""
        known, out = self.memory, []
        if len(known) > REMEMBERED:
            known.clear()
        for part in parts:
            found = known.get(part)
            if found is None:
                raw = part.encode()
                rank = self.ranks.get(raw)
                one = [rank] if rank is not None else self.model._core_bpe.encode_single_piece(raw)
                found = np.array(one, dtype="<u4").tobytes()
                if len(raw) < 64:
                    known[part] = found
            out.append(found)
        return b"".join(out)

    def bytes_of(self, ids: np.ndarray) -> Iterator[bytes]:
        """The tokens' bytes, one after the other, in stretches."""
        for first in range(0, len(ids), DECODED):
            part = ids[first : first + DECODED].astype(np.int64)
            sizes = self.starts[part + 1] - self.starts[part]
            source = np.repeat(self.starts[part] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            yield self.tokens[source].tobytes()


def ranks_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _codec(path: str) -> ByteBpe:
    if path not in _CODECS:
        _CODECS[path] = ByteBpe(path)
    return _CODECS[path]


def cut_chunks(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """key, row, size, part, start, raw: the texts' bytes in chunks, each reading ``overlap`` into the next, cut at characters."""
    kind = docs.schema[0].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def aligned(raw: bytes, at: int) -> int:
            while at < len(raw) and raw[at] & 0xC0 == 0x80:
                at += 1
            return min(at, len(raw))

        for batch in batches:
            for i, raw in enumerate(batch.column(2).to_pylist()):
                own = batch.slice(i, 1)
                for first in range(0, len(raw), 64 * chunk):
                    at = [aligned(raw, a) for a in range(first, min(first + 64 * chunk, len(raw)), chunk)]
                    parts = [raw[a : aligned(raw, a + chunk + overlap)] for a in at]
                    columns = [own.column(c).take(pa.array([0] * len(at))) for c in (0, 1)]
                    columns += [pa.array([len(raw)] * len(at), pa.int64()), pa.array(range(first // chunk, first // chunk + len(at)), pa.int32())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(at, pa.int64()), pa.array(parts, pa.binary())], names=["key", "row", "size", "part", "start", "raw"])

    return docs.mapInArrow(cut, f"key {kind}, row long, size long, part int, start long, raw binary")


def split_chunks(chunks: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """``chunks`` with ``ends``, where pre-tokens end in the text, and the ends at which a chunk can meet its neighbours.

    ``heads`` are ends within the overlap with the chunk before, ``tails`` those within the next one's. Only ends behind
    a character other than white space count: the last pre-token before is then the same whatever follows. A chunk is
    sure from its first end that any split of the text has, that is one in front of something other than a letter:
    ``tails`` begin there and end where a chunk's end might still matter.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            ends, heads, tails = [], [], []
            for part, start, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "start", "raw"))):
                tokens = codec.split(raw)
                at = start + np.cumsum([len(t.encode()) for t in tokens], dtype=np.int64)
                solid = ~np.array([t.isspace() for t in tokens], dtype=bool)
                fixed = solid[:-1] & ~np.array([t[0].isalpha() for t in tokens[1:]], dtype=bool)
                sure = start if part == 0 else at[np.argmax(fixed)] if fixed.any() else np.inf
                ends.append(at)
                heads.append(np.append(start, at[solid & (at < start + overlap)]))
                tails.append(at[solid & (at >= max(sure, start + chunk)) & (at <= start + len(raw) - 4 * UNSURE)])
            extra = [pa.array(x, pa.list_(pa.int64())) for x in (ends, heads, tails)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "ends", "heads", "tails"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema)
    return chunks.mapInArrow(split, f"{kinds}, ends array<long>, heads array<long>, tails array<long>")


def stitched(chunks: DataFrame) -> DataFrame:
    """key, row, segment, bodies, ends: stretches of texts between ends at which neighbouring chunks agree.

    Chunks meet in an equi-join of one chunk's tails with the next one's heads. Where they share no end, a pre-token is
    longer than the overlap: the chunks are joined to one stretch, whose size is that of the pre-token and two chunks.
    """
    links = chunks.select("row", (F.col("part") + 1).alias("part"), "tails").join(chunks.select("row", "part", "heads"), ["row", "part"])
    links = links.select("row", "part", F.array_min(F.array_intersect("tails", "heads")).alias("link"))
    plan = chunks.select("row", "part", "start", "size").join(links, ["row", "part"], "left")
    plan = plan.withColumn("link", F.when(F.col("part") == 0, 0).otherwise(F.col("link")))
    order = Window.partitionBy("row").orderBy("part")
    plan = plan.select(
        "row",
        "part",
        F.max(F.when(F.col("link").isNotNull(), F.col("part"))).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("segment"),
        F.coalesce("link", "start").alias("low"),
        F.coalesce(F.lead("link").over(order), F.lead("start").over(order), "size").alias("high"),
    )
    cut = chunks.select("key", "row", "part", "start", "raw", "ends").join(plan, ["row", "part"])
    body = F.substring("raw", (F.col("low") - F.col("start") + 1).cast("int"), (F.col("high") - F.col("low")).cast("int"))
    ends = F.transform(F.filter("ends", lambda e: (e > F.col("low")) & (e <= F.col("high"))), lambda e: e - F.col("low"))
    pieces = cut.select("key", "row", "segment", F.struct("part", body.alias("body"), ends.alias("ends")).alias("piece"))
    whole = pieces.groupBy("key", "row", "segment").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    return whole.select("key", "row", "segment", F.col("pieces.body").alias("bodies"), F.col("pieces.ends").alias("ends"))


def _encode_long(docs: DataFrame, path: str, chunk: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """key, n_tokens, ids of texts longer than a chunk; and the written chunks."""
    cut = cut_chunks(docs.select("key", F.monotonically_increasing_id().alias("row"), "raw"), chunk, overlap).repartition("row", "part")
    chunks = written(split_chunks(cut, path, chunk, overlap), "chunks")
    kind = docs.schema[0].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            ids = []
            for bodies, ends in zip(batch.column("bodies").to_pylist(), batch.column("ends").to_pylist()):
                if len(bodies) == 1:
                    parts = [bodies[0][a:b].decode() for a, b in zip([0, *ends[0]], ends[0])]
                else:
                    parts = codec.split(b"".join(bodies))
                ids.append(codec.ids(parts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.binary())], names=["key", "row", "segment", "ids"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [b"".join(x["ids"] for x in segments) for segments in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["key", "n_tokens", "ids"])

    encoded = stitched(chunks).mapInArrow(encode, f"key {kind}, row long, segment int, ids binary")
    whole = encoded.groupBy("key", "row").agg(F.array_sort(F.collect_list(F.struct("segment", "ids"))).alias("segments"))
    return whole.select("key", "segments").mapInArrow(joined, f"key {kind}, n_tokens long, ids binary"), chunks


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """key, n_tokens, ids: the byte-level BPE ids of each text, as little-endian unsigned 32-bit integers.

    Texts of one chunk at most are split and encoded in the task that reads them. Longer ones are cut into overlapping
    chunks that are dealt over all tasks and split there; neighbours are stitched at the first pre-token end that both
    have, and the stretches between are encoded and put in order. What meets in a task is a chunk, a stretch, or the
    ids of one text. The chunks are a table in the shared folder. A null text is empty and has no ids, repeated rows
    stay apart, an empty table gives no rows, columns other than key and text are left out.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path = ranks_path(ranks)
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").cast("binary").alias("raw"))
    kind = texts.schema[0].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            ids = [codec.ids(codec.split(raw)) if raw else b"" for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["key", "n_tokens", "ids"])

    size = F.coalesce(F.octet_length("raw"), F.lit(0))
    done = texts.filter(size <= chunk).mapInArrow(whole, f"key {kind}, n_tokens long, ids binary")
    long, chunks = _encode_long(texts.filter(size > chunk), path, chunk, overlap)
    if chunks.isEmpty():
        drop_written(chunks)
    else:
        done = done.unionByName(long)
    return done.withColumnRenamed("key", key)


def decode(encoded: DataFrame, ids: str = "ids", ranks: str = RANKS) -> DataFrame:
    """``encoded`` with ``decoded``: the bytes that the ids stand for, one token's after the other. No ids give no bytes;
    an id beyond the ranks is an error. A column named decoded is replaced."""
    path = ranks_path(ranks)
    kept = encoded.drop("decoded")
    at = kept.columns.index(ids)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            out = [b"".join(codec.bytes_of(np.frombuffer(x or b"", dtype="<u4"))) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    bounded_batches(encoded.sparkSession)
    return kept.mapInArrow(join, T.StructType([*kept.schema, T.StructField("decoded", T.BinaryType())]))


def hex_digest(column: str) -> Column:
    return F.sha2(F.col(column), 256)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = decode(encode(table(spark, sf_dir, "documents")))
    return both.select("doc_id", "n_tokens", hex_digest("ids").alias("ids_sha256"), hex_digest("decoded").alias("decoded_sha256"))


QUERIES = {"op11_byte_bpe": op11_byte_bpe}
ORACLES: dict[str, str] = {}
