"""Best-fit packing of token pieces into sequences of a fixed capacity, in bulk-synchronous supersteps."""

from __future__ import annotations

import bisect
import os
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm.common import bounded_batches, lower_ascii, span_hashes, table, text_chunks, word_spans, written

CAPACITY = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"
#: Bytes of ids that a worker remembers between texts, in about a million words.
MEMORY_BYTES = 16 << 20
#: New words encoded in one call.
TOGETHER = 2000

_LETTER, _SIGN = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_SIGN[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = True

_TOKENIZERS: dict[str, WordIds] = {}


class WordIds:
    """Ids of texts, word by word.

    For tokenizers that lower-case, and join characters neither across white space nor from a letter to a sign other
    than the apostrophe: a text falls apart at the bytes 0x20 and 0x09-0x0D and behind letters, the tokenizer encodes
    every different part once, words of letters alone many together (each ends in one token that ends a word), and
    their ids are remembered by the parts' 64-bit hashes up to a bounded size. Texts that might spell a special token,
    whose letters' case counts, are taken apart at white space only.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(path)
        self.ends = np.zeros(max(self.model.get_vocab().values()) + 1, dtype=bool)
        self.ends[[i for token, i in self.model.get_vocab().items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.place: dict[int, int] = {}
        self.ids = np.zeros(0, dtype="<u4")
        self.bounds = np.zeros(1, dtype=np.int64)

    def learn(self, words: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """The words' order of learning, how many ids each has, and all ids in that order."""
        texts = [w.decode() for w in words]
        plain = [i for i, text in enumerate(texts) if text.isalpha()]
        rest = [i for i, text in enumerate(texts) if not text.isalpha()]
        order, sizes, ids = [], [], []
        for first in range(0, len(plain), TOGETHER):
            part = plain[first : first + TOGETHER]
            found = np.array(self.model.encode_batch_fast([" ".join(texts[i] for i in part)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[found]) + 1
            if len(ends) == len(part):
                order += part
                sizes.append(np.diff(ends, prepend=0))
                ids.append(found)
            else:
                rest += part
        alone = [x.ids for x in self.model.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)]
        sizes.append(np.array([len(x) for x in alone], dtype=np.int64))
        ids.append(np.array([i for x in alone for i in x], dtype="<u4"))
        return order + rest, np.concatenate(sizes), np.concatenate(ids)

    def places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the ids of each word are kept; new words are learnt first."""
        hashes, first, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if self.ids.nbytes > MEMORY_BYTES:
            self.forget()
        known = self.place.get
        at = np.array([known(key, -1) for key in hashes.tolist()], dtype=np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            order, sizes, ids = self.learn([data[a:b].tobytes() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            new = new[order]
            at[new] = len(self.bounds) - 1 + np.arange(len(new))
            self.place.update(zip(hashes[new].tolist(), at[new].tolist()))
            self.ids = np.append(self.ids, ids)
            self.bounds = np.append(self.bounds, self.bounds[-1] + np.cumsum(sizes))
        return at[which]

    def encode(self, raw: bytes, offsets: np.ndarray) -> Iterator[bytes]:
        """The little-endian 32-bit ids of each text."""
        data = np.frombuffer(raw, dtype=np.uint8)
        if b"<|" not in raw:
            data, offsets = self.parted(lower_ascii(data), offsets)
        starts, ends, row = word_spans(data, offsets)
        at = self.places(data, starts, ends) if len(starts) else starts
        sizes = self.bounds[at + 1] - self.bounds[at]
        source = np.repeat(self.bounds[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        ids = self.ids[source].tobytes()
        cuts = (4 * np.append(0, np.cumsum(np.bincount(row, weights=sizes, minlength=len(offsets) - 1))).astype(np.int64)).tolist()
        for a, b in zip(cuts, cuts[1:]):
            yield ids[a:b]

    @staticmethod
    def parted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes with a space between each lower-case ASCII letter and a sign behind it."""
        behind = np.flatnonzero(_LETTER[data[:-1]] & _SIGN[data[1:]]) + 1
        return np.insert(data, behind, 0x20), offsets + np.searchsorted(behind, offsets)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """A row per piece: key, piece, start, length, ids_crc32 and, if asked for, ids.

    A text's ids end with one END_ID; only longer texts are cut, into pieces of ``capacity`` ids, the last shorter.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if keep_ids else "")
    end = np.array([END_ID], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_path(tokenizer)
        model = _TOKENIZERS.setdefault(path, None) or WordIds(path)
        _TOKENIZERS[path] = model
        for batch in batches:
            for first, data, offsets in text_chunks(batch.column(1)):
                row, piece, start, length, crc, kept = [], [], [], [], [], []
                for i, ids in enumerate(model.encode(data.tobytes(), offsets)):
                    ids += end
                    for p, a in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[a : a + 4 * capacity]
                        row.append(first + i)
                        piece.append(p)
                        start.append(a // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if keep_ids:
                            kept.append(np.frombuffer(part, dtype="<u4").astype(np.int64))
                columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                columns += [pa.array(kept, pa.list_(pa.int64()))] * keep_ids
                yield pa.RecordBatch.from_arrays(columns, names=[key, "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(cut, schema)


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, first sequence, per sequence, offset) runs that place ``counts[length]`` pieces of each length.

    A superstep handles one length class, longest first. It sweeps the gap classes upwards from the successor of the
    length; the class's pieces take gaps in order of rank, as many to a sequence as fit (the rest of the smallest gap
    that fits is the smallest again); the gaps shrink and the next superstep starts. Pieces left over open sequences.
    Sequences with equal gaps are kept as runs of consecutive numbers: a superstep splits two runs at most and every
    use of a run more than halves its gap, so that the plan has a bounded size (below 100,000 rows for 2048 classes)
    however many pieces there are.
    """
    runs: dict[int, deque[tuple[int, int]]] = {}
    sizes: list[int] = []
    plan: list[tuple[int, int, int, int, int]] = []
    fresh = 0

    def put(gap: int, first: int, n: int) -> None:
        if n and gap:
            if gap not in runs:
                runs[gap] = deque()
                bisect.insort(sizes, gap)
            runs[gap].append((first, n))

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                first, n = runs[gap].popleft()
                if not runs[gap]:
                    del runs[gap]
                    sizes.pop(at)
            else:
                gap, first = capacity, fresh
                n = -(-left // (capacity // length))
                fresh += n
            each = gap // length
            full, rest = min(n, left // each), 0
            if full < n:
                rest = left - full * each
            plan.append((length, rank, first, each, capacity - gap))
            placed = full * each + rest
            put(gap - each * length, first, full)
            if rest:
                put(gap - rest * length, first + full, 1)
            untouched = full + (rest > 0)
            put(gap, first + untouched, n - untouched)
            left -= placed
            rank += placed
    return plan


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (a ``length`` per piece, any other columns) with ``sequence_id`` and ``offset``; sequences have no gaps inside.

    Pieces are written once with a row number. Whole sequences stand alone. The others are ranked within their length:
    counts per task and length, summed over tasks, then row numbers inside a task; no length, however common, meets in
    one task. Only the counts, one per length below the capacity, reach the driver, which runs the supersteps over
    them; the plan comes back as one row per length and each piece computes its place from its rank. Repeated rows are
    pieces of their own; an empty table gives no rows. Columns named sequence_id or offset are replaced.
    """
    spark = cut.sparkSession
    rows = written(cut.drop("sequence_id", "offset").withColumn("_row", F.monotonically_increasing_id()), "pieces")
    rows = rows.withColumn("_block", F.shiftright("_row", 33))
    whole = rows.filter(F.col("length") >= capacity).select(*rows.columns, (-F.col("_row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = rows.filter(F.col("length") < capacity)
    counted = part.groupBy("length", "_block").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    by_length: dict[int, list] = {length: [] for length in counts}
    for length, *run in best_fit_plan(counts, capacity):
        by_length[length].append(tuple(run))
    plan = spark.createDataFrame(
        [(length, run) for length, run in by_length.items()],
        "length long, runs array<struct<rank:long,first:long,each:long,offset:long>>",
    )
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = counted.withColumn("_before", F.coalesce(before, F.lit(0))).drop("n").join(F.broadcast(plan), "length")
    local = part.withColumn("_local", F.row_number().over(Window.partitionBy("length", "_block").orderBy("_row")) - 1)
    ranked = local.join(starts, ["length", "_block"]).withColumn("_rank", F.col("_before") + F.col("_local"))
    ranked = ranked.withColumn("_run", F.element_at(F.filter("runs", lambda r: r["rank"] <= F.col("_rank")), -1))
    past = F.col("_rank") - F.col("_run.rank")
    placed = ranked.select(
        *rows.columns,
        (F.col("_run.first") + F.floor(past / F.col("_run.each"))).alias("sequence_id"),
        (F.col("_run.offset") + past % F.col("_run.each") * F.col("length")).alias("offset"),
    )
    return whole.unionByName(placed).drop("_row", "_block")


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Texts cut into pieces and packed into as few sequences as best fit by falling length needs.

    A null or empty text is one piece holding END_ID alone; a very long text gives many whole pieces and a rest.
    """
    return pack(pieces(docs, key, text, tokenizer, capacity, keep_ids), capacity)


def op6_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op6_best_fit_pack": op6_best_fit_pack}
ORACLES: dict[str, str] = {}
