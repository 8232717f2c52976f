"""Fill-in-middle transformation: two cut offsets of each text come from a container set of its token boundaries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import bounded_batches, table, text_chunks, word_spans

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 42, 50, 80
#: Boundaries that share their upper bits form a container.
LOW_BITS = 16
#: Members from which a bitmap is smaller than an array of 16-bit members.
ARRAY_MOST = 4096


class ArrayContainer:
    """Members as a sorted array."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class RunContainer:
    """Members as runs of consecutive numbers, with the cardinality before each run."""

    def __init__(self, low: np.ndarray, heads: np.ndarray):
        self.first = low[heads].astype(np.uint16)
        self.before = heads.astype(np.uint32)

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.first[run]) + k - int(self.before[run])


class BitmapContainer:
    """Members as bits, with the cardinality up to the end of each 64-bit word."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(1 << LOW_BITS, dtype=bool)
        bits[low] = True
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.upto = np.cumsum(np.bitwise_count(self.words), dtype=np.uint32)

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.upto, k, "right"))
        left = k - (int(self.upto[word - 1]) if word else 0)
        bits = int(self.words[word])
        for _ in range(left):
            bits &= bits - 1
        return 64 * word + (bits & -bits).bit_length() - 1


class BoundarySet:
    """A sorted set of offsets in containers; ``select`` finds a member by its rank without walking the others.

    A container is a list of runs, an array or a bitmap, whichever is smallest. The cumulative cardinalities tell which
    container holds a rank; the container selects the rest.
    """

    def __init__(self, offsets: np.ndarray):
        upper = offsets >> LOW_BITS
        edges = np.append(np.flatnonzero(np.diff(upper, prepend=-1)), len(offsets)) if len(offsets) else np.zeros(1, np.int64)
        self.base = [int(x) << LOW_BITS for x in upper[edges[:-1]]]
        self.upto = edges[1:]
        self.containers = [self._container(offsets[a:b] & ((1 << LOW_BITS) - 1)) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]

    @staticmethod
    def _container(low: np.ndarray) -> ArrayContainer | RunContainer | BitmapContainer:
        heads = np.flatnonzero(np.diff(low, prepend=-2) != 1)
        if 2 * len(heads) < min(len(low), ARRAY_MOST):
            return RunContainer(low, heads)
        return ArrayContainer(low) if len(low) <= ARRAY_MOST else BitmapContainer(low)

    def __len__(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def select(self, k: int) -> int:
        """The member with ``k`` smaller ones."""
        at = int(np.searchsorted(self.upto, k, "right"))
        return self.base[at] + self.containers[at].select(k - (int(self.upto[at - 1]) if at else 0))


def boundaries(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each text, the byte offsets where its tokens end: behind each word, and behind white space that ends a text."""
    _, ends, row = word_spans(data, offsets)
    cuts = np.searchsorted(row, np.arange(len(offsets)))
    out = []
    for i, (start, end) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
        own = ends[cuts[i] : cuts[i + 1]] - start
        out.append(np.append(own, end - start) if end > start and (not len(own) or own[-1] < end - start) else own)
    return out


def draws(key: object, seed: int) -> tuple[int, ...]:
    """Four unsigned 32-bit numbers of a row's key; a null key draws like the text ''."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def _characters(raw: bytes) -> int:
    return len(raw.decode())


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """key, n, form, prefix_chars, middle_chars, output: each text rearranged for training to fill its middle.

    A text falls into ``n`` tokens, words with the white space before them. The hash of seed and key draws two of the
    n + 1 boundaries and the form: plain (the text itself) for all but ``rate`` of 100, else spm for ``spm_rate`` of 100
    or psm. Texts that are empty (null is empty) or hold a mark stay plain. Cut offsets are found by rank in a
    ``BoundarySet``, whose size is at most two bytes a token, so that a very long text needs little more than itself.
    Rows are independent: nothing is shuffled, repeated rows give repeated rows, an empty table none, columns other than
    key and text are left out.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()
    names = [key, "n", "form", "prefix_chars", "middle_chars", "output"]
    p, s, m = (mark.encode() for mark in (PREFIX, SUFFIX, MIDDLE))

    def arrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_chunks(batch.column(1)):
                raw, at = data.tobytes(), offsets.tolist()
                keys = batch.column(0).slice(first, len(at) - 1)
                rows: list[tuple] = []
                for i, (own, ends) in enumerate(zip(keys.to_pylist(), boundaries(data, offsets))):
                    body, n = raw[at[i] : at[i + 1]], len(ends)
                    h1, h2, h3, h4 = draws(own, seed)
                    if not body or h3 % 100 >= rate or p in body or s in body or m in body:
                        rows.append((n, "plain", None, None, body))
                        continue
                    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                    members = BoundarySet(ends)
                    a, b = (members.select(rank - 1) if rank else 0 for rank in (low, high))
                    if h4 % 100 < spm_rate:
                        form, output = "spm", b"".join((s, body[b:], p, body[:a], m, body[a:b]))
                    else:
                        form, output = "psm", b"".join((p, body[:a], s, body[b:], m, body[a:b]))
                    rows.append((n, form, _characters(body[:a]), _characters(body[a:b]), output))
                columns = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([keys, *columns[:-1], columns[-1].cast(pa.string())], names=names)

    schema = f"`{key}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(arrange, schema)


def restored(form: Column, output: Column) -> Column:
    """The text that ``output`` was made from. Each mark stands once in a rearranged text, so the pieces lie between them."""
    past = lambda mark: F.substring_index(output, mark, -1)
    middle = past(MIDDLE)
    psm = F.concat(F.substring_index(past(PREFIX), SUFFIX, 1), middle, F.substring_index(past(SUFFIX), MIDDLE, 1))
    spm = F.concat(F.substring_index(past(PREFIX), MIDDLE, 1), middle, F.substring_index(past(SUFFIX), PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    back = restored(F.col("form"), F.col("output"))
    digests = [F.sha2(c.cast("binary"), 256).alias(name) for c, name in ((F.col("output"), "output_sha256"), (back, "restored_sha256"))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


ORACLE = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
tokens AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
         ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM texts),
cuts AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
         greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain'
              WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM tokens),
parts AS (
  SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid,
         array_to_string(units[b + 1:n], '') AS suf FROM cuts)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid
                        ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""

QUERIES = {"op12_fill_in_middle": op12_fill_in_middle}
ORACLES = {"op12_fill_in_middle": ORACLE}
