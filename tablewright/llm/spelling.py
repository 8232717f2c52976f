"""Spelling variants: words one code point apart, found in suffix-rank indexes, and the form that each variant belongs to."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import CHUNK_BYTES, bounded_batches, drop_written, table, written
from tablewright.llm.fm_index import WordIndex, code_points

LEAST_CHARS, LEAST_COUNT, MISSPELT, RATIO = 7, 2, 31, 10
#: Different words that a task counts before it hands them on, and their code points.
COUNTED, COUNTED_CHARS = 200_000, 8 << 20
#: Words of an index. A half that more words share is cut into tiles of so many words and so many queries.
INDEXED = 1 << 16
#: Rows of halves with tiles that are broadcast; more are joined by shuffling.
BROADCAST_ROWS = 100_000

_RUN = re.compile("[a-zÀ-ÿ]+")
_BREAK = re.compile(rb"[\x00-@\[-`{-\x7f]")


def _slices(raw: bytes, size: int = CHUNK_BYTES) -> Iterator[bytes]:
    """``raw`` in slices of about ``size`` bytes, cut at ASCII characters that no word holds."""
    start = 0
    while start < len(raw):
        cut = _BREAK.search(raw, start + size)
        end = cut.end() if cut else len(raw)
        yield raw[start:end]
        start = end


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", misspelt: int = MISSPELT, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): how often each word of at least ``least_chars`` code points stands in all texts, if ``least_count`` times.

    Words are runs of Latin letters, A-Z lower-cased. Where ``misspelt`` divides the crc32 of ``key:word``, one code point
    is left out at a place that the crc32 draws, which makes variants whose origin is known; 0 leaves words as they are.
    A null text has no words, a null key is the text ''. Each task adds words up before they are shuffled, so that
    a word that is a third of all words is one row a task and hand-over. Very long texts are counted slice by slice.
    """
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        chars = 0

        def counted() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for own, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seed = zlib.crc32(f"{'' if own is None else own}:".encode())
                for part in _slices((raw or b"").lower()):
                    for word, n in Counter(_RUN.findall(part.decode())).items():
                        if misspelt:
                            drawn = zlib.crc32(word.encode(), seed)
                            if drawn % misspelt == 0:
                                at = drawn % len(word)
                                word = word[:at] + word[at + 1 :]
                        if len(word) >= least_chars:
                            if word not in seen:
                                chars += len(word)
                            seen[word] += n
                    if len(seen) > COUNTED or chars > COUNTED_CHARS:
                        yield counted()
                        chars = 0
        yield counted()

    found = docs.select(F.col(key), F.col(text).cast("string").cast("binary")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _halves(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(side, half, word, n) of indexed words and of queries.

    A word one error away from a query shares its first half (side 0) or its second half (side 1), counted in the query's
    code points. Queries of three lengths can look for a word, whose halves have two lengths between them.
    """
    size = F.length("word")
    half = F.floor(size / 2).cast("int")
    first = lambda n: F.substring(F.col("word"), F.lit(1), n)
    last = lambda n: F.substring(F.col("word"), size - n + 1, n)
    upper = F.floor((size + 1) / 2).cast("int")

    def rows(*pairs):
        kinds = F.array(*[F.struct(F.lit(side).alias("side"), piece.alias("half")) for side, piece in pairs])
        return words.select("word", "n", F.explode(kinds).alias("k")).select("k.side", "k.half", "word", "n")

    lower = F.floor((size - 1) / 2).cast("int")
    indexed = rows((0, first(lower)), (0, first(upper)), (1, last(half)), (1, last(F.least(half + 1, size))))
    return indexed, rows((0, first(half)), (1, last(upper)))


def _tiles(indexed: DataFrame, queries: DataFrame, words: int) -> DataFrame:
    """Rows of both kinds with the group (side, shard, heavy, i, j) in which they meet.

    Halves are dealt by hash to shards of about ``INDEXED`` words. A half that more words share gets tiles of its own:
    part i of its words meets part j of its queries in tile (i, j), so that every pair of parts meets once.
    """
    counts = indexed.groupBy("side", "half").agg(F.count("*").alias("rows")).filter(F.col("rows") > INDEXED)
    heavy = written(counts.select("side", "half", F.ceil(F.col("rows") / INDEXED).cast("int").alias("parts")), "heavy")
    most = heavy.count()
    shards = max(1, -(-2 * words // INDEXED))
    both = indexed.withColumn("query", F.lit(False)).unionByName(queries.withColumn("query", F.lit(True)))
    if most:
        both = both.join(F.broadcast(heavy) if most <= BROADCAST_ROWS else heavy, ["side", "half"], "left")
    else:
        both = both.withColumn("parts", F.lit(None).cast("int"))
        drop_written(heavy)
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
    dealt = both.select("side", "half", "word", "n", "query", "parts", own.alias("own"), F.explode(every).alias("other"))
    tiled = F.col("parts").isNotNull()
    return dealt.select(
        "side",
        F.when(~tiled, F.pmod(F.xxhash64("side", "half"), F.lit(shards)).cast("int")).alias("shard"),
        F.when(tiled, F.col("half")).alias("heavy"),
        F.when(tiled, F.when(F.col("query"), F.col("other")).otherwise(F.col("own"))).alias("i"),
        F.when(tiled, F.when(F.col("query"), F.col("own")).otherwise(F.col("other"))).alias("j"),
        "word",
        "n",
        "query",
    )


def _search(group: pa.Table) -> pa.Table:
    """(word, n_near, near_n, near): for the queries of a group, how many of its words are near and the most frequent one."""
    rightward = group.column("side")[0].as_py() == 0
    is_query = group.column("query").to_numpy(zero_copy_only=False)
    counts = group.column("n").to_numpy()
    names = group.column("word").to_pylist()
    indexed = sorted({names[i]: counts[i] for i in np.flatnonzero(~is_query)}.items())
    asked = sorted({names[i] for i in np.flatnonzero(is_query)})
    empty = pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "near_n": pa.array([], pa.int64()), "near": pa.array([], pa.string())})
    if not indexed or not asked:
        return empty
    words, n = [w for w, _ in indexed], np.array([x for _, x in indexed], dtype=np.int64)
    index = WordIndex(words, leftward=not rightward)
    codes, at = code_points([w[::-1] for w in asked] if rightward else asked)
    size = np.diff(at)
    exact = size // 2 if rightward else (size + 1) // 2
    query, word = index.one_error(codes, at, exact)
    if not rightward:  # those that share the first half as well are found from that side
        own, start = code_points(words)
        same = (size[query] // 2).copy()
        fits = np.diff(start)[word] >= same
        open_, step = np.flatnonzero(fits), 0
        shared = np.zeros(len(query), dtype=bool)
        while len(open_):
            done = same[open_] <= step
            shared[open_[done]] = True
            open_ = open_[~done]
            open_ = open_[codes[at[query[open_]] + step] == own[start[word[open_]] + step]]
            step += 1
        query, word = query[~shared], word[~shared]
    if not len(query):
        return empty
    best = np.lexsort((word, -n[word], query))
    heads = np.flatnonzero(np.diff(query[best], prepend=-1))
    near = np.diff(np.append(heads, len(query)))
    best = best[heads]
    return pa.table(
        {
            "word": pa.array([asked[i] for i in query[best]], pa.string()),
            "n_near": pa.array(near, pa.int64()),
            "near_n": pa.array(n[word[best]], pa.int64()),
            "near": pa.array([words[i] for i in word[best]], pa.string()),
        }
    )


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near): for each word with words one code point away, their number and the one of largest n,
    of several the first in code-point order. ``words`` (word, n) holds different words that are not null or empty.

    Words and queries meet by an exact half. A task builds an index of suffix ranks over a bounded number of words and
    extends the queries' intervals from the half across the rest, allowing one error; it hands on one row per query.
    """
    indexed, queries = _halves(words)
    tiles = _tiles(indexed, queries, words.count())
    found = tiles.groupBy("side", "shard", "heavy", "i", "j").applyInArrow(_search, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.minus")).alias("near_n"), "best.near")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last word that following forms leads to. Every round doubles the steps taken;
    n grows by the ratio with each step, so that chains are short. Each round is a table in the shared folder."""
    current = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(current.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop_written(current)
        current = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return current
        current._scratch_path = after._scratch_path


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of ``words`` (word, n).

    A word's form is its near word of largest n (ties: the smallest in code-point order), where that n is at least
    ``ratio`` times its own; else null. Its root is where following forms ends, without a form the word itself. Words that
    are null or empty are left out, n of repeated words is added up, an empty table gives no rows.
    """
    given = words.filter(F.length("word") > 0).groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    known = written(given, "words")
    joined = known.join(near_words(known), "word", "left")
    far = F.col("near_n") >= ratio * F.col("n")
    formed = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(far, F.col("near")).alias("form"), F.when(far, F.col("near_n")).alias("form_n"))
    formed = written(formed, "forms")
    drop_written(known)
    roots = _roots(formed.filter(F.col("form").isNotNull()))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(count_words(table(spark, sf_dir, "documents")))


def _crc_table() -> list[int]:
    """The reflected CRC-32 of every byte."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        out.append(byte)
    return out


_BYTES = r"list_transform(range(1, octet_length(encode(k)) + 1), lambda i: ('0x' || hex(encode(k))[2 * i - 1:2 * i])::BIGINT)"

ORACLE = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
lowered AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM runs GROUP BY 1, 2),
keyed AS (SELECT w, n, coalesce(doc_id::VARCHAR, '') || ':' || w AS k FROM lowered),
hashed AS (
  SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}),
           lambda c, b: xor(c >> 8, ({_crc_table()}::BIGINT[])[(xor(c, b) & 255) + 1]))) AS h FROM keyed),
spelt AS (
  SELECT CASE WHEN h % {MISSPELT} = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
gaps AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM places),
marks AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS rest FROM places),
near AS (
  SELECT g.word AS a, w.word AS b, g.n AS an, w.n AS bn FROM gaps g JOIN words w ON g.rest = w.word
  UNION SELECT w.word, g.word, w.n, g.n FROM gaps g JOIN words w ON g.rest = w.word
  UNION SELECT x.word, y.word, x.n, y.n FROM marks x JOIN marks y ON x.rest = y.rest AND x.word <> y.word),
best AS (SELECT a, count(*) AS n_near, max(bn) AS bn FROM near GROUP BY a),
first AS (SELECT near.a, min(near.b) AS b FROM near JOIN best ON near.a = best.a AND near.bn = best.bn GROUP BY near.a),
formed AS (
  SELECT w.word, w.n, coalesce(best.n_near, 0) AS n_near, CASE WHEN best.bn >= {RATIO} * w.n THEN first.b END AS form,
         CASE WHEN best.bn >= {RATIO} * w.n THEN best.bn END AS form_n
  FROM words w LEFT JOIN best ON w.word = best.a LEFT JOIN first ON w.word = first.a),
chain AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT chain.word, formed.form FROM chain JOIN formed ON chain.at = formed.word WHERE formed.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near::BIGINT AS n_near, f.form_n
FROM formed f JOIN chain c ON c.word = f.word JOIN formed l ON l.word = c.at AND l.form IS NULL
"""

QUERIES = {"op13_spelling": op13_spelling}
ORACLES = {"op13_spelling": ORACLE}
