"""Quality rules: counts of words, symbols and repeats, and bands of the perplexity under each language's n-gram model."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import CHUNK_BYTES, bounded_batches, drop_written, mix64, span_hashes, table, text_chunks, word_spans, written

#: Code points of the model's n-grams.
ORDER = 4
#: Bytes of a code point in an n-gram, and what stands for those before a text.
WIDE, BEFORE = 3, 0xFFFFFF
#: Text bytes whose n-grams are counted at a time.
COUNTED_BYTES = 2 << 20
#: N-grams of a model that is broadcast, 12 bytes each; a larger one is joined with the texts' n-grams.
BROADCAST_NGRAMS = 4_000_000
#: Least words and largest percentage of repeated words of a text that passes the base rules.
LEAST_WORDS, REPEATED_PERCENT, REPEAT_WINDOW = 10, 20, 5
#: A text is kept within so many interquartile ranges of the quartiles of a word's log perplexity among the texts of its
#: language and length class; ranges below LEAST_RANGE count as that. The surprise of all code points is shared among the
#: words, so that signs and tables, each cheap to guess, count by how they change words and not by their length.
RANGES, LEAST_RANGE = 4.0, 0.02
#: Least words of the length classes: short texts scatter more.
LENGTH_CLASSES = (0, 20, 40, 80, 160, 320, 640, 1280)

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b"#*$%&|<>")] = True


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The code points that stand 0, 1 and more places before each code point, and the offsets of the rows among them."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype="<u4")
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    place = np.arange(len(points)) - np.repeat(at[:-1], np.diff(at))
    earlier = [points]
    for back in range(1, ORDER):
        moved = np.full(len(points), BEFORE, dtype=np.uint32)
        moved[back:] = np.where(place[back:] >= back, points[:-back], BEFORE)
        earlier.append(moved)
    return earlier, at


def language_seed(lang: str | None) -> int:
    return int.from_bytes(hashlib.blake2b(b"" if lang is None else b"=" + lang.encode(), digest_size=8).digest(), "little")


def ngram_hashes(earlier: list[np.ndarray], seeds: np.ndarray) -> np.ndarray:
    """64-bit hash of each n-gram in its language."""
    h = seeds
    for points in earlier:
        h = mix64(h ^ (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return h


def _chunks(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets, n-grams, their rows' offsets, hashes) of a batch of languages and texts."""
    seeds: dict[str | None, int] = {}
    langs = batch.column(0).to_pylist()
    own = np.array([seeds.setdefault(x, language_seed(x)) for x in langs], dtype=np.uint64)
    for first, data, offsets in text_chunks(batch.column(1), size):
        earlier, at = ngrams(data, offsets)
        yield first, data, offsets, earlier, at, ngram_hashes(earlier, np.repeat(own[first : first + len(at) - 1], np.diff(at)))


def count_ngrams(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, gram, hash, n) of all n-grams of all texts: the code points, WIDE bytes each, and how often they occur.

    Each task hands on the different n-grams of a stretch of text with their counts; Spark adds them up by language and
    n-gram, on the map side first.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, _, earlier, at, hashes in _chunks(batch, COUNTED_BYTES):
                seen, where, counts = np.unique(hashes, return_index=True, return_counts=True)
                points = np.stack([e[where] for e in reversed(earlier)], axis=1)
                raw = points.astype(">u4").view(np.uint8).reshape(-1, ORDER, 4)[:, :, 1:].tobytes()
                ends = np.arange(len(seen) + 1, dtype=np.int32) * (ORDER * WIDE)
                grams = pa.Array.from_buffers(pa.binary(), len(seen), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw)])
                row = first + np.searchsorted(at, where, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), grams, pa.array(seen.view(np.int64)), pa.array(counts)], names=["lang", "gram", "hash", "n"]
                )

    found = docs.select(F.col(lang).cast("string"), F.col(text).cast("string")).mapInArrow(counted, "lang string, gram binary, hash long, n long")
    return found.groupBy("lang", "gram", "hash").agg(F.sum("n").alias("n"))


def _level(counts: DataFrame, lower: DataFrame | None) -> DataFrame:
    """(lang, gram, p, r): modified Kneser-Ney of one order from (lang, gram, n) and the next order's (lang, suffix, q, s).

    ``p`` is the probability of the last symbol after the others, ``r`` the same with one occurrence left out: what the
    model would say if it had not counted the place that it judges. An n-gram that is then gone is left out of the next
    order as well. Without a next order every symbol of the language, and one that was never seen, is equally likely.
    Discounts come from how many n-grams of the order and language occur once to four times.
    """
    named = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("_lang")
    counts = counts.withColumn("_lang", named)
    sizes = counts.groupBy("_lang").agg(F.count("*").alias("symbols"), *[F.greatest(F.count_if(F.col("n") == k), F.lit(1)).cast("double").alias(f"n{k}") for k in range(1, 5)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    cuts = [F.least(F.greatest(k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"), F.lit(0.0)), F.lit(float(k))).alias(f"cut{k}") for k in (1, 2, 3)]
    sizes = sizes.select("_lang", "symbols", *cuts)
    took = F.when(F.col("n") == 1, F.col("cut1")).when(F.col("n") == 2, F.col("cut2")).otherwise(F.col("cut3"))
    less = F.when(F.col("n") == 1, F.lit(0.0)).when(F.col("n") == 2, F.col("cut1")).when(F.col("n") == 3, F.col("cut2")).otherwise(F.col("cut3"))
    context = F.substring("gram", F.lit(1), F.octet_length("gram") - WIDE)
    cut = counts.join(sizes, "_lang").withColumn("took", took).withColumn("less", less).withColumn("context", context)
    totals = cut.groupBy("_lang", "context").agg(F.sum("n").alias("total"), F.sum("took").alias("spread"))
    cut = cut.join(totals, ["_lang", "context"])
    if lower is None:
        backed = cut.withColumn("q", 1.0 / (F.col("symbols") + 1)).withColumn("s", F.col("q"))
    else:
        cut = cut.withColumn("suffix", F.expr(f"substring(gram, {WIDE + 1})"))
        backed = cut.join(lower.withColumn("_lang", named).drop("lang"), ["_lang", "suffix"])
    n, q = F.col("n"), F.when(F.col("n") == 1, F.col("s")).otherwise(F.col("q"))
    p = (n - F.col("took") + F.col("spread") * F.col("q")) / F.col("total")
    spread = F.col("spread") - F.col("took") + F.col("less")
    r = F.when(F.col("total") == 1, q).otherwise((n - 1 - F.col("less") + spread * q) / (F.col("total") - 1))
    return backed.select("lang", "gram", *([F.col("hash")] if "hash" in counts.columns else []), p.alias("p"), r.alias("r"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, gram, hash, p, r): the probability of each counted n-gram's last symbol after the others, in its language, and
    the same with one occurrence left out, see ``_level``.

    The highest order counts occurrences, each lower one how many different symbols precede. The model judges the texts
    that it was counted on: it has all their n-grams, and leaves out the one that it judges.
    """
    orders = [counts]
    for _ in range(ORDER - 1):
        shorter = F.expr(f"substring(gram, {WIDE + 1})").alias("gram")
        orders.append(orders[-1].select("lang", shorter).groupBy("lang", "gram").agg(F.count("*").alias("n")))
    lower = None
    for level in reversed(orders):
        lower = _level(level, lower)
        if level is not counts:
            lower = lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("q"), F.col("r").alias("s"))
    return lower


def _repeats(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """How often each (row, hash) stands in its row."""
    _, where, counts = np.unique(mix64(hashes ^ (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_inverse=True, return_counts=True)
    return counts[where]


def rule_counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    n = len(offsets) - 1
    byte_row = np.repeat(np.arange(n), np.diff(offsets))
    starts, ends, row = word_spans(data, offsets)
    words = np.bincount(row, minlength=n)
    chars = np.bincount(byte_row[((data & 0xC0) != 0x80) & ~_WHITE[data]], minlength=n)
    marks = np.bincount(byte_row[_MARK[data]], minlength=n)

    line_starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(data == 10) + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_row = np.searchsorted(offsets, line_starts, "right") - 1
    line_ends = np.minimum(np.append(line_starts[1:], len(data)), offsets[line_row + 1])
    line_ends = line_ends - (data[np.maximum(line_ends, 1) - 1] == 10 if len(data) else 0)
    full = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_row, hashes = line_row[full], span_hashes(data, line_starts[full], line_ends[full])
    keys = mix64(hashes ^ (line_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    first = np.zeros(len(keys), dtype=bool)
    first[np.unique(keys, return_index=True)[1]] = True
    lines = np.bincount(line_row[~first], minlength=n)

    word_hash = span_hashes(data, starts, ends)
    repeated = np.zeros(n, dtype=np.int64)
    size = len(row) - REPEAT_WINDOW + 1
    if size > 0:
        same = row[:size] == row[REPEAT_WINDOW - 1 :]
        window = np.zeros(size, dtype=np.uint64)
        for k in range(REPEAT_WINDOW):
            window = mix64(window * np.uint64(3) + word_hash[k : k + size])
        often = np.zeros(size, dtype=bool)
        often[same] = _repeats(row[:size][same], window[same]) > 1
        cover = np.zeros(len(row) + 1, dtype=np.int64)
        cover[:size] += often
        cover[REPEAT_WINDOW : size + REPEAT_WINDOW] -= often
        repeated = np.bincount(row[np.cumsum(cover)[:-1] > 0], minlength=n)
    return [words, chars, marks, lines, repeated]


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(rows: DataFrame, key: str, hashes: np.ndarray, logs: np.ndarray) -> DataFrame:
    """(key, lang, the rule counts, log_perplexity) by a model in sorted hash arrays: the negative log probability of a
    text, a word, 0 for a text without words. ``rows`` has lang, _text and the key."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets, _, at, found in _chunks(batch, CHUNK_BYTES):
                sums = np.concatenate([[0.0], np.cumsum(logs[np.searchsorted(hashes, found)], dtype=np.float64)])
                counts = rule_counts(data, offsets)
                words, n = counts[0], len(offsets) - 1
                surprise = np.where(words > 0, (sums[at[:-1]] - sums[at[1:]]) / np.maximum(words, 1), 0.0)
                columns = [*(pa.array(c.astype(np.int64)) for c in counts), pa.array(surprise)]
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(first, n), batch.column(0).slice(first, n), *columns], names=[key, "lang", *_COUNTS, "log_perplexity"])

    kind = rows.select(key).schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, lang string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", log_perplexity double"
    return rows.select("lang", "_text", key).mapInArrow(measure, schema)


def measured_by_join(rows: DataFrame, key: str, model: DataFrame) -> DataFrame:
    """The same by a model of any size, (hash, log): texts hand on their different n-grams with counts, which meet the
    model in an equi-join; sums per text are added up. Texts are numbered in a table of their own."""
    kept = written(rows.select("lang", "_text", key).withColumn("_row", F.monotonically_increasing_id()), "numbered")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, _, _, at, found in _chunks(batch, CHUNK_BYTES):
                own = np.repeat(np.arange(len(at) - 1), np.diff(at))
                order = np.lexsort((found, own))
                own, found = own[order], found[order]
                heads = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (found[1:] != found[:-1]))) if len(own) else np.zeros(0, np.int64)
                counts = np.diff(np.append(heads, len(own)))
                ids = batch.column(2).take(pa.array(own[heads] + first))
                yield pa.RecordBatch.from_arrays([ids, pa.array(found[heads].view(np.int64)), pa.array(counts)], names=["_row", "hash", "n"])

    grams = kept.select("lang", "_text", "_row").mapInArrow(spread, "_row long, hash long, n long")
    sums = grams.join(model, "hash").groupBy("_row").agg((-F.sum(F.col("n") * F.col("log"))).alias("_sum"))
    nothing = np.zeros(1, dtype=np.uint64), np.zeros(2)
    counted = measured(kept.select("lang", "_text", F.struct("_row", F.col(key).alias("_key")).alias("_id")), "_id", *nothing).drop("log_perplexity")
    joined = counted.withColumn("_row", F.col("_id._row")).join(sums, "_row", "left")
    surprise = F.when(F.col("n_words") > 0, F.col("_sum") / F.col("n_words")).otherwise(0.0)
    return joined.select(F.col("_id._key").alias(key), "lang", *_COUNTS, surprise.alias("log_perplexity"))


def apply_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, lang, the rule counts, base_failed, log_perplexity, kept) of every row.

    Two passes over all texts: one counts the n-grams of each language, one measures each text with its language's
    model. The model has an entry for every n-gram of the corpus, in a table sorted by hash; up to BROADCAST_NGRAMS, by
    count, it is broadcast as arrays, beyond that it is joined. The measures are kept as a table, whose quartiles by
    language and length class give the bands. Null and empty texts have no words and fail the base rules; rows without a
    language are a language of their own; repeated rows have equal results; very long texts are measured whole; an empty
    table gives no rows. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias(key), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("_text"))
    counts = written(count_ngrams(rows, "lang", "_text"), "ngrams")
    model = kneser_ney(counts).groupBy("hash").agg(F.max(F.log(F.greatest("r", F.lit(1e-12)))).alias("log"))
    model = written(model.repartitionByRange("hash").sortWithinPartitions("hash"), "model")
    drop_written(counts)
    if model.count() <= BROADCAST_NGRAMS:
        arrays = model.toArrow()
        hashes = arrays["hash"].to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        logs = np.append(arrays["log"].to_numpy()[order], 0.0).astype(np.float32)
        found = measured(rows, key, hashes[order], logs)
    else:
        found = measured_by_join(rows, key, model)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    length_class = sum((F.col("n_words") >= n).cast("int") for n in LENGTH_CLASSES)
    found = written(found.withColumn("base_failed", failed).withColumn("_class", length_class), "measures")
    quartiles = F.percentile_approx("log_perplexity", [0.25, 0.75], 10_000)
    bands = found.filter("not base_failed").groupBy(F.col("lang").alias("_lang"), F.col("_class").alias("_of")).agg(quartiles.alias("_q"))
    reach = RANGES * F.greatest(F.col("_q")[1] - F.col("_q")[0], F.lit(LEAST_RANGE))
    bands = bands.select("_lang", "_of", (F.col("_q")[0] - reach).alias("lower"), (F.col("_q")[1] + reach).alias("upper"))
    judged = found.join(bands, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("_class") == F.col("_of")), "left")
    kept = ~F.col("base_failed") & F.col("log_perplexity").between(F.col("lower"), F.col("upper"))
    return judged.select(key, "lang", *_COUNTS, "base_failed", "log_perplexity", "lower", "upper", F.coalesce(kept, F.lit(False)).alias("kept"))


def op8_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents")).select("doc_id", *_COUNTS, "base_failed", "kept")


QUERIES = {"op8_perplexity": op8_perplexity}
ORACLES: dict[str, str] = {}
