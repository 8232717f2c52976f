"""Toxicity by compression distance: which of two zstandard dictionaries makes a text's windows shorter."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import bounded_batches, drop_written, fold_of, table, text_chunks, written
from tablewright.llm.quality import sampled_labels

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: Labelled rows learnt from (the smallest id hashes of each label), and words kept that mark toxic rows.
SAMPLE_ROWS = 6000
MARKING_WORDS = 3000
#: A marking word stands in so many toxic rows at least, and in so many times the share of ordinary ones.
LEAST_ROWS, LEAST_RATIO = 3, 6.0
#: Training windows kept of each label (the smallest hashes) and ordinary windows taken from a text.
SAMPLE_WINDOWS, WINDOWS_A_TEXT = 40_000, 12
#: Bytes of the longest window and of each dictionary, and the level that compresses.
WINDOW, DICTIONARY_BYTES, LEVEL = 40, 8 << 10, 15
#: Stands before every window and at the end of both dictionaries, so that no window is too short to be compressed.
CARRIER = b"a text of words and a window of a text of words: "
#: A window is near toxic text from these relative distances on, if it saves so many bytes.
NEAR, CLEAR_BYTES = (0.5, 0.6), 3
MEASURES = 2 + len(NEAR)
#: Different windows whose distance a worker remembers, in bytes.
MEMORY_BYTES = 16 << 20

_SIGNS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def windows(text: bytes) -> list[bytes]:
    """The text in windows, whole: its lower-cased words without ASCII signs, of long words every WINDOW bytes."""
    words = text.lower().translate(_SIGNS).split()
    if text and len(max(words, key=len, default=b"")) > WINDOW:
        words = [w[a : a + WINDOW] for w in words for a in range(0, len(w), WINDOW)]
    return words


def content_of(samples: list[bytes], size: int) -> bytes:
    """The content of a zstandard dictionary trained on the samples; of few samples, their ends."""
    try:
        return zstandard.train_dictionary(size, samples, k=32, d=6, steps=4).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-size:]


@dataclass
class CompressionModel:
    """Both dictionaries' contents, and the calibrated weights of the measures."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray


class Distances:
    """Compression distance of windows: (ordinary - toxic) / (ordinary + toxic), of the bytes each adds to the carrier."""

    def __init__(self, model: CompressionModel):
        self.model, self.known, self.bytes, self.compress, self.carrier = model, {}, 0, [], []
        for content in (model.ordinary, model.toxic):
            words = zstandard.ZstdCompressionDict(content + CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=LEVEL)
            one = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False)
            self.compress.append(one.compress)
            self.carrier.append(len(one.compress(CARRIER)))

    def learn(self, words: set[bytes]) -> None:
        if self.bytes > MEMORY_BYTES:
            self.known, self.bytes = {}, 0
        (ordinary, toxic), (less, least) = self.compress, self.carrier
        for word in words.difference(self.known):
            text = CARRIER + b" " + word + b" "
            a, b = len(ordinary(text)) - less, len(toxic(text)) - least
            self.known[word] = (a - b) / max(a + b, 1) if a - b >= CLEAR_BYTES else 0.0
            self.bytes += len(word)

    def measures(self, text: bytes) -> np.ndarray:
        """Largest distance, how many windows are near toxic text by each limit, and the share of the nearest kind."""
        words = windows(text)
        found = np.zeros(MEASURES)
        if words:
            self.learn(set(words))
            distances = np.fromiter(map(self.known.__getitem__, words), dtype=np.float64, count=len(words))
            near = [int((distances >= limit).sum()) for limit in NEAR]
            found[:] = [distances.max(), *np.log1p(near), 10 * min(0.1, near[-1] / len(words))]
        return found


def scores(weights: np.ndarray, measures: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(weights[0] + measures @ weights[1:], -30, 30)))


def calibrated(measures: np.ndarray, labels: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Weights of a logistic curve through the measures, by Newton's steps with a small ridge."""
    x = np.hstack([np.ones((len(measures), 1)), measures])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [0.05] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - labels) + ridge @ w
        w -= np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge, slope)
    return w


def marking_words(chosen: DataFrame) -> list[str]:
    """Words of the labelled sample that mark toxic rows, counted by Spark; the MARKING_WORDS commonest."""
    plain = F.regexp_replace(F.lower("_text"), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " ")
    words = chosen.select("_label", F.explode(F.array_distinct(F.split(plain, " "))).alias("word")).filter("length(word) > 2")
    counts = words.groupBy("word").agg(F.sum("_label").alias("toxic"), F.sum(1 - F.col("_label")).alias("ordinary"))
    sizes = {r["_label"]: r["count"] for r in chosen.groupBy("_label").count().collect()}
    share = F.col("toxic") / max(1, sizes.get(1, 0))
    other = (F.col("ordinary") + 0.5) / max(1, sizes.get(0, 0))
    marking = counts.filter((F.col("toxic") >= LEAST_ROWS) & (share >= LEAST_RATIO * other))
    return [r["word"] for r in marking.orderBy(F.desc("toxic"), "word").limit(MARKING_WORDS).collect()]


def train(docs: DataFrame, labels: DataFrame, fold: Column, key: str = "doc_id", text: str = "text") -> CompressionModel:
    """Fit on at most SAMPLE_ROWS labelled rows of each label, broadcast by id.

    The toxic dictionary is trained on the windows of toxic rows that mark them, the ordinary one on windows of
    ordinary rows. The rows that trained neither calibrate the measures.
    """
    sample = sampled_labels(labels.filter("toxic = 1"), "toxic", fold, key, SAMPLE_ROWS).union(sampled_labels(labels.filter("toxic = 0"), "toxic", fold, key, SAMPLE_ROWS))
    chosen = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).join(F.broadcast(sample), "_key")
    chosen = written(chosen, "labelled")
    learning = F.pmod(F.xxhash64("_key", F.lit("part")), F.lit(2)) == 0
    marking = frozenset(w.encode() for w in marking_words(chosen.filter(learning)))

    def excerpts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, part = [], []
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = sorted(set(windows(t.encode())))
                if y:
                    words = [w for w in words if w in marking]
                else:
                    words.sort(key=xxhash.xxh64_intdigest)
                    words = words[:WINDOWS_A_TEXT]
                label += [y] * len(words)
                part += words
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(part, pa.binary())], names=["_label", "part"])

    kept = chosen.filter(learning).select("_label", "_text").mapInArrow(excerpts, "_label int, part binary")
    kept = kept.withColumn("_rank", F.xxhash64("part", F.monotonically_increasing_id()))
    parts = {y: [b" " + bytes(r["part"]) + b" " for r in kept.filter(F.col("_label") == y).orderBy("_rank").limit(SAMPLE_WINDOWS).collect()] for y in (0, 1)}
    model = CompressionModel(content_of(parts[0], DICTIONARY_BYTES), content_of(parts[1], DICTIONARY_BYTES), np.zeros(1 + MEASURES))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(model)
        for batch in batches:
            found = [distances.measures(t.encode()).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["_label", "measures"])

    rest = chosen.filter(~learning).select("_label", "_text").mapInArrow(measured, "_label int, measures array<double>")
    # more than the sample only where ids repeat; then a part that does not depend on the measures' size
    rows = rest.orderBy(F.xxhash64("measures", "_label"), "measures", "_label").limit(2 * SAMPLE_ROWS).collect()
    if rows:
        marks = np.array([r["_label"] for r in rows], dtype=np.float64)
        model.weights = calibrated(np.array([r["measures"] for r in rows]), marks)
        shown = {y: int((marks == y).sum()) for y in (0, 1)}
        known = {r["_label"]: r["n"] for r in labels.filter(fold & F.col("toxic").isin(0, 1)).groupBy(F.col("toxic").cast("int").alias("_label")).agg(F.count("*").alias("n")).collect()}
        if all(shown.values()) and len(known) == 2:  # the sample may hold another share of toxic rows than the labels
            model.weights[0] += np.log(known[1] / known[0]) - np.log(shown[1] / shown[0])
    drop_written(chosen)
    return model


_DISTANCES: dict[str, Distances] = {}


def toxicity_score(model: CompressionModel, text: Column) -> Column:
    """The probability that a text is toxic; a null text scores like an empty one."""
    name = uuid.uuid4().hex

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        distances = _DISTANCES.get(name)
        if distances is None:
            _DISTANCES.clear()
            distances = _DISTANCES[name] = Distances(model)
        found = []
        for _, data, offsets in text_chunks(texts):
            raw, at = data.tobytes(), offsets.tolist()
            found += [distances.measures(raw[a:b]) for a, b in zip(at, at[1:])]
        return pa.array(scores(model.weights, np.array(found).reshape(-1, MEASURES)), pa.float64())

    return score(text.cast("string"))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``; columns of these names are replaced.

    Labels of the held-out fold are never read. Every window of every text is compressed under both dictionaries, in
    one pass without a shuffle; null and empty texts have no window, repeated rows score alike, very long texts
    have more windows. Without labels all scores are one half; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    fold = fold_of(F.col(key), FOLDS)
    model = train(docs, labels, ~fold.eqNullSafe(HELD_OUT), key, text)
    scored = docs.drop("held_out", "score", "predicted").withColumn("score", toxicity_score(model, F.col(text)))
    return scored.withColumn("held_out", fold == HELD_OUT).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}
