"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import bounded_batches, fold_of, span_hashes, table, text_chunks, word_spans

#: Buckets of hashed words, rank of the interactions, labelled rows learnt from (the smallest id hashes), passes.
WORD_BUCKETS = 1 << 14
FACTORS = 8
SAMPLE_ROWS = 8000
EPOCHS = 12
FOLDS = 5
THRESHOLD = 0.3

#: Statistics of a text and the cuts between their bins; each bin is a feature, and so is the value itself.
STATISTICS = (
    "upper", "digit", "white", "symbol", "mark", "high", "line_break", "word_size", "different_words",
    "same_as_before", "top_word", "repeated_lines", "log_bytes", "log_words", "n_chars",
)
CUTS = np.array([0.002, 0.01, 0.03, 0.06, 0.1, 0.15, 0.22, 0.3, 0.4, 0.5, 0.65, 0.8, 0.95])
BINS = len(CUTS) + 1
SIZE = WORD_BUCKETS + len(STATISTICS) * (1 + BINS)

_KIND = np.zeros(256, dtype=np.int64)  # 0: any other byte
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[0x20, *range(0x09, 0x0E)]] = 3
_KIND[list(b"#*$%&|<>")] = 4
_KIND[list(b".,;:!?")] = 5
_KIND[128:] = 6
_KINDS = 7


@dataclass
class Entries:
    """Sparse features, sorted by row."""

    row: np.ndarray
    at: np.ndarray
    value: np.ndarray


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _unique_pairs(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, 40 hash bits, count) of the different pairs, by row; rows are fewer than 2**24."""
    keys, counts = np.unique((row.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)), return_counts=True)
    return (keys >> np.uint64(40)).astype(np.int64), keys & np.uint64((1 << 40) - 1), counts


def features(data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> Entries:
    """Features of all texts of a chunk: normalised word counts by bucket, then every statistic and its bin."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    kinds = np.bincount(np.repeat(np.arange(n), sizes) * _KINDS + _KIND[data], minlength=n * _KINDS).reshape(n, _KINDS)
    starts, ends, row = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends)
    words = np.bincount(row, minlength=n)
    pair_row, pair_hash, count = _unique_pairs(row, hashes)
    top = np.zeros(n)
    np.maximum.at(top, pair_row, count)
    again = np.bincount(row[1:][(hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])], minlength=n)

    breaks = np.flatnonzero(data == 10)
    line_starts = np.union1d(offsets[:-1][sizes > 0], breaks + 1)
    line_starts = line_starts[line_starts < len(data)]
    line_row = np.searchsorted(offsets, line_starts, "right") - 1
    line_ends = np.minimum(np.append(line_starts[1:], len(data)), offsets[line_row + 1])
    lines = np.bincount(line_row, minlength=n)
    different = np.bincount(_unique_pairs(line_row, span_hashes(data, line_starts, line_ends))[0], minlength=n)

    statistics = np.stack(
        [
            *(_share(kinds[:, k], sizes) for k in range(1, _KINDS)),
            _share(np.bincount(np.searchsorted(offsets, breaks, "right") - 1, minlength=n) * 20.0, sizes),
            _share(np.bincount(row, weights=ends - starts, minlength=n) / 20.0, words),
            _share(np.bincount(pair_row, minlength=n), words),
            _share(again, words),
            _share(top, words),
            _share(lines - different, lines),
            np.log1p(sizes) / 14,
            np.log1p(words) / 12,
            np.log1p(np.maximum(n_chars, 0)) / 14,
        ],
        axis=1,
    )
    statistics = np.clip(statistics, 0, 1.5)
    base = WORD_BUCKETS + np.arange(len(STATISTICS)) * (1 + BINS)
    stat_row = np.repeat(np.arange(n), len(STATISTICS))
    bins = base + 1 + np.searchsorted(CUTS, statistics)

    weight = np.log1p(count)
    norm = np.sqrt(np.bincount(pair_row, weights=weight**2, minlength=n))
    at = np.concatenate([(pair_hash & np.uint64(WORD_BUCKETS - 1)).astype(np.int64), np.broadcast_to(base, statistics.shape).ravel(), bins.ravel()])
    value = np.concatenate([weight / norm[pair_row], statistics.ravel(), np.full(bins.size, 0.5)])
    rows = np.concatenate([pair_row, stat_row, stat_row])
    order = np.argsort(rows, kind="stable")
    return Entries(rows[order], at[order], value[order])


@dataclass
class FactorisationMachine:
    """score = sigmoid(bias + linear + pairwise), all pairs in linear time: half of (sum of vx) squared minus sum of (vx) squared."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, x: Entries, n: int) -> np.ndarray:
        scaled = self.factors[x.at] * x.value[:, None]
        sums, squares = np.zeros((n, FACTORS)), np.zeros((n, FACTORS))
        if len(x.row):
            heads = np.flatnonzero(np.append(True, x.row[1:] != x.row[:-1]))
            sums[x.row[heads]] = np.add.reduceat(scaled, heads, axis=0)
            squares[x.row[heads]] = np.add.reduceat(scaled**2, heads, axis=0)
        line = np.bincount(x.row, weights=self.linear[x.at] * x.value, minlength=n)
        return self.bias + line + 0.5 * (sums**2 - squares).sum(axis=1)

    def scores(self, x: Entries, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x, n), -30, 30)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 1) -> FactorisationMachine:
    """Adaptive gradient descent on the logistic loss over (label, feature indices, values)."""
    draw = np.random.default_rng(seed)
    model = FactorisationMachine(0.0, np.zeros(SIZE), draw.normal(0, 0.02, (SIZE, FACTORS)))
    if not rows:
        return FactorisationMachine(0.0, np.zeros(SIZE), np.zeros((SIZE, FACTORS)))
    positive = np.clip(np.mean([r[0] for r in rows]), 0.01, 0.99)
    model.bias = float(np.log(positive / (1 - positive)))
    seen_b, seen_l, seen_f = 1.0, np.ones(SIZE), np.ones((SIZE, FACTORS))
    rate, decay, batch = 0.3, 1e-4, 32
    for _ in range(epochs):
        order = draw.permutation(len(rows))
        for first in range(0, len(rows), batch):
            part = [rows[i] for i in order[first : first + batch]]
            x = Entries(np.repeat(np.arange(len(part)), [len(p[1]) for p in part]), np.concatenate([p[1] for p in part]).astype(np.int64), np.concatenate([p[2] for p in part]).astype(np.float64))
            error = model.scores(x, len(part)) - np.array([p[0] for p in part])
            scaled = model.factors[x.at] * x.value[:, None]
            sums = np.zeros((len(part), FACTORS))
            np.add.at(sums, x.row, scaled)
            touched, where = np.unique(x.at, return_inverse=True)
            step = error[x.row] * x.value
            line = np.bincount(where, weights=step) + decay * model.linear[touched]
            pull = np.zeros((len(touched), FACTORS))
            np.add.at(pull, where, step[:, None] * (sums[x.row] - scaled))
            pull += decay * model.factors[touched]
            seen_b += error.sum() ** 2
            model.bias -= rate * error.sum() / np.sqrt(seen_b) / batch
            seen_l[touched] += line**2
            model.linear[touched] -= rate * line / np.sqrt(seen_l[touched])
            seen_f[touched] += pull**2
            model.factors[touched] -= 0.3 * rate * pull / np.sqrt(seen_f[touched])
    return model


def _lengths(values: pa.Array) -> np.ndarray:
    return values.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)


def sampled_labels(labels: DataFrame, label: str, folds: Column, key: str = "doc_id", rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled keys outside the held-out fold: those with the smallest hash."""
    known = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).filter(F.col("_label").isin(0, 1) & folds)
    return known.orderBy(F.xxhash64("_key"), "_key", "_label").limit(rows)


def train(docs: DataFrame, sample: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars") -> FactorisationMachine:
    """Fit on the sampled (_key, _label) rows, whose features the tasks compute; the sample is small and broadcast."""

    def described(batches):
        for batch in batches:
            for first, data, offsets in text_chunks(batch.column(1)):
                n = len(offsets) - 1
                x = features(data, offsets, _lengths(batch.column(2))[first : first + n])
                cuts = np.searchsorted(x.row, np.arange(n + 1))
                lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(v, kind)) for v, kind in ((x.at, pa.int32()), (x.value, pa.float32()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), *lists], names=["_label", "at", "value"])

    chosen = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"), F.col(length).cast("double").alias("_length")).join(F.broadcast(sample), "_key")
    found = chosen.select("_label", "_text", "_length", F.xxhash64("_key", "_text").alias("_order"))
    found = found.orderBy("_order").limit(SAMPLE_ROWS).select("_label", "_text", "_length").mapInArrow(described, "_label int, at array<int>, value array<float>").toArrow()
    rows = zip(found["_label"].to_pylist(), found["at"], found["value"])
    return fit([(y, a.values.to_numpy(), v.values.to_numpy()) for y, a, v in rows])


def quality_score(model: FactorisationMachine, text: Column, length: Column) -> Column:
    """The probability that a text is good; null and empty texts are scored from their statistics like any other."""

    @F.arrow_udf("double")
    def score(texts: pa.Array, lengths: pa.Array) -> pa.Array:
        known, found = _lengths(lengths), []
        for first, data, offsets in text_chunks(texts):
            n = len(offsets) - 1
            found.append(model.scores(features(data, offsets, known[first : first + n]), n))
        return pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())

    return score(text.cast("string"), length.cast("double"))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``; columns of these names are replaced.

    Learns from at most SAMPLE_ROWS labels of rows outside the held-out fold. Scores every row from its text and
    length alone, whatever its id, language or source: null, empty, repeated and very long texts alike, all in one
    pass without a shuffle. Without any label every score is one half; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    held_out = fold_of(F.col(key), FOLDS) == 0
    sample = sampled_labels(labels, "quality", ~fold_of(F.col(key), FOLDS).eqNullSafe(0), key)
    model = train(docs, sample, key, text, length)
    scored = docs.drop("held_out", "score", "predicted").withColumn("score", quality_score(model, F.col(text), F.col(length)))
    return scored.withColumn("held_out", held_out).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op2_quality": op2_quality}
ORACLES: dict[str, str] = {}
