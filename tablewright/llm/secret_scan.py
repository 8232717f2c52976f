"""Secret scanning: fixed patterns, and strings that stay novel to zstandard primed with what surrounds them."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import bounded_batches, table, text_chunks

KINDS = ("assign", "access", "hex", "novel")
MASK = "[SECRET]"

#: The base patterns and their least lengths.
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32

#: A candidate of the method: so long a run of these characters with a digit and a letter, so near behind a word of a
#: sensitive context, that adds at least so many bytes per character to its compressed surroundings.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]+")
_SENSITIVE = re.compile(r"(?i:key|secret|token|pass|pwd|auth|bearer|credential|private|signature|session|access)", re.ASCII)
LEAST_NOVEL, NEAR, AROUND, NOVEL_SHARE, LEVEL = 20, 48, 256, 0.7, 12
#: What common code and configuration says anyway, as the dictionary that primes the compressor.
IDENTIFIERS = (
    "abcdefghijklmnopqrstuvwxyz 0123456789 ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "https://www.example.com/ http://localhost:8080/ /usr/local/bin/ /home/user/ .html .json .xml .yaml .parquet",
    "import from return function class public static void private protected const let var def self this new null true false None",
    "password passwd secret token api_key apikey access_key client_id client_secret session_id signature authorization bearer",
    "username email address number string integer boolean default configuration environment development production staging",
    "created_at updated_at timestamp version release build commit branch master origin request response content-type application",
    "placeholder changeme your_key_here xxxxxxxxxxxxxxxx 0000000000000000 1234567890123456 example_example_example",
)

_HEX_BYTE, _CANDIDATE_BYTE = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_HEX_BYTE[list(b"0123456789abcdef")] = True
_CANDIDATE_BYTE[[c for c in range(128) if chr(c).isalnum() or chr(c) in "+/_=-"]] = True


class NoveltyScan:
    """Spans of one worker's texts."""

    def __init__(self):
        primed = zstandard.ZstdCompressionDict("\n".join(IDENTIFIERS).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=LEVEL)
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False).compress

    def novelty(self, text: str, start: int, end: int) -> float:
        """Bytes that the string adds to its compressed surroundings, per character."""
        before, after = text[max(0, start - AROUND) : start].encode(), text[end : end + AROUND].encode()
        known = len(self.compress(before + b" " + after))
        return (len(self.compress(before + text[start:end].encode() + after)) - known) / (end - start)

    def spans(self, text: str, has_hex: bool = True, has_candidate: bool = True) -> list[tuple[int, int, int]]:
        """(start, kind, end) in order; code points, end exclusive."""
        found = []
        low = text.lower()
        if any(name in low for name in _NAMES):
            found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_ASSIGN]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
        if has_hex:
            found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
        if has_candidate:
            base, at, reached = sorted(found), 0, 0
            for m in _CANDIDATE.finditer(text):
                a, b = m.span()
                if b - a < LEAST_NOVEL or not _SENSITIVE.search(text, max(0, a - NEAR), a):
                    continue
                # candidates come in order: base spans that start in front of this one's end, and how far they reach
                while at < len(base) and base[at][0] < b:
                    reached = max(reached, base[at][2])
                    at += 1
                if reached > a:
                    continue
                string = m[0]
                if any(c.isdigit() for c in string) and any(c.isalpha() for c in string) and self.novelty(text, a, b) >= NOVEL_SHARE:
                    found.append((a, 3, b))
        return sorted(found)


def _rows_with_run(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, least: int) -> np.ndarray:
    """Which rows hold a run of ``least`` bytes of a kind; runs that cross rows may add a row too many."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = kind[data]
    turns = np.flatnonzero(np.diff(inside))
    starts, ends = turns[::2], turns[1::2]
    long_ = ends - starts >= least
    change = np.zeros(len(offsets) + 1, dtype=np.int64)
    np.add.at(change, np.searchsorted(offsets, starts[long_], "right") - 1, 1)
    np.add.at(change, np.searchsorted(offsets, ends[long_] - 1, "right"), -1)
    return np.cumsum(change)[: len(offsets) - 1] > 0


def _scan(texts: pa.Array, report) -> list:
    scan, found = NoveltyScan(), []
    for first, data, offsets in text_chunks(texts):
        has_hex = _rows_with_run(data, offsets, _HEX_BYTE, LEAST_HEX)
        has_candidate = _rows_with_run(data, offsets, _CANDIDATE_BYTE, LEAST_NOVEL)
        raw, at = data.tobytes(), offsets.tolist()
        for i, (a, b) in enumerate(zip(at, at[1:])):
            text = raw[a:b].decode()
            found.append(report(text, scan.spans(text, bool(has_hex[i]), bool(has_candidate[i]))))
    return found


_FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def secret_spans(text: Column) -> Column:
    """A struct of the counts of base spans, their digest and all spans as kind:start:end, comma-joined."""

    def report(_, spans):
        base = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans if k < 3)
        counts = {f"n_{kind}": sum(k == i for _, k, _ in spans) for i, kind in enumerate(KINDS[:3])}
        return counts | {"base_sha256": hashlib.sha256(base.encode()).hexdigest(), "spans": ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)}

    @F.arrow_udf(f"struct<{_FOUND.replace(' ', ':').replace(',:', ',')}>")
    def scan(texts: pa.Array) -> pa.Array:
        kinds = pa.struct([*((f"n_{k}", pa.int64()) for k in KINDS[:3]), ("base_sha256", pa.string()), ("spans", pa.string())])
        return pa.array(_scan(texts, report), kinds)

    return scan(text.cast("string"))


def masked(text: Column) -> Column:
    """The text with every span, overlapping ones as one, replaced by MASK."""

    def report(text_, spans):
        out, end = [], 0
        for a, _, b in spans:
            if a >= end:
                out += [text_[end:a], MASK]
            end = max(end, b)
        return "".join(out) + text_[end:]

    @F.arrow_udf("string")
    def mask(texts: pa.Array) -> pa.Array:
        return pa.array(_scan(texts, report), pa.string())

    return F.when(text.isNotNull(), mask(text.cast("string")))


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, base_sha256 and spans; columns of these names are replaced.

    Every text is scanned whole, in one pass without a shuffle: null and empty texts have no span, repeated rows equal
    ones. Base spans are the leftmost non-overlapping matches of each fixed pattern. The method adds ``novel`` spans:
    candidates behind a sensitive word that overlap no base span and hardly shrink under a compressor that knows the
    surrounding text and common code.
    """
    bounded_batches(docs.sparkSession)
    names = [c.split()[0] for c in _FOUND.split(", ")]
    return docs.drop(*names).withColumn("_found", secret_spans(F.col(text))).select("*", "_found.*").drop("_found")


def mask_secrets(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with masked texts and, if there is one, their new length; all rows and columns stay, null texts too."""
    bounded_batches(docs.sparkSession)
    out = docs.withColumn(text, masked(F.col(text)))
    return out.withColumn(length, F.length(text).cast(docs.schema[length].dataType)) if length in docs.columns else out


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


QUERIES = {"op7_secrets": op7_secrets}
ORACLES: dict[str, str] = {}
