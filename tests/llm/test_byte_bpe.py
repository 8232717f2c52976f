import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from brute import rows

from tablewright.llm import byte_bpe


@pytest.fixture(scope="module")
def model():
    lines = open(byte_bpe.ranks_path(), "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(model, docs):
    return sorted(((doc, np.array(model.encode_ordinary(text or ""), dtype="<u4").tobytes(), (text or "").encode()) for doc, text in docs), key=repr)


def found(df, **options):
    both = byte_bpe.decode(byte_bpe.encode(df, **options)).collect()
    assert all(r.n_tokens * 4 == len(r.ids) for r in both)
    return sorted(((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in both), key=repr)


def test_query_equals_the_library(spark, tiny, model):
    docs = rows(tiny, "documents", "doc_id, text")
    digest = lambda x: hashlib.sha256(x).hexdigest()
    want = {doc: (len(ids) // 4, digest(ids), digest(raw)) for doc, ids, raw in expected(model, docs)}
    made = byte_bpe.op11_byte_bpe(spark, tiny).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in made} == want and len(made) == len(docs)


ODD = [None, "", " ", "\n\n x", "don't we'll 'S", "a" * 700, " " * 900 + "x", "é" * 300 + " ü", "日本語テキスト" * 60, "1234567890" * 40, "!'s?" * 100]
ODD += ["'s" * 300, "x '", "''''ll" * 90, "\U0001f600  \x85\xa0y" * 50, "\x1c\x1d a \x1f", "՘࢏ a\U00011de0 b", "<|endoftext|> z"]


@pytest.mark.parametrize("chunk, overlap", [(1 << 16, 1 << 10), (64, 24), (48, 48), (7, 3)])
def test_chunks_resynchronise(spark, model, chunk, overlap):
    draw = random.Random(chunk)
    texts = ODD + ["".join(draw.choice(["a", "bc", " ", "  ", "\n", "'s", "'re", "'", "1", "é", "日", "!", "՘"]) for _ in range(draw.randrange(400))) for _ in range(60)]
    docs = [(None if i == 5 else i // 2, t) for i, t in enumerate(texts)] + [(0, "again 'n again" * 20)] * 3
    df = spark.createDataFrame([(*d, b"x", 4) for d in docs], "doc_id long, text string, ids binary, decoded int")
    assert found(df, chunk=chunk, overlap=overlap) == expected(model, docs)


def test_very_long_runs(spark, model):
    long = "word " * 60_000 + "b" * 200_000 + " tail 12"
    space = " " * 1_000_000  # more than the library's own splitter can take
    df = spark.createDataFrame([(1, long), (2, space)], "doc_id long, text string")
    got = found(df)
    assert got[0] == expected(model, [(1, long)])[0]
    assert got[1][2] == space.encode() and got[1][1] == np.array(model._core_bpe.encode_single_piece(space.encode()), dtype="<u4").tobytes()
    assert found(df.limit(0)) == []


def test_classes_are_the_librarys(model):
    codec = byte_bpe.ByteBpe(byte_bpe.ranks_path())
    for first in range(0, 0x110000, 1 << 12):
        text = "".join(f"a{chr(c)}1{chr(c)}!{chr(c)}" for c in range(first, first + (1 << 12)) if not 0xD800 <= c < 0xE000)
        parts = codec.split(text.encode())
        assert "".join(parts) == text
        assert codec.ids(parts) == np.array(model.encode_ordinary(text), dtype="<u4").tobytes()
