import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from brute import rows
from tokenizers import Tokenizer

from tablewright.llm import packing


def plain_pieces(docs, capacity=2048):
    model = Tokenizer.from_file(packing.tokenizer_path())
    out = []
    for doc, text in docs:
        ids = model.encode(text or "", add_special_tokens=False).ids + [0]
        for p, a in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[a : a + capacity], dtype="<u4")
            out.append((doc, p, a, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=repr)


def plain_best_fit(lengths, capacity=2048):
    """How many sequences best fit opens, longest first."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def check(found, expected, capacity=2048):
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=repr) == expected
    places = defaultdict(list)
    for r in found:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(places) == plain_best_fit([r.length for r in found], capacity)


def test_query_equals_tokenizer_and_best_fit(spark, tiny):
    check(packing.op6_best_fit_pack(spark, tiny).collect(), plain_pieces(rows(tiny, "documents", "doc_id, text")))


def test_odd_rows(spark):
    texts = [None, "", " \n", "it's THE end<|endoftext|> a b café café", "word " * 5000, "x" * 9000, "A b", "A b", "a\x1cb \x85   c ''s 12 3!!"]
    docs = [(None if i == 3 else i // 2, t) for i, t in enumerate(texts)] + [(0, "same")] * 5
    df = spark.createDataFrame([(*d, "q", 1) for d in docs], "doc_id long, text string, sequence_id string, length int")
    check(packing.pack_documents(df).collect(), plain_pieces(docs))
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_plan_is_best_fit():
    draw = random.Random(5)
    for capacity in (7, 16, 40):
        for _ in range(60):
            counts = Counter(draw.randrange(1, capacity) for _ in range(draw.randrange(0, 120)))
            places = Counter()
            for length, n in counts.items():
                runs = sorted(p for p in packing.best_fit_plan(counts, capacity) if p[0] == length)
                for rank in range(n):
                    _, low, first, each, offset = [p for p in runs if p[1] <= rank][-1]
                    places[first + (rank - low) // each] += length
            assert max(places.values(), default=0) <= capacity
            assert len(places) == plain_best_fit(counts.elements(), capacity)


def test_ids_are_kept(spark):
    df = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    row = packing.pack_documents(df, keep_ids=True).first()
    assert row.ids[-1] == 0 and len(row.ids) == row.length


def test_regular_words_keep_their_own_ids(spark):
    words = ["".join("ab"[bin(i).count("1") % 2 ^ flip] for i in range(2048)) for flip in (0, 1)]
    docs = [(i, f"x {w}") for i, w in enumerate(words + words[:1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    assert sorted(map(tuple, packing.pieces(df).collect())) == plain_pieces(docs)
