import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import rows
from oracle_check import compare, connect

from tablewright.llm import fm_index, spelling


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(counts, ratio=10):
    words = sorted(counts)
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_apart(v, w)] for w in words}
    form = {}
    for w in words:
        best = max(near[w], key=lambda v: (counts[v], [-ord(c) for c in v] + [1]), default=None)
        best = min((v for v in near[w] if counts[v] == counts[best]), default=None) if best else None
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return out


def found(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_query_equals_sql(spark, tiny):
    assert compare(spelling.op13_spelling(spark, tiny), connect(tiny), spelling.ORACLE) is None


def counted_by_hand(docs, misspelt=31, least_chars=7, least_count=2):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if misspelt and h % misspelt == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += len(word) >= least_chars
    return {w: n for w, n in counts.items() if n >= least_count}


def test_counts(spark, tiny, monkeypatch):
    docs = rows(tiny, "documents", "doc_id, text") + [(None, "Ärzte ÄRZTEhaus ÄRZTEhaus éxample×÷ß éxample×÷ß"), (None, None), (3, ""), (4, "x" * 9000), (4, "x" * 9000), (5, "repeated " * 300_000)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n int")
    want = counted_by_hand(docs)
    assert {r.word: r.n for r in spelling.count_words(df).collect()} == want
    monkeypatch.setattr(spelling, "COUNTED", 50)
    assert {r.word: r.n for r in spelling.count_words(df).collect()} == want
    assert spelling.count_words(df.limit(0)).count() == 0
    assert list(spelling._slices(b"abc def ghi", 4)) == [b"abc def ", b"ghi"]


def vocabulary(seed, size):
    draw = random.Random(seed)
    words = {"".join(draw.choice("abé") for _ in range(draw.randrange(1, 7))) for _ in range(size)}
    words |= {"".join(draw.choice("aaab") for _ in range(draw.randrange(7, 13))) for _ in range(size)}
    words |= {"stem" + "".join(draw.choice("abcdefghij") for _ in range(4)) for _ in range(size)}
    return {w: draw.choice([1, 2, 10, 30, 100, 1000, 1000]) for w in words}


@pytest.mark.parametrize("indexed", [1 << 16, 40])
def test_variants_equal_brute_force(spark, monkeypatch, indexed):
    counts = vocabulary(indexed, 150)
    counts |= {"q" * 3000: 5, "q" * 3001: 60, "q" * 1500 + "r" + "q" * 1500: 700, "\U0001f600b中": 3, "\U0001f600b": 31}
    monkeypatch.setattr(spelling, "INDEXED", indexed)  # 40: halves with tiles
    df = spark.createDataFrame([(w, n, 0) for w, n in counts.items()], "word string, n long, half int")
    assert found(spelling.spelling_variants(df)) == by_hand(counts)
    monkeypatch.setattr(spelling, "BROADCAST_ROWS", 0)
    assert found(spelling.spelling_variants(df)) == by_hand(counts)


def test_odd_words(spark):
    df = spark.createDataFrame([(None, 5), ("", 4), ("a", 1), ("b", 20), ("a", 1), ("ab", 200)], "word string, n long")
    assert found(spelling.spelling_variants(df)) == by_hand({"a": 2, "b": 20, "ab": 200})
    assert found(spelling.spelling_variants(df.limit(0))) == []


@pytest.mark.parametrize("leftward", [True, False])
def test_index_finds_what_shares_the_exact_part(leftward):
    words = sorted(vocabulary(3, 120))
    index = fm_index.WordIndex(words, leftward)
    asked = words + ["zzz", "aab", "stemabcx"]
    turned = asked if leftward else [w[::-1] for w in asked]
    exact = np.array([(len(w) + 1) // 2 for w in asked])
    query, word = index.one_error(*fm_index.code_points(turned), exact)
    got = set(zip(query.tolist(), word.tolist()))
    assert len(got) == len(query)
    for q, a in enumerate(asked):
        half = (len(a) + 1) // 2
        rest = (lambda w: w[: len(w) - half]) if leftward else (lambda w: w[half:])
        part = (lambda w: w[len(w) - half :]) if leftward else (lambda w: w[:half])
        want = {i for i, b in enumerate(words) if len(b) >= half and part(a) == part(b) and one_apart(rest(a), rest(b))}
        assert {i for p, i in got if p == q} == want
