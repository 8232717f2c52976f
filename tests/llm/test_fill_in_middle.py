import hashlib
import random
import re

import numpy as np
import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F

from tablewright.llm import fill_in_middle as fim

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc, text, rate=50, spm_rate=80):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    units = UNITS.findall(text)
    n = len(units)
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm_rate:
        return doc, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_query_equals_sql(spark, tiny):
    assert compare(fim.op12_fill_in_middle(spark, tiny), connect(tiny), fim.ORACLE) is None


@pytest.mark.parametrize("rates", [(50, 80), (100, 0), (100, 100), (0, 50)])
def test_odd_rows(spark, rates):
    texts = [None, "", " ", "\n\t", "a", " a", "a ", "x <P> y", "a <S", "<", "M> <M", "é ñ  日本 \U0001f600\x85\xa0z ", "word " * 40_000, "y" * 200_000, "q\x1cr  \x0bs"]
    draw = random.Random(3)
    texts += ["".join(draw.choice("ab <>PSM\n é") for _ in range(draw.randrange(60))) for _ in range(200)]
    docs = [(None if i == 4 else i // 2, t) for i, t in enumerate(texts)] + [(0, "same x")] * 3
    df = spark.createDataFrame([(*d, "n", 1) for d in docs], "doc_id long, text string, form string, n int")
    made = fim.fill_in_middle(df, rate=rates[0], spm_rate=rates[1])
    found = sorted((tuple(r) for r in made.collect()), key=repr)
    assert found == sorted((plain(*d, *rates) for d in docs), key=repr)
    back = made.select(fim.restored(F.col("form"), F.col("output")))
    assert sorted(r[0] for r in back.collect()) == sorted(t or "" for _, t in docs)
    assert fim.fill_in_middle(df.limit(0)).count() == 0


def test_select_equals_the_list():
    draw = random.Random(7)
    top = 1 << 18
    dense = sorted(draw.sample(range(1 << 16), 30_000))
    sets = [[], [0], [5], [65535, 65536], list(range(1000, 200_000)), sorted(draw.sample(range(top), 500)), dense, sorted(draw.sample(range(top), 100_000))]
    sets.append(sorted({*dense, *range(70_000, 90_000), *draw.sample(range(140_000, top), 900)}))
    kinds = set()
    for members in sets:
        made = fim.BoundarySet(np.array(members, dtype=np.int64))
        kinds |= {type(c).__name__ for c in made.containers}
        assert len(made) == len(members)
        ranks = range(len(members)) if len(members) < 3000 else draw.sample(range(len(members)), 2000) + [0, len(members) - 1]
        assert [made.select(k) for k in ranks] == [members[k] for k in ranks]
    assert kinds == {"ArrayContainer", "RunContainer", "BitmapContainer"}
