import math
from collections import Counter

import duckdb
import pytest

from tablewright.llm import mixing


def test_query_equals_sql(spark, tiny):
    found = mixing.op10_poisson_mix(spark, tiny)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tiny}/documents.parquet'")
    result = con.execute(mixing.ORACLE)
    names = [d[0] for d in result.description]
    assert Counter(map(tuple, found.select(*names).collect())) == Counter(result.fetchall())


@pytest.mark.parametrize("rate", [0.0, 0.05, 0.7, 1.0, 3.4, 40.0])
def test_counts_are_poisson(spark, rate):
    n = 4000
    counts = [r[0] for r in spark.range(n).select(mixing.poisson_count(mixing.F.lit(rate), mixing.F.col("id").cast("string"))).collect()]
    mean = sum(counts) / n
    assert abs(mean - rate) <= 5 * math.sqrt(rate / n)
    assert abs(sum((c - mean) ** 2 for c in counts) / n - rate) <= 6 * (rate + rate**2) / math.sqrt(n) + 1e-9
    if 0 < rate <= 1:
        assert abs(counts.count(0) / n - math.exp(-rate)) < 5 / math.sqrt(n)


def test_sources_reach_their_weights(spark):
    rows = [(i, "big" if i % 3 else "small" if i % 2 else None, f"t{i}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    weights = spark.createDataFrame([("big", 1.0), ("small", 3.0)], "source string, weight double")
    found = Counter(r.source for r in mixing.replicate(df, weights=weights).collect())
    assert found[None] == 0 and abs(found["big"] - 1500) < 200 and abs(found["small"] - 4500) < 400


def test_many_sources_are_joined_alike(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"s{i % 7}" if i % 5 else None, "t") for i in range(500)], "doc_id long, source string, text string")
    small = Counter(map(tuple, mixing.replicate(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    assert Counter(map(tuple, mixing.replicate(df).collect())) == small


def test_odd_rows(spark):
    rows = [(1, "a", None, "x", 7), (1, "a", None, "x", 7), (None, None, "", "y", 8), (3, "b", "long " * 50_000, "z", 9)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, copy string, _rate int")
    mixed = mixing.replicate(df)
    found = mixed.collect()
    counts = Counter((r.doc_id, r.copy) for r in found if r.doc_id == 1)
    assert all(n == 2 for n in counts.values())
    assert {"doc_id", "source", "text", "copy", "mix_key"} == set(mixed.columns)
    assert mixing.replicate(df.limit(0)).count() == 0
    none = spark.createDataFrame([], "source string, weight double")
    assert mixing.replicate(df, weights=none).count() == 0


def test_the_plan_is_native(spark, tiny):
    plan = mixing.op10_poisson_mix(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
