import math

import numpy as np
from brute import groups, rows

from tablewright.llm import embeddings


def plain(vectors, limit=0.9):
    good = [(k, np.array(v, dtype=np.float64)) for k, v in vectors if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    keys = [k for k, _ in good]
    units = np.array([v / np.linalg.norm(v) for v in (v / np.abs(v).max() for _, v in good)])
    a, b = np.nonzero(np.triu(units @ units.T >= limit, 1))
    links = [(keys[x], keys[y]) for x, y in zip(a, b)]
    lowest = groups([k for k, _ in vectors], links)
    count = {k: 0 for k, _ in vectors}
    for x, y in links:
        count[x] += 1
        count[y] += 1
    return sorted((k, count[k], lowest[k], k == lowest[k]) for k, _ in vectors)


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.1"
    found = sorted(map(tuple, embeddings.op9_embeddings(spark, sf_dir).collect()))
    assert found == plain(rows(sf_dir, "embeddings", "vec_id, embedding"))


def test_recall_on_a_spread_of_similarities(spark):
    draw = np.random.default_rng(7)
    base = draw.normal(size=(300, 64))
    vectors = np.vstack([base, *(base + s * draw.normal(size=base.shape) for s in (0.2, 0.3, 0.45))])
    vectors = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    expected, found = plain(vectors), sorted(map(tuple, embeddings.near_duplicates(df).collect()))
    assert all(f[1] <= e[1] for f, e in zip(found, expected))
    assert sum(f[1] for f in found) >= 0.9 * sum(e[1] for e in expected)


def test_recall_holds_with_the_keys_of_millions_of_vectors(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "LEAST_BITS", 22)
    draw = np.random.default_rng(9)
    units = draw.normal(size=(800, 64))
    units /= np.linalg.norm(units, axis=1)[:, None]
    aside = draw.normal(size=units.shape)
    aside -= (aside * units).sum(axis=1)[:, None] * units
    aside /= np.linalg.norm(aside, axis=1)[:, None]
    cosine = draw.uniform(0.9001, 0.92, size=(800, 1))
    vectors = [(i, v.tolist()) for i, v in enumerate(np.vstack([units, cosine * units + np.sqrt(1 - cosine**2) * aside]))]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    expected, found = plain(vectors), sorted(map(tuple, embeddings.near_duplicates(df).collect()))
    assert all(f[1] <= e[1] for f, e in zip(found, expected))
    recall = sum(f[1] for f in found) / sum(e[1] for e in expected)
    print("recall", recall)
    assert recall >= 0.93


def test_a_large_bucket_is_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 7)
    draw = np.random.default_rng(8)
    vectors = [(i, (np.eye(16)[0] + 0.02 * draw.normal(size=16)).tolist()) for i in range(60)] + [(99, [1.0] * 16)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, embeddings.near_duplicates(df).collect())) == plain(vectors)


def test_odd_rows(spark):
    vectors = [(5, [1.0, 0.0, 0.0]), (3, [2.0, 0.0, 0.0]), (4, [1.0, 0.0, 0.0]), (1, None), (2, []), (6, [0.0] * 3), (7, [1.0, None, 0.0]), (8, [float("nan"), 1.0, 0.0]), (9, [float("inf"), 0.0, 0.0]), (10, [1e-300, 0.0, 0.0]), (11, [0.0, 1e300, 0.0]), (12, [1.0, 0.0])]
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in vectors], "vec_id long, embedding array<double>, n string, component int")
    assert sorted(map(tuple, embeddings.near_duplicates(df).collect())) == plain([v for v in vectors if v[0] != 12]) + [(12, 0, 12, True)]
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    repeated = spark.createDataFrame([(1, [1.0, 2.0])] * 3, "vec_id long, embedding array<float>")
    assert [tuple(r) for r in embeddings.near_duplicates(repeated).collect()] == [(1, 2, 1, True)] * 3
