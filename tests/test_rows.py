"""Duplicates, missing values, outliers and statistics against pandas, with skew."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright.operators import columns, dedup, knn, missing, ordered, outliers, stats, texts
from tablewright.operators.knn import knn_impute
from tablewright.session import materialize

PEOPLE5 = [
    ("Alice", 25.0, "New York"),
    ("Bob", 30.0, "London"),
    ("Alice", 25.0, "New York"),
    ("Charlie", 35.0, "Paris"),
    (None, None, "Tokyo"),
]


@pytest.fixture(scope="module")
def people(spark):
    rows = [(i, *p) for i, p in enumerate(PEOPLE5)]
    return spark.createDataFrame(rows, "i int, name string, age double, city string")


def frame(seed=0, n=600):
    """A third of all rows share one key; a fifth of the values are missing."""
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.34, "hot", rng.integers(0, n // 3, n).astype(str))
    value = rng.normal(size=n).round(3)
    value[rng.random(n) < 0.2] = np.nan
    count = rng.integers(0, 9, n).astype(float)
    count[rng.random(n) < 0.3] = np.nan
    return pd.DataFrame({"i": np.arange(n), "key": key, "value": value, "count": count})


def to_spark(spark, pdf):
    clean = pdf.astype(object).where(pdf.notna(), None)
    ddl = "i bigint, key string, value double, count double"
    return spark.createDataFrame(clean.values.tolist(), ddl).repartition(5)


def to_pandas(df):
    return df.orderBy("i").toPandas().reset_index(drop=True)


def same(got, expected):
    pd.testing.assert_frame_equal(
        got, expected.reset_index(drop=True), check_dtype=False, rtol=1e-9, atol=1e-9
    )


@pytest.mark.parametrize("keep", ["first", "last", "all"])
def test_drop_duplicates_like_pandas(spark, keep):
    pdf = frame(1)
    pdf.loc[pdf["i"] % 50 == 0, "key"] = None
    got = dedup.drop_duplicates(to_spark(spark, pdf), ["key"], keep, ["i"])
    kept = pdf.drop_duplicates(subset=["key"], keep=False if keep == "all" else keep)
    same(to_pandas(got), kept)


def test_whole_row_duplicates(people, rows):
    kept = dedup.drop_duplicates(people.drop("i"))
    assert kept.count() == 4
    count = dedup.duplicate_count(people, ["name", "age", "city"]).first()
    assert (count["row_count"], count["duplicate_count"], count["duplicate_percent"]) == (5, 1, 20.0)


def test_copies(spark):
    pdf = frame(2)
    got = dedup.drop_duplicates(to_spark(spark, pdf), ["key"], "first", ["i"], copies="n").collect()
    assert {r["key"]: r["n"] for r in got} == pdf["key"].value_counts().to_dict()


def test_flag_like_pandas(spark):
    pdf = frame(3)
    got = to_pandas(dedup.flag_duplicates(to_spark(spark, pdf), ["i"], ["key"]))
    assert got["is_duplicate"].tolist() == pdf.duplicated(subset=["key"]).tolist()


def test_dedup_arguments(people):
    with pytest.raises(ValueError):
        dedup.drop_duplicates(people, keep="some")
    with pytest.raises(ValueError):
        dedup.drop_duplicates(people, ["name"])
    with pytest.raises(ValueError):
        dedup.drop_duplicates(people, ["nobody"], order_by=["i"])
    with pytest.raises(ValueError):
        dedup.drop_duplicates(people.withColumn("m", F.create_map("name", "age")))


def filled_by_pandas(pdf, strategy):
    out = pdf.copy()
    for c in ("value", "count"):
        if strategy == "fill_mean":
            out[c] = out[c].fillna(out[c].mean())
        if strategy == "fill_median":
            out[c] = out[c].fillna(out[c].median())
        if strategy == "fill_mode":
            out[c] = out[c].fillna(out[c].mode()[0])
        if strategy == "forward_fill":
            out[c] = out[c].ffill()
        if strategy == "backward_fill":
            out[c] = out[c].bfill()
        if strategy == "interpolate":
            out[c] = out[c].interpolate()
    return out.dropna(subset=["value", "count"]) if strategy == "drop" else out


@pytest.mark.parametrize(
    "strategy",
    ["drop", "fill_mean", "fill_median", "fill_mode", "forward_fill", "backward_fill", "interpolate"],
)
def test_strategies_like_pandas(spark, strategy):
    pdf = frame(4)
    pdf.loc[:5, "value"] = np.nan
    pdf.loc[590:, ["value", "count"]] = np.nan
    got = missing.handle_missing(to_spark(spark, pdf), strategy, ["value", "count"], order_by=["i"])
    same(to_pandas(got), filled_by_pandas(pdf, strategy))


def test_fill_custom(people):
    out = missing.fill_custom(missing.fill_custom(people, "none", ["name"]), 1, ["age"])
    assert out.filter("name = 'none' AND age = 1.0").count() == 1
    with pytest.raises(ValueError):
        missing.fill_custom(people, None)


def test_missing_arguments(people):
    for bad in ("guess", "forward_fill"):
        with pytest.raises(ValueError):
            missing.handle_missing(people, bad)
    with pytest.raises(ValueError):
        missing.handle_missing(people, "drop", ["nobody"])


SPARSE = st.lists(st.one_of(st.none(), st.integers(-5, 5)), min_size=1, max_size=25)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(SPARSE)
def test_ordered_operators_any_gaps(spark, values):
    pdf = pd.DataFrame({"i": range(len(values)), "v": pd.array(values, dtype="Float64")})
    expected = pdf["v"].astype(float)
    df = spark.createDataFrame(list(enumerate(values)), "i int, v int")
    forward = ordered.fill_ordered(df, ["v"], ["i"], "forward", 3).orderBy("i").collect()
    backward = ordered.fill_ordered(df, ["v"], ["i"], "backward", 3).orderBy("i").collect()
    line = ordered.interpolate_ordered(df, ["v"], ["i"], 3).orderBy("i").collect()
    for got, want in (
        (forward, expected.ffill()),
        (backward, expected.bfill()),
        (line, expected.interpolate()),
    ):
        for row, w in zip(got, want):
            assert (row["v"] is None and np.isnan(w)) or row["v"] == pytest.approx(w)


@pytest.mark.parametrize("lead", ["tied", "text"])
def test_order_without_usable_leading_column(spark, lead):
    """One leading value holds most rows, or it is text: rows are range-partitioned."""
    pdf = frame(5, 400)
    tied = "CASE WHEN i % 3 = 0 THEN CAST(i AS INT) ELSE 200 END"
    text = "lpad(CAST(i AS STRING), 6, '0')"
    df = to_spark(spark, pdf).withColumn("lead", F.expr(tied if lead == "tied" else text))
    order = ["lead", "i"]
    sorted_pdf = df.toPandas().sort_values(order).reset_index(drop=True)
    got = ordered.fill_ordered(df, ["value"], order, "forward", 6)
    got = got.toPandas().sort_values(order).reset_index(drop=True)
    assert got["value"].tolist()[1:] == pytest.approx(
        sorted_pdf["value"].ffill().tolist()[1:], nan_ok=True
    )
    numbered = ordered.global_row_number(df, order, "n").toPandas().sort_values(order)
    assert numbered["n"].tolist() == list(range(1, 401))


def test_rows_without_position_stay(spark):
    df = spark.createDataFrame([(None, 1.0), (1, None), (2, 5.0)], "i int, v double")
    out = ordered.fill_ordered(df, ["v"], ["i"], "forward", 2).collect()
    assert sorted((r["i"] is None, r["i"] or 0, r["v"]) for r in out) == [
        (False, 1, 1.0), (False, 2, 5.0), (True, 0, 1.0),
    ]


@pytest.mark.parametrize("limit", [1_000_000, 7])
def test_percentiles_like_pandas(spark, limit):
    pdf = frame(6, 900)
    pdf.loc[pdf["i"] % 3 == 0, "value"] = 0.5
    shares = [0.0, 0.25, 0.5, 0.97]
    got = stats.exact_percentiles(to_spark(spark, pdf), ["value", "count"], shares, limit)
    for c in ("value", "count"):
        assert got[c] == pytest.approx(pdf[c].quantile(shares).tolist(), abs=1e-12)


def test_percentiles_with_infinities(spark):
    values = [float("-inf"), 1.0, 2.0, 3.0, 4.0, float("inf"), float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for limit in (100, 1):
        got = stats.exact_percentiles(df, ["v"], [0.0, 0.5, 1 / 6], limit)["v"]
        assert got == [float("-inf"), 3.0, 1.0]


def test_percentiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert stats.exact_percentiles(df, ["v"], [0.5]) == {"v": [None]}


def test_modes_and_top_values(spark):
    rows = [("b", 2), ("a", 1), ("a", 2), ("b", None), (None, None)]
    df = spark.createDataFrame(rows, "t string, n int").withColumn("none", F.lit(None).cast("string"))
    assert stats.modes(df, ["t", "n", "none"]) == {"t": "a", "n": 2, "none": None}
    top = stats.top_values(df, ["t"], 1).collect()
    assert [(r["value"], r["count"], r["rank"]) for r in top] == [("a", 2, 1)]


def test_outliers_like_pandas(spark):
    pdf = frame(7)
    pdf.loc[::40, "value"] = 50.0
    df = to_spark(spark, pdf)
    q1, q3 = pdf["value"].quantile([0.25, 0.75])
    keep = pdf["value"].isna() | pdf["value"].between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    same(to_pandas(outliers.remove_outliers(df, ["value", "key"])), pdf[keep])
    z = ((pdf["value"] - pdf["value"].mean()) / pdf["value"].std()).abs()
    same(to_pandas(outliers.remove_outliers(df, ["value"], "zscore", 2.0)), pdf[~(z > 2.0)])
    with pytest.raises(ValueError):
        outliers.remove_outliers(df, ["key"])
    with pytest.raises(ValueError):
        outliers.remove_outliers(df, ["value"], "guess")


def test_constant_column_has_no_outliers(spark):
    df = spark.createDataFrame([(1.0,)] * 4, "v double")
    assert outliers.remove_outliers(df, ["v"], "zscore", 1.0).count() == 4


def knn_by_hand(pdf, names, k):
    """Brute force over all pairs, ties to the earlier row."""
    x = pdf[names].to_numpy(float)
    out = x.copy()
    for r, t in zip(*np.where(np.isnan(x))):
        near = []
        for d in range(len(x)):
            both = ~np.isnan(x[r]) & ~np.isnan(x[d])
            if not np.isnan(x[d, t]) and both.any():
                gap = ((x[r, both] - x[d, both]) ** 2).sum() * len(names) / both.sum()
                near.append((gap, d, x[d, t]))
        best = sorted(near)[:k]
        out[r, t] = np.mean([v for _, _, v in best]) if best else np.nanmean(x[:, t])
    return out


def knn_rows(n, seed):
    """Few different numbers, a point that a third of all rows share, and gaps."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 6, (n, 3)).astype(float)
    x[: n // 3] = [2.0, 2.0, 2.0]
    x[2 * n // 3 :] += rng.random((n - 2 * n // 3, 3)) * 40
    x[rng.random((n, 3)) < 0.2] = np.nan
    x[5] = np.nan
    x[9, :2], x[10] = -0.0, [np.nan, 0.0, 0.0]
    return pd.DataFrame({"i": np.arange(n), **dict(zip("abc", x.T))})


@pytest.mark.parametrize("cell_rows, tile_rows", [(4096, 1 << 16), (20, 1 << 16), (20, 4)])
def test_knn_like_brute_force(spark, monkeypatch, cell_rows, tile_rows):
    monkeypatch.setattr(knn, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(knn, "TILE_ROWS", tile_rows)
    pdf = knn_rows(240, cell_rows + tile_rows)
    rows = pdf.astype(object).where(pdf.notna(), None).values.tolist()
    df = spark.createDataFrame(rows, "i bigint, a double, b double, c double").repartition(4)
    got = knn_impute(df, ["a", "b", "c"], ["i"]).orderBy("i").toPandas()
    assert np.allclose(got[["a", "b", "c"]].to_numpy(), knn_by_hand(pdf, ["a", "b", "c"], 5))


def test_knn_of_rare_values(spark, monkeypatch):
    """A column with fewer values than neighbours, one without any, and coordinates that are hardly ever shared."""
    monkeypatch.setattr(knn, "CELL_ROWS", 10)
    rows = [(f"r{i:03}", float(i) if i % 3 else None, float(i % 7) if i % 3 == 0 or i > 110 else None, 1.0 * i if i in (3, 50) else None, None) for i in range(120)]
    pdf = pd.DataFrame(rows, columns=["i", *"abcd"]).astype({c: float for c in "abcd"})
    got = knn_impute(spark.createDataFrame(rows, "i string, a double, b double, c float, d double"), ["a", "b", "c", "d"], ["i"])
    want = knn_by_hand(pdf, list("abcd"), 5)
    assert np.allclose(got.orderBy("i").toPandas()[list("abcd")].to_numpy(dtype=float), want, equal_nan=True)


def test_knn_visits_few_cells(spark):
    """100,000 rows with a gap among 300,000: a query sees a few of the cells, and the answer is right where it is checked."""
    n = 300_000
    points = spark.range(n).select(
        "id", *[(F.rand(s) * 1000).alias(c) for s, c in enumerate("ab")], F.when(F.col("id") % 3 > 0, F.rand(9) * 10).alias("v")
    )
    points = materialize(points, "points")
    plain = points.select(F.col("id").alias("o0"), F.col("a").alias("x0"), F.col("b").alias("x1"), F.col("v").alias("x2"))
    search = knn.NeighbourSearch(plain, ["x0", "x1", "x2"], ["o0"], 5)
    cells = len(search.cells.cell)
    best = search.k_best(search.best_of(search.home_visits()))
    bounds = best.filter("rank = 5").groupBy("query").agg(F.collect_list(F.struct("target", "distance")).alias("bounds"))
    visits = search.home_visits().count() + search.further_visits(bounds).count()
    assert search.queries.count() == n // 3
    assert cells > 60 and visits < 3 * n // 3
    pdf = points.toPandas()
    got = knn_impute(points, ["a", "b", "v"], ["id"]).toPandas().set_index("id")["v"]
    given = pdf[pdf["v"].notna()]
    for row in pdf[pdf["v"].isna()].iloc[::5000].itertuples():
        gap = (given["a"] - row.a) ** 2 + (given["b"] - row.b) ** 2
        assert np.isclose(got[row.id], given["v"][gap.nsmallest(5).index].mean())


def test_knn_without_gaps(spark):
    df = spark.createDataFrame([(1, 2.0)], "i int, a double")
    assert knn_impute(df, ["a"], ["i"]).collect() == df.collect()


def test_columns(spark, people):
    assert columns.reorder_columns(people, ["city"]).columns == ["city", "i", "name", "age"]
    assert columns.rename_columns(people, {"age": "years"}).columns == ["i", "name", "years", "city"]
    for bad in ({"nobody": "x"}, {"age": "name"}, {"age": "x", "city": "x"}):
        with pytest.raises(ValueError):
            columns.rename_columns(people, bad)
    odd = spark.createDataFrame([(1, 2, 3)], ["A!", " a ", "?"])
    assert columns.normalize_column_names(odd).columns == ["a", "a_2", "unnamed_column"]
    nan = spark.createDataFrame([(float("nan"),), (1.0,)], "v double")
    assert columns.prepare(nan).filter("v IS NULL").count() == 1
    assert columns.preview(people, 2, ["i"]).count() == 2


def test_nan_is_missing_everywhere(spark):
    from tablewright.operators import missing, outliers, profile

    rows = [(i, float(i % 10)) for i in range(50)] + [(50, float("nan")), (51, None), (52, 1000.0)]
    df = spark.createDataFrame(rows, "i int, x double")
    kept = outliers.remove_outliers(df, ["x"], "zscore", 3.0)
    assert kept.count() == 52 and kept.filter("x = 1000").count() == 0
    assert outliers.remove_outliers(df, ["x"]).count() == 52
    mean = (sum(float(i % 10) for i in range(50)) + 1000.0) / 51
    filled = {r.i: r.x for r in missing.fill_mean(df, ["x"]).collect()}
    assert abs(filled[50] - mean) < 1e-9 and abs(filled[51] - mean) < 1e-9
    row = profile.numeric_summary(df, ["x"]).first()
    assert row["count"] == 51 and abs(row["mean"] - mean) < 1e-9 and row["max"] == 1000.0
    assert profile.missing_summary(df, ["x"]).first()["missing"] == 2


def test_null_positions_keep_their_rows(spark):
    from tablewright.operators import dedup

    df = spark.createDataFrame([("a", None, "x"), ("b", 2, "y"), ("b", None, "z")], "k string, p int, v string")
    first = sorted(tuple(r) for r in dedup.drop_duplicates(df, ["k"], "first", ["p"]).select("k", "v").collect())
    assert first == [("a", "x"), ("b", "z")]
    flags = {r.v: r.is_duplicate for r in dedup.flag_duplicates(df, ["p"], ["k"]).collect()}
    assert flags == {"x": False, "z": False, "y": True}


def test_counting_duplicates_tells_values_apart(spark):
    from tablewright.operators import dedup

    rows = [("a", "b,c", 0.0), ("a,b", "c", 0.0), ("a", "b,c", -0.0), (None, "", 1.0), (None, None, 1.0), (None, "", 1.0)]
    df = spark.createDataFrame(rows, "x string, y string, z double")
    assert dedup.duplicate_count(df).first()["duplicate_count"] == 2


def test_wall_clock_times_survive_summer_time(spark):
    from pyspark.sql import functions as F

    from tablewright.functions import casts

    zone = spark.conf.get("spark.sql.session.timeZone")
    df = spark.createDataFrame([("2021-03-14 02:30:00",), ("2021-11-07",), ("no date",), (None,), ("03/05/1890",)], "t string")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        found = [r[0] for r in df.select(casts.to_datetime(F.col("t")).cast("string")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert found == ["2021-03-14 02:30:00", "2021-11-07 00:00:00", None, None, "1890-03-05 00:00:00"]


# every type twice or more: equal rows, rows that differ in the last place only, NULLs
TYPE_ROWS = {
    "ts timestamp": ["timestamp'2024-01-01 00:00:00.000001'", "timestamp'2024-01-01 00:00:00.000002'", "NULL"],
    "ntz timestamp_ntz": ["timestamp_ntz'2024-01-01 00:00:00.000001'", "timestamp_ntz'2024-01-01 00:00:00'", "NULL"],
    "day date": ["date'2024-01-01'", "date'2024-01-02'", "NULL"],
    "f double": ["0.0D", "-0.0D", "double('NaN')", "1e300D", "NULL"],
    "g float": ["float(0.1)", "float(-0.0)", "float(0.0)", "float('NaN')", "NULL"],
    "n decimal(20,3)": ["1.500", "1.501", "NULL"],
    "big bigint": ["9007199254740993L", "9007199254740992L", "NULL"],
    "t string": ["''", "'NULL'", "'a\\u0000b'", "'a\"b'", "NULL"],
    "raw binary": ["X'00FF'", "X'00FE'", "X''", "NULL"],
    "yes boolean": ["true", "false", "NULL"],
    "arr array<double>": ["array(0.0D)", "array(-0.0D)", "array(double('NaN'))", "array()", "array(NULL)", "NULL"],
    "times array<timestamp>": ["array(timestamp'2024-01-01 00:00:00.000001')", "array(timestamp'2024-01-01 00:00:00')", "NULL"],
    "s struct<a:timestamp,b:array<float>>": [
        "named_struct('a', timestamp'2024-01-01 00:00:00.000001', 'b', array(float(0)))",
        "named_struct('a', timestamp'2024-01-01 00:00:00.000001', 'b', array(float(-0.0)))",
        "named_struct('a', NULL, 'b', NULL)",
        "NULL",
    ],
    "iv interval day to second": ["interval '1 00:00:00.000001' day to second", "interval '1 00:00:00' day to second", "NULL"],
}


@pytest.mark.parametrize("column", TYPE_ROWS)
def test_duplicates_of_every_type(spark, column):
    """Keys are told apart by digest exactly as grouping tells them apart."""
    name, kind = column.split(" ", 1)
    values = TYPE_ROWS[column]
    parts = [f"SELECT {i} AS i, CAST({values[i % len(values)]} AS {kind}) AS `{name}`" for i in range(2 * len(values))]
    df = spark.sql(" UNION ALL ".join(parts))
    distinct = df.select(name).dropDuplicates().count()
    assert dedup.drop_duplicates(df, [name], "first", ["i"]).count() == distinct
    assert dedup.drop_duplicates(df, [name], "last", ["i"]).count() == distinct
    assert dedup.duplicate_count(df, [name]).first()["duplicate_count"] == 2 * len(values) - distinct
    assert dedup.flag_duplicates(df, ["i"], [name]).filter("is_duplicate").count() == 2 * len(values) - distinct


def test_infinite_values_are_no_reason_to_drop_all(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("inf"),), (None,)], "v double")
    assert outliers.remove_outliers(df, ["v"], "zscore", 3.0).count() == 5
    df = spark.createDataFrame([(float(i % 3),) for i in range(60)] + [(500.0,), (float("nan"),)], "v double")
    assert outliers.remove_outliers(df, ["v"], "zscore", 3.0).count() == 61


@pytest.mark.parametrize("few", [10_000, 3])
def test_top_texts(spark, monkeypatch, few):
    """Exact whatever ties: frequent texts, texts that occur once, texts alike in their first bytes."""
    monkeypatch.setattr(texts, "FEW", few)
    alike = ["the same fourteen bytes and more " * 3 + f"{i * 7 % 40:02}" for i in range(40)]
    columns_of = {
        "hot": ["hot"] * 30 + ["warm"] * 5 + ["b", "a", "c", "é", ""],
        "once": [f"text {i * 13 % 40}" for i in range(40)],
        "alike": alike,
        "two": ["x", None] * 20,
        "none": [None] * 40,
        "prefix": ["", "a", "a\0", "ab"] * 10,
    }
    names = list(columns_of)
    df = spark.createDataFrame(list(zip(*columns_of.values())), ", ".join(f"{n} string" for n in names)).repartition(5)
    unique, top = texts.top_texts(df, names, 3)
    got = {}
    for r in top.collect():
        got.setdefault(r["column"], []).append((r["rank"], r["value"], r["count"]))
    for name, values in columns_of.items():
        counted = pd.Series([v for v in values if v is not None], dtype=object).value_counts()
        want = sorted(counted.items(), key=lambda x: (-x[1], x[0].encode()))[:3]
        assert unique[name] == len(counted)
        assert sorted(got.get(name, [])) == [(i, v, n) for i, (v, n) in enumerate(want, 1)]


def test_top_texts_move_digests_only(spark):
    df = spark.range(1000).select(F.concat(F.lit("long text "), F.repeat(F.col("id").cast("string"), 50)).alias("t"))
    plan = texts.digest_counts(df, ["t"])._jdf.queryExecution().executedPlan().toString()
    exchange = plan[plan.index("Exchange") :].splitlines()[0]
    assert "hashpartitioning(column" in exchange
    assert texts.digest_counts(df, ["t"]).columns == ["column", "digest", "count", "h0", "h1"]
