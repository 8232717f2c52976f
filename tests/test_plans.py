"""Profiles, automatic cleaning, recipes, history, audit, writers, catalog, streams."""

import json

import pytest
from pyspark.sql import functions as F

from tablewright import streaming
from tablewright.operators import audit, catalog, dedup, extract, profile
from tablewright.operators.missing import fill_mean
from tablewright.operators.text import add_category_codes, cast_values
from tablewright.plans.auto_clean import auto_clean
from tablewright.plans.history import CleaningSession
from tablewright.plans.recipe import PRESETS, Recipe, Step
from tablewright.session import materialize, scratch_dir
from tablewright.sources import writers
from tablewright.sources.pages import parse_pages
from tablewright.sources.writers import ExportOptions, write_dataset, write_formats, write_logged

IDS = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 1, 2]
NAMES = ["John Doe", "Jane Smith", "  Bob Johnson  ", "Alice Brown", "Charlie Wilson", "", None,
         "David Lee", "Eva Garcia", "Frank Miller", "John Doe", "Jane Smith"]
AGES = ["25", "30", "thirty", "35", "40", "", None, "45", "50", "999", "25", "30"]
SALARIES = ["50000", "60000.50", "$70,000", "80000", "90000", "", None, "100000", "110000",
            "1000000", "50000", "60000.50"]
STATUS = ["active", "INACTIVE", "Active", "inactive", "ACTIVE", "", None, "active", "inactive",
          "active", "active", "INACTIVE"]


@pytest.fixture(scope="module")
def messy(spark):
    rows = list(zip(IDS, NAMES, AGES, SALARIES, STATUS))
    return spark.createDataFrame(rows, "id bigint, name string, age string, salary string, status string")


@pytest.fixture(scope="module")
def history5(spark):
    rows = [(1, "a"), (2, "b"), (2, "b"), (3, "c"), (4, "d")]
    return spark.createDataFrame(rows, "col1 bigint, col2 string")


def test_quality(messy, spark):
    row = profile.quality_score(messy).first()
    missing, duplicates = 4 * 100 / 60, 2 * 100 / 12
    assert row["missing_percent"] == pytest.approx(missing, abs=1e-5)
    assert row["duplicate_percent"] == pytest.approx(duplicates, abs=1e-5)
    # salary and name have gaps or special characters; no column is numeric enough but none of them
    assert row["inconsistent_columns"] == 0
    assert row["outlier_columns"] == 0
    assert row["text_issues"] == 1
    assert row["overall_score"] == pytest.approx(100 - missing - duplicates - 2, abs=1e-5)
    assert row["band"] == "moderate"
    empty = profile.quality_score(messy.filter("id < 0")).first()
    assert empty["overall_score"] == 0.0 and "empty" in empty["issues"]


def test_infer_types_order_of_rules(spark):
    rows = [("1", "0", "2024-01-01", "yes", "x", "1.5", None)] * 5
    df = spark.createDataFrame(rows, "i string, b string, d string, w string, t string, f string, n string")
    found = {r["column"]: r["inferred_type"] for r in profile.infer_types(df).collect()}
    assert found == {
        "i": "integer", "b": "integer", "d": "datetime", "w": "boolean", "t": "string", "f": "float", "n": "string",
    }


def test_auto_clean_gentle(messy):
    cleaned, report = auto_clean(messy)
    assert (report.rows_before, report.rows_after, report.columns_after) == (12, 10, 5)
    assert cleaned.count() == 10
    names = {r["name"] for r in cleaned.collect()}
    assert "Bob Johnson" in names and None not in names


def test_auto_clean_aggressive(messy):
    cleaned, report = auto_clean(messy, aggressive=True)
    assert "removed outliers" in report.operations
    assert {r["status"] for r in cleaned.collect()} <= {"active", "inactive", ""}


def test_auto_clean_drops_empty(spark):
    df = spark.createDataFrame([(None, None, "7"), (None, None, None)], "a int, b string, c string")
    cleaned, report = auto_clean(df)
    assert cleaned.columns == ["c"] and cleaned.collect()[0]["c"] == 7
    assert report.rows_after == 1


def test_history(history5):
    session = CleaningSession(history5)
    session.apply("drop_duplicates")
    assert session.data.count() == 4
    session.apply("clean_text", columns=["col2"], operations=["uppercase"])
    assert session.undo().filter("col2 = 'a'").count() == 1
    assert session.undo().count() == 5
    with pytest.raises(ValueError):
        session.undo()
    session.redo()
    assert session.redo().filter("col2 = 'A'").count() == 1
    with pytest.raises(ValueError):
        session.redo()
    session.undo()
    session.apply("rename_columns", mapping={"col2": "x"})
    assert not session.can_redo() and session.data.columns == ["col1", "x"]
    assert [s.operation for s in session.recent_operations()] == ["drop_duplicates", "rename_columns"]
    assert session.to_recipe("r").run(history5).count() == 4
    assert session.reset().count() == 5 and not session.can_undo()


def test_history_keeps_every_step(history5):
    session = CleaningSession(history5, materialize_every=10)
    for i in range(25):
        session.apply("add_columns", expressions={f"c{i}": f"col1 + {i}"})
    recipe = session.to_recipe("long")
    assert len(recipe.steps) == 25
    assert sorted(map(tuple, recipe.run(history5).collect())) == sorted(map(tuple, session.data.collect()))
    steps = 0
    while session.can_undo():
        session.undo()
        steps += 1
    assert steps == 25 and session.data.columns == history5.columns


def test_history_writes_at_a_steady_pace(history5, monkeypatch):
    from tablewright.plans import history

    written = []
    monkeypatch.setattr(history, "materialize", lambda df, label: written.append(label) or df)
    session = CleaningSession(history5, materialize_every=3)
    for _ in range(40):
        session.apply("filter_rows", condition="col1 > 0")
    assert len(written) == 13


def test_types_are_judged_by_all_values(spark):
    rows = [(i, "2024-01-01" if i < 120 else "some words", "yes" if i < 400 else "2024-01-01") for i in range(1000)]
    df = spark.createDataFrame(rows, "i int, late string, other string").coalesce(1)
    found = {r["column"]: r["inferred_type"] for r in profile.infer_types(df).collect()}
    assert found == {"late": "string", "other": "string"}
    assert profile.apply_inferred_types(df).filter("late is null").count() == 0


def test_recipe_round_trip(history5):
    recipe = Recipe("r", [Step("drop_duplicates"), Step("filter_rows", {"condition": "col1 > 1"})], tags=["t"])
    again = Recipe.from_json(recipe.to_json())
    assert again == recipe
    assert again.run(history5).count() == 3
    with pytest.raises(ValueError):
        Recipe("x", [Step("nope")]).run(history5)
    for steps in PRESETS.values():
        assert Recipe("preset", steps).run(history5).count() == 4 or steps[0].operation == "drop_empty_rows"


def test_audit(messy):
    keyed = messy.withColumn("row", F.monotonically_increasing_id())
    keyed = materialize(keyed, "keyed")
    recipe = Recipe(
        "r",
        [
            Step("clean_text", {"columns": ["status"], "operations": ["lowercase"]}),
            Step("handle_missing", {"strategy": "drop", "columns": ["name"]}),
            Step("drop_duplicates", {"subset": ["id"], "order_by": ["row"]}),
        ],
    )
    out, steps = recipe.run_with_audit(keyed, ["row"])
    assert [r["records_affected"] for r in steps.orderBy("step").collect()] == [4, 1, 2]
    assert out.count() == 9
    assert json.loads(steps.orderBy("step").first()["parameters"])["operations"] == ["lowercase"]


def test_audit_runs_every_step_once(spark):
    """Ten steps in one plan: the input is read once, and there is one writing job."""
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame([(i, f" Name {i % 7}  x", None if i % 5 else "v", float(i)) for i in range(100)], "k int, name string, v string, x double")
    df = df.mapInArrow(counted, df.schema)
    steps = [
        Step("clean_text", {"columns": ["name"], "operations": ["remove_extra_spaces"]}),
        Step("clean_text", {"columns": ["name", "v"], "operations": ["lowercase"]}),
        Step("filter_rows", {"condition": "k < 90"}),
        Step("add_columns", {"expressions": {"y": "x * 2"}}),
        Step("handle_missing", {"strategy": "fill_custom", "fill_value": "none", "columns": ["v"]}),
        Step("rename_columns", {"mapping": {"name": "title"}}),
        Step("clean_text", {"columns": ["title"], "operations": ["uppercase"]}),
        Step("fix_encoding"),
        Step("filter_rows", {"condition": "y >= 20"}),
        Step("drop_columns", {"columns": ["x"]}),
    ]
    spark.sparkContext.setJobGroup("audit", "ten steps")
    out, audit_rows = Recipe("ten", steps).run_with_audit(df, ["k"])
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("audit")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 1 and reads.value == 100
    rows = audit_rows.orderBy("step").collect()
    assert [r["records_affected"] for r in rows] == [100, 100, 10, 0, 72, 0, 90, 0, 10, 0]
    assert out.count() == 80 and out.columns == ["k", "title", "v", "y"]


def test_audit_of_steps_that_need_the_table(spark):
    df = spark.createDataFrame([(i, float(i) if i % 4 else None, "a" if i < 3 else f"t{i % 8}") for i in range(40)], "k int, x double, t string")
    steps = [
        Step("handle_missing", {"strategy": "fill_mean", "columns": ["x"]}),
        Step("drop_duplicates", {"subset": ["t"], "order_by": ["k"]}),
        Step("filter_rows", {"condition": "k > 1"}),
        Step("handle_missing", {"strategy": "forward_fill", "order_by": ["k"], "columns": ["x", "t"]}),
    ]
    recipe = Recipe("mixed", steps)
    out, audit_rows = recipe.run_with_audit(df, ["k"])
    assert [r["records_affected"] for r in audit_rows.orderBy("step").collect()] == [10, 31, 1, 0]
    assert sorted(out.collect()) == sorted(recipe.run(df).collect())
    empty, audit_rows = recipe.run_with_audit(df.limit(0))
    assert empty.count() == 0 and [r["records_affected"] for r in audit_rows.collect()] == [0, 0, 0, 0]
    same, none = Recipe("nothing").run_with_audit(df)
    assert same.count() == 40 and none.count() == 0


def test_history_of_change_sets(spark):
    """A version reads one base and one folder of changes, however many steps; undo and redo of any step are exact."""
    n = 60
    rows = [(i if i else None, f" name {i % 9} ", float(i) if i % 5 else None, [float("nan")] if i % 7 else None) for i in range(n)]
    df = materialize(spark.createDataFrame(rows, "k int, t string, x double, a array<double>"), "start")
    session = CleaningSession(df, key=["k"])
    steps = [
        ("clean_text", {"columns": ["t"], "operations": ["remove_numbers"]}),  # all rows: a new base
        ("filter_rows", {"condition": "k is null or k % 11 > 0"}),
        ("handle_missing", {"strategy": "fill_custom", "fill_value": 0, "columns": ["x"]}),
        ("filter_rows", {"condition": "k is null or k < 58"}),
        ("remove_outliers", {"columns": ["x"], "method": "zscore", "threshold": 1.65}),
        ("handle_missing", {"strategy": "fill_custom", "fill_value": -1, "columns": ["k"]}),
        ("rename_columns", {"mapping": {"t": "title"}}),
        ("filter_rows", {"condition": "k % 2 = 0 or k > 20"}),
        ("standardize_formats", {"rules": {"title": {"type": "regex", "pattern": "^ name *$", "replacement": "N"}}}),
    ]

    def content(table):
        return sorted(map(str, table.collect()))

    plain, versions = df, [content(df)]
    for operation, parameters in steps:
        if operation == "handle_missing" and parameters["columns"] == ["k"]:
            continue
        plain = materialize(Step(operation, parameters).apply(plain), "plain")
        session.apply(operation, **parameters)
        versions.append(content(plain))
    for i in range(40, 48):
        session.apply("filter_rows", condition=f"k is null or k <> {i}")
        plain = plain.filter(f"k is null or k <> {i}")
        versions.append(content(plain))
    assert content(session.data) == versions[-1]
    scans = session.data._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    assert scans == 2
    for want in versions[-2::-1]:
        if len(want) % 3 or want is versions[0]:
            assert content(session.undo()) == want
        else:
            session.undo()
    assert not session.can_undo()
    for want in versions[1:4]:
        assert content(session.redo()) == want
    session.apply("filter_rows", condition="k = 3")
    assert not session.can_redo() and session.data.count() == 1
    assert content(session.reset()) == versions[0]


def test_diff(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1)], "k int, s string, n int")
    new = spark.createDataFrame([(1, "a", None), (2, "B", 1), (4, "d", 1)], "k int, s string, n int")
    got = sorted(tuple(r) for r in audit.diff_tables(old, new, ["k"]).collect())
    assert got == [
        (2, "changed", "s", "b", "B"),
        (3, "removed", "n", "1", None),
        (3, "removed", "s", "c", None),
        (4, "added", "n", None, "1"),
        (4, "added", "s", None, "d"),
    ]


def test_scratch_comes_from_the_session(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    assert configured is None or scratch_dir(spark) == configured.rstrip("/")


def test_writers(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, "x, \"y\"\nz", 0.125, None), (2, "", -3.0, "é<&>")], "id int, t string, v double, n string"
    )
    base = str(tmp_path / "out")
    assert write_dataset(df, base + ".csv") == "csv"
    back = writers.read_dataset(spark, base + ".csv", "csv", "id int, t string, v string, n string")
    rows = {r["id"]: (r["t"], r["v"], r["n"]) for r in back.collect()}
    assert rows == {1: ('x, "y"\nz', "0.12", None), 2: ("", "-3.00", "é<&>")}
    write_dataset(df, base + ".html")
    html = "".join(r["value"] for r in writers.read_dataset(spark, base + ".html", "html").collect())
    assert "é&lt;&amp;&gt;" in html
    with pytest.raises(ValueError):
        write_dataset(df.filter("id > 9"), base + "2.csv")
    for bad in (ExportOptions(encoding="ebcdic"), ExportOptions(json_orient="x"), ExportOptions(format="xlsx")):
        with pytest.raises(ValueError):
            write_dataset(df, base + "3.csv", bad)
    with pytest.raises(ValueError):
        write_dataset(df, base + ".docx")
    with pytest.raises(ValueError):
        write_dataset(df, base + "4.json", ExportOptions(json_orient="index"))


def test_json_layouts(spark):
    df = spark.createDataFrame([(7, "a", None)], "id int, s string, n int")
    line = lambda orient: writers.json_lines(df, orient, "id" if orient in ("index", "split") else None).first()[0]
    assert json.loads(line("records")) == {"id": 7, "s": "a", "n": None}
    assert json.loads(line("values")) == [7, "a", None]
    assert json.loads(line("index")) == {"7": {"s": "a", "n": None}}
    assert json.loads(line("split")) == [7, ["a", None]]


def test_several_formats_and_log(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "id int")
    results = write_formats(df, str(tmp_path / "d"), ["parquet", "nosuch", "xml"])
    assert results["parquet"] is None and results["xml"] is None and results["nosuch"]
    log = str(tmp_path / "log")
    assert write_logged(df, str(tmp_path / "e.json"), log)
    assert not write_logged(df, str(tmp_path / "e.json"), log)  # exists already
    rows = spark.read.parquet(log).orderBy("timestamp").collect()
    assert [(r["success"], r["records_exported"]) for r in rows] == [(True, 2), (False, 0)]


def test_catalog(spark):
    df = spark.createDataFrame(
        [("a", "First", ["Red"], "2024-01-05"), ("b", None, ["blue", "red"], "2024-02-01"), ("c", "x", [], "bad")],
        "name string, description string, tags array<string>, created_date string",
    )
    found = catalog.search_catalog(df, " RED ", ["name", "description", "tags", "url"])
    assert sorted(r["name"] for r in found.collect()) == ["a", "b"]
    assert catalog.search_catalog(df, " ", ["name"]).count() == 3
    months = {r["month"]: r["projects"] for r in catalog.per_month(df).collect()}
    assert months == {"2024-01": 1, "2024-02": 1}
    assert catalog.top_tags(df, n=1).first()["tag"] == "Red"


def test_category_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "t string")
    got = {r["t"]: r["code"] for r in add_category_codes(df, "t", "code").collect()}
    assert got == {"a": 0, "b": 1, None: -1}


def test_stream_of_row_local_steps(spark, tiny):
    schema = spark.read.parquet(f"{tiny}/pages.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{tiny}/pages.parquet*")
    recipe = Recipe(
        "s",
        [
            Step("clean_text", {"columns": ["html"], "operations": ["remove_html_tags"]}),
            Step("rename_columns", {"mapping": {"html": "body"}}),
        ],
    )
    out = streaming.run_on_stream(stream, recipe)
    query = out.writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    query.awaitTermination(60)
    batch = recipe.run(spark.read.parquet(f"{tiny}/pages.parquet"))
    assert sorted(r["body"] for r in spark.table("cleaned").collect()) == sorted(r["body"] for r in batch.collect())
    with pytest.raises(ValueError):
        streaming.run_on_stream(stream, Recipe("s", [Step("auto_clean")]))
    for operator in (fill_mean, dedup.drop_duplicates, profile.quality_score):
        with pytest.raises(ValueError):
            operator(stream)


def test_duplicates_on_a_stream(spark, tmp_path):
    """Late rows, expired keys, and a restart from the checkpoint with the state it kept."""
    source, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    schema = "k string, ts timestamp, v int"

    def arrive(*rows):
        spark.createDataFrame(rows, "k string, ts string, v int").selectExpr("k", "timestamp('2024-01-01 ' || ts) AS ts", "v").coalesce(1).write.mode("append").parquet(source)
        stream = streaming.drop_stream_duplicates(streaming.read_stream(spark, source, schema, files_a_batch=1), ["k"], "ts", "10 minutes")
        query = streaming.write_batches(stream, out, checkpoint)
        assert query.awaitTermination(120)

    arrive(("a", "00:00:00", 1), ("b", "00:01:00", 2), ("a", "00:02:00", 3))
    kept = streaming.read_batches(spark, out).filter("k = 'a'").first()["v"]
    # a restart: the key is remembered; NULL is a key
    arrive(("a", "00:03:00", 4), (None, "00:04:00", 5), (None, "00:04:30", 5))
    rows = [(r["k"], r["v"]) for r in streaming.read_batches(spark, out).collect()]
    assert sorted(rows, key=str) == sorted([("a", kept), ("b", 2), (None, 5)], key=str)
    # far ahead: the watermark moves to 00:50, which forgets all keys
    arrive(("c", "01:00:00", 6))
    arrive(("late", "00:05:00", 7), ("a", "00:55:00", 8))
    rows = [(r["k"], r["v"]) for r in streaming.read_batches(spark, out).collect()]
    assert sorted(rows, key=str) == sorted([("a", kept), ("b", 2), (None, 5), ("c", 6), ("a", 8)], key=str)


def test_pages_stream_into_parquet(spark, tiny, tmp_path):
    """Parsed and extracted in micro-batches, equal to the batch result."""
    source, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    pages = spark.read.parquet(f"{tiny}/pages.parquet")
    pages.repartition(3).write.parquet(source)

    def extracted(table):
        return extract.extract_records(parse_pages(table, keep=["page_id", "url"]), ["h1", "div", "p"])

    stream = extracted(streaming.read_stream(spark, source, pages.schema, files_a_batch=1))
    assert streaming.write_batches(stream, out, checkpoint).awaitTermination(120)
    want = sorted(map(str, extracted(pages).collect()))
    assert sorted(map(str, streaming.read_batches(spark, out).collect())) == want
    # nothing new: nothing written again
    assert streaming.write_batches(stream, out, checkpoint).awaitTermination(120)
    assert sorted(map(str, streaming.read_batches(spark, out).collect())) == want


def test_steps_of_values_on_a_stream(spark, tmp_path):
    rows = [(i, str(i) if i % 3 else "1.5", ["yes", "no", "maybe"][i % 3], None if i % 4 else "2024-01-0%d" % (1 + i % 9)) for i in range(30)]
    table = spark.createDataFrame(rows, "k int, n string, b string, d string")
    table.repartition(2).write.parquet(str(tmp_path / "in"))
    recipe = Recipe(
        "values",
        [
            Step("handle_missing", {"strategy": "fill_custom", "fill_value": "2024-02-01", "columns": ["d"]}),
            Step("cast_values", {"mapping": {"n": "integer", "b": "boolean", "d": "datetime"}}),
            Step("handle_missing", {"strategy": "drop", "columns": ["b"]}),
        ],
    )
    stream = streaming.run_on_stream(streaming.read_stream(spark, str(tmp_path / "in"), table.schema), recipe)
    assert streaming.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    got = sorted(streaming.read_batches(spark, str(tmp_path / "out")).collect(), key=str)
    assert got == sorted(recipe.run(table).collect(), key=str) and len(got) == 20
    assert {r["n"] for r in got if r["k"] % 3 == 0} == {None} and got[0]["d"] is not None
    # whole-table operators on each micro-batch
    stream = streaming.read_stream(spark, str(tmp_path / "in"), table.schema)
    query = streaming.write_batches(stream, str(tmp_path / "out2"), str(tmp_path / "c2"), lambda batch: dedup.drop_duplicates(batch, ["b"], "first", ["k"]))
    assert query.awaitTermination(120)
    assert sorted(r["b"] for r in streaming.read_batches(spark, str(tmp_path / "out2")).collect()) == ["maybe", "no", "yes"]
    with pytest.raises(ValueError):
        recipe = Recipe("s", [Step("handle_missing", {"strategy": "fill_mean"})])
        streaming.run_on_stream(stream, recipe)
    with pytest.raises(ValueError):
        cast_values(table, {"n": "nonsense"})


def test_writers_honour_or_refuse_options(spark, tmp_path):
    from tablewright.sources.writers import ExportOptions, write_dataset

    df = spark.createDataFrame([(1, "é", 1.5)], "`a`` b` int, `<t>` string, x double")
    write_dataset(df, str(tmp_path / "a.csv"))
    write_dataset(df, str(tmp_path / "a.json"), ExportOptions(encoding="latin-1"))
    raw = b"".join(p.read_bytes() for p in (tmp_path / "a.json" / "data").glob("part-*"))
    assert '"é"'.encode("latin-1") in raw
    write_dataset(df, str(tmp_path / "a.html"))
    head = b"".join(p.read_bytes() for p in (tmp_path / "a.html" / "header").glob("part-*"))
    assert b"&lt;t&gt;" in head
    for name, options in (("b.html", {"encoding": "utf-16"}), ("b.xml", {"compression": "gzip"}), ("b.csv", {"partition_by": ("x",)}), ("b.json", {"encoding": "latin-1", "json_orient": "values"})):
        with pytest.raises(ValueError):
            write_dataset(df, str(tmp_path / name), ExportOptions(**options))
