"""Extraction from small pages written by hand, and a brute-force check of nesting."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tablewright.operators import admission, extract, union
from tablewright.sources import page_parser, writers
from tablewright.sources.page_parser import PageParser, lay_out
from tablewright.sources.pages import parse_pages, read_pages
from workload import all_queries, views

PAGE = """<html><head><title>T</title><style>p{}</style></head><body>
<ul class="menu"><li>one</li><li> two <b>bold</b></li><li> </li><li>outer<ol><li>inner</li></ol></li></ul>
<div class="a  b" id="x">Hello <i>big</i> world<!-- c -->!</div><div></div>
<p>first<p>second <br>more</p><span>s &amp; t</span>
<script>var rows = [{"a": 1, "b": {"c": "x"}}, {"a": 2.5}]; let bad = [1,]; window.w = [];</script>
<script>go({"data": [{"a": 9}]}); const ok = [3];</script></body></html>"""


def pages(spark, *html):
    rows = [(i, f"http://h.org/d/p{i}?page=1", h) for i, h in enumerate(html)]
    return spark.createDataFrame(rows, "page_id int, url string, html string")


def test_lists(spark):
    got = extract.extract_list_items(parse_pages(pages(spark, PAGE))).orderBy("list_idx", "item_idx")
    found = [(r["list_idx"], r["item"]) for r in got.collect()]
    assert found == [(0, "one"), (0, "twobold"), (0, "outerinner"), (0, "inner"), (1, "inner")]


def test_elements(spark):
    tags = ["span", "div", "p", "table", "script"]
    got = extract.extract_elements(parse_pages(pages(spark, PAGE)), tags).orderBy("element_idx").collect()
    found = [(r["element_type"], r["content"], r["class"], r["id"]) for r in got]
    assert found[:2] == [("span", "s & t", "", ""), ("div", "Hellobigworld!", "a b", "x")]
    assert found[2:4] == [("p", "firstsecondmores & t", "", ""), ("p", "secondmore", "", "")]
    assert [f[0] for f in found[4:]] == ["script", "script"]


def test_unclosed_paragraphs_by_brute_force(spark, tiny):
    """Each open <p> holds all text up to the end of what encloses it."""
    html = spark.read.parquet(f"{tiny}/pages.parquet").select("page_id", "html").collect()
    expected = {(r["page_id"], *p) for r in html for p in paragraphs_by_hand(r["html"])}
    got = all_queries()["extract_paragraphs"](spark, tiny).filter("element_type = 'p'").collect()
    assert {(r["page_id"], r["element_idx"], r["content"]) for r in got} == expected


def paragraphs_by_hand(source):
    """Walks the tags with a stack of its own, one text list per open element."""
    from html import unescape

    source = re.sub(r"(?s)<(script|style)[^>]*>.*?</\1>", "<!-- -->", source)
    done, stack, order = {}, [], 0
    for token in re.findall(r"(?s)<!--.*?-->|<[^>]+>|[^<]+", source):
        name = re.match(r"</?([a-z0-9]+)", token)
        if token.startswith("</"):
            if any(tag == name[1] for tag, _, _ in stack):
                while stack[-1][0] != name[1]:
                    close(stack.pop(), done)
                close(stack.pop(), done)
        elif name and name[1] not in ("br", "meta"):
            stack.append((name[1], order if name[1] == "p" else None, []))
            order += name[1] == "p"
        elif not token.startswith("<"):
            for _, _, texts in stack:
                texts.append(unescape(token).strip())
    while stack:
        close(stack.pop(), done)
    kept = [(i, done[i]) for i in sorted(done) if done[i]]
    return [(position, text) for position, (_, text) in enumerate(kept)]


def close(entry, done):
    tag, number, texts = entry
    if tag == "p":
        done[number] = "".join(texts)


TABLES = """<table><tr><th>Nation Key!</th><th> N Name </th><th></th><th>N Name</th></tr>
<tr><td>1</td><td>A  B</td><td>x</td><td>1,234</td></tr><tr><td>2</td><td>n/a<td>y</tr></table>
<table><thead><tr><th>only header</th></tr></thead></table>
<table><tr><td>k</td><td>v</td></tr><tr><td rowspan=2>r</td><td>1</td></tr><tr><td>2</td></tr>
<tr><td colspan="2">wide</td></tr></table>
<table><tr><th>o</th></tr><tr><td>out <table><tr><th>i</th></tr><tr><td>in</td></tr></table></td></tr></table>"""


def test_table_cells(spark):
    cells = extract.extract_table_cells(parse_pages(pages(spark, TABLES)))
    got = cells.orderBy("table_idx", "row_idx", "col_idx").collect()
    by_table = {}
    for r in got:
        by_table.setdefault(r["table_idx"], []).append((r["row_idx"], r["name"], r["value"]))
    assert by_table[0] == [
        (0, "nation_key", "1"), (0, "n_name", "A B"), (0, "unnamed_2", "x"), (0, "n_name1", "1,234"),
        (1, "nation_key", "2"), (1, "n_name", None), (1, "unnamed_2", "y"), (1, "n_name1", None),
    ]
    assert by_table[1] == [
        (0, "k", "r"), (0, "v", "1"), (1, "k", "r"), (1, "v", "2"), (2, "k", "wide"), (2, "v", "wide"),
    ]
    assert by_table[2] == [(0, "o", "out iin")]
    assert by_table[3] == [(0, "i", "in")]


def test_table_rows_typed(spark):
    parsed = parse_pages(pages(spark, TABLES), fields=["tables"])
    got = extract.extract_table_rows(parsed, "nation_key int, n_name1 double").orderBy("row_idx")
    assert [tuple(r)[1:] for r in got.collect()] == [(0, 0, 1, 1234.0), (0, 1, 2, None)]


def test_spans():
    assert lay_out([[("a", 1, 3), ("b", 2, 1)], [("c", 1, 1)]]) == [
        ["a", "b", "b"], ["a", "c"],
    ]


def test_embedded_json(spark):
    records = extract.extract_embedded_json(parse_pages(pages(spark, PAGE)))
    flat = extract.flatten_records(records).orderBy("script_idx", "row_idx")
    assert flat.columns[-2:] == ["a", "b.c"]
    assert [(float(r["a"]), r["b.c"]) for r in flat.collect()] == [(1.0, "x"), (2.5, None), (9.0, None)]


def test_pagination(spark):
    html = """<a href="?page=2">2</a><a href="?page=1">self</a><div class="pagination x"><b><a href="n/3">3</a></b></div>
<a href="q">Next <i>one</i></a><a href="r" rel="next">r</a><a>none</a><a href="/off?offset=5">o</a>"""
    parsed = parse_pages(pages(spark, html), keep=["page_id", "url"])
    got = extract.pagination_links(parsed).orderBy("link_idx").collect()
    assert [r["link"].removeprefix("http://h.org") for r in got] == [
        "/d/p0?page=2", "/off?offset=5", "/d/n/3", "/d/q", "/d/r",
    ]
    assert extract.pagination_links(parsed, max_pages=3).count() == 2
    with pytest.raises(ValueError):
        extract.pagination_links(parsed, max_pages=0)


def test_report(spark):
    got = extract.extract_report(parse_pages(pages(spark, PAGE, "<b>x</b>", "", TABLES), fields=list(
        ("nodes", "texts", "tables", "error")))).orderBy("page_id").collect()
    assert [r["status"] for r in got] == ["SUCCESS", "NO_DATA", "NO_DATA", "SUCCESS"]
    assert got[0]["total_records"] == 7
    assert got[1]["warnings"] == ["No structured data found on the page"]
    assert got[3]["total_records"] == 7
    assert "nation_key" in got[3]["columns"]


def test_records_in_one_pass(spark):
    parsed = parse_pages(pages(spark, PAGE, TABLES))
    found = extract.record_columns(extract.extract_records(parsed, ["div"]), ["item", "content", "k"])
    assert found.filter("source = 'list'").count() == 5
    assert found.filter("k IS NOT NULL").count() == 3
    assert found.filter("content = 'Hellobigworld!'").count() == 1


def test_parser_survives_anything():
    for html in ["<", "<p", "</p>", "<a b='", "<!DOCTYPE", "<![CDATA[x]]>", "\0", "<script>", "<td><tr>"]:
        page = PageParser(html)
        assert all(n["pos"] < n["end"] <= len(page.nodes) for n in page.nodes)


def test_content_type(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("<SCRIPT>",), ("plain",), ("uses jQuery",)], "h string")
    got = [r[0] for r in df.select(extract.content_type(F.col("h"))).collect()]
    assert got == ["dynamic", "static", "dynamic"]


def test_read_text_pages(spark, tmp_path):
    (tmp_path / "a.html").write_text("<ul><li>x</li></ul>")
    found = extract.extract_list_items(parse_pages(read_pages(spark, str(tmp_path), "text")))
    assert [r["item"] for r in found.collect()] == ["x"]


@pytest.mark.parametrize("broadcast_limit", [64 << 20, 0])
def test_admission(spark, monkeypatch, broadcast_limit):
    monkeypatch.setattr(admission, "MAX_BROADCAST_BYTES", broadcast_limit)
    rules = spark.createDataFrame(
        [
            ("h.org", "*", 1, True, "/open/"),
            ("h.org", "*", 2, False, "/"),
            ("own.org", "*", 1, False, "/"),
            ("own.org", "MyBot", 2, False, "/private"),
            ("free.org", "*", 1, False, ""),
        ],
        "host string, agent string, seq int, allow boolean, path_prefix string",
    )
    urls = [
        "http://h.org/open/x", "http://H.org/closed", "http://own.org/any", "http://own.org/private/x",
        "http://free.org/x", "http://unknown.org/x", "http://h.org",
    ]
    frontier = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    got = admission.admit_urls(frontier, rules, "mybot/2.0").orderBy("i").collect()
    assert [r["allowed"] for r in got] == [True, False, True, False, True, True, False]


def test_unions(spark):
    a = spark.createDataFrame([(1, "x")], "b int, a string")
    b = spark.createDataFrame([("y", 2)], "a string, b int")
    c = spark.createDataFrame([(3, "z")], "d int, b string")
    assert union.unify([a]).columns == ["b", "a"]
    assert union.unify([a, b]).columns == ["b", "a"]
    mixed = union.unify([a, c, b])
    assert mixed.columns == ["a", "b", "d"]
    assert sorted(r["b"] for r in mixed.collect()) == ["1", "2", "z"]
    assert union.combine_pages([c, a]).columns == ["d", "b", "a"]
    with pytest.raises(ValueError):
        union.unify([])


def test_all_pagination_links_by_default(spark):
    from tablewright.sources.pages import parse_pages

    anchors = "".join(f'<a href="/list?page={i}">{i}</a>' for i in range(2, 3002))
    html = f'<html><body><div class="pagination">{anchors}</div></body></html>'
    df = spark.createDataFrame([(1, "http://a.example/list", html)], "page_id long, url string, html string")
    links = extract.pagination_links(parse_pages(df, keep=["page_id", "url"]))
    assert links.count() == 3000


def test_repeated_headers_get_free_numbers(spark):
    from tablewright.sources.pages import parse_pages

    html = "<table><tr><th>a</th><th>a</th><th>a1</th></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>"
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    cells = {r["name"]: r["value"] for r in extract.extract_table_cells(parse_pages(df)).collect()}
    assert cells == {"a": "1", "a1": "2", "a11": "3"}


def test_huge_spans_stay_small(spark):
    from tablewright.sources.pages import parse_pages

    html = '<table><tr><th colspan="1000000000">a</th></tr><tr><td rowspan="999999999">x</td></tr><tr><td>y</td></tr></table>'
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    rows = extract.extract_table_cells(parse_pages(df)).filter("value is not null").collect()
    assert [(r["row_idx"], r["col_idx"], r["value"]) for r in rows] == [(0, 0, "x"), (1, 0, "x"), (1, 1, "y")]


def test_record_schema_keeps_field_names(spark):
    text = '{"AVOIDED": 1, "VARIANT": [1, "a"], "b": {"VOID": "x", "c": null}, "d, VOID>": [{"OBJECT": 1}]}'
    df = spark.createDataFrame([(text,)], "record string")
    schema = extract.record_schema(df)
    assert sorted(schema.names) == ["AVOIDED", "VARIANT", "b", "d, VOID>"]
    assert schema["b"].dataType.simpleString() == "struct<VOID:string,c:string>"


def test_many_rules_of_one_host(spark):
    """A host with 200,000 rules: decided by prefix keys, and no row holds a host's rules."""
    rules = spark.range(200_000).select(
        F.lit("Big.example.com").alias("host"), F.lit("*").alias("agent"), F.col("id").cast("int").alias("seq"),
        (F.col("id") % 2 == 0).alias("allow"), F.concat(F.lit("/p"), F.col("id").cast("string")).alias("path_prefix"),
    )
    extra = spark.createDataFrame(
        [("named.com", "*", 1, False, "/"), ("named.com", "mybot", 2, True, "/a"), ("named.com", "mybot", 1, False, "/a/b"), ("free.com", "mybot", 5, False, "")],
        "host string, agent string, seq int, allow boolean, path_prefix string",
    )
    sites = ["https://big.example.com/p", "https://named.com/a/b/c", "https://named.com/x", "https://free.com/q", "https://none.com/", None]
    frontier = spark.range(3_000).select(F.col("id").alias("i"), F.concat(F.lit(sites[0]), (F.col("id") * 67).cast("string")).alias("url"))
    frontier = frontier.unionByName(spark.createDataFrame(list(enumerate(sites[1:], 5000)), "i bigint, url string"))
    got = {r["i"]: r["allowed"] for r in admission.admit_urls(frontier, rules.unionByName(extra), "mybot/2.0").collect()}
    for i in range(0, 3_000, 37):
        number = str(i * 67)
        firsts = [int(number[:n]) for n in range(1, len(number) + 1) if str(int(number[:n])) == number[:n] and int(number[:n]) < 200_000]
        assert got[i] == (min(firsts) % 2 == 0)
    assert [got[i] for i in range(5000, 5005)] == [False, True, True, True, True]
    fitting = admission._fitting(rules, "mybot")
    plan = admission._decided_by_prefix(frontier, fitting, "url")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_records_of_any_shape(spark):
    """100,000 different headers in one table: no names are collected, shapes are a column."""
    cells = F.array(
        F.struct(F.concat(F.lit("name "), F.col("id").cast("string")).alias("name"), F.lit("v").alias("value")),
        F.struct(F.lit("it's \"a\" key").alias("name"), F.col("id").cast("string").alias("value")),
        F.struct(F.lit("none").alias("name"), F.lit(None).cast("string").alias("value")),
    )
    records = spark.range(100_000).select("id", cells.alias("cells"))
    gathered = extract.gather_records(records)
    assert gathered.select("fingerprint").distinct().count() == 100_000
    got = extract.record_values(gathered, ["it's \"a\" key", "name 7", "none"]).filter("id = 7").first()
    assert tuple(got)[2:] == ("7", "v", None)
    with pytest.raises(ValueError):
        extract.unify_records(records)
    repeated = spark.createDataFrame([(1, [("b", "x"), ("a", None), ("b", "y")]), (2, [("a", "1"), ("b", "2")]), (3, [])], "id int, cells array<struct<name:string,value:string>>")
    rows = {r["id"]: r for r in extract.record_values(extract.gather_records(repeated), ["a", "b"]).collect()}
    assert rows[1]["fingerprint"] == rows[2]["fingerprint"] != rows[3]["fingerprint"]
    assert (rows[1]["a"], rows[1]["b"], rows[2]["b"], rows[3]["a"]) == (None, "x", "2", None)
    shapes = {tuple(r["names"]): (r["fingerprint"], r["rows"]) for r in extract.record_shapes(repeated).collect()}
    assert shapes == {("a", "b"): (rows[1]["fingerprint"], 2), (): (rows[3]["fingerprint"], 1)}


def test_pruned_pages_give_the_same_rows(spark, tiny):
    """Only wanted elements leave the parser; what is extracted from them does not change."""
    odd = ["<ul><li>a<ul class=x><li>b</li></ul><p>c</li></ul><div>d<script>var e</script><h1 id=i>f</div>", "", "<div><div></div>x</div>", None]
    every = spark.read.parquet(f"{tiny}/pages.parquet").select("page_id", "url", "html").unionByName(
        spark.createDataFrame([(-i, "u", h) for i, h in enumerate(odd, 1)] + [(-9, "u", PAGE)], "page_id bigint, url string, html string")
    )
    tags = ["h1", "div", "script"]
    whole = parse_pages(every)
    part = parse_pages(every, tags=[*tags, *extract.LIST_TAGS], attributes=extract.ELEMENT_ATTRIBUTES)
    for operator in (extract.extract_list_items, lambda p: extract.extract_elements(p, tags), lambda p: extract.extract_records(p, tags)):
        assert sorted(map(str, operator(part).collect())) == sorted(map(str, operator(whole).collect()))
    only = parse_pages(every, tags=["h1"], attributes=()).select(F.explode("nodes").alias("n")).select("n.tag", F.size("n.attrs"))
    assert {tuple(r) for r in only.distinct().collect()} == {("h1", 0)}


def test_plain_tags_are_read_like_any(tiny):
    """The short way for tags without attributes gives what the standard parser gives."""
    import duckdb

    class Slow(PageParser):
        parse_starttag = PageParser.__mro__[1].parse_starttag
        parse_endtag = PageParser.__mro__[1].parse_endtag

    pages_ = [r[0] for r in duckdb.sql(f"SELECT html FROM '{tiny}/pages.parquet'").fetchall()]
    pages_ += [PAGE, "<A><b></B></a >", "<script></p></script><p>", "<STYLE><b></STYLE>x", "<p<b>", "</>", "<br/>", "<x-y></x-y>", "<title><b></title>", "a<b", "</b", "<p>&lt;</p>&amp"]
    for page in pages_:
        fast, slow = PageParser(page), Slow(page)
        assert (fast.nodes, fast.texts, fast.tables()) == (slow.nodes, slow.texts, slow.tables())


def test_types_of_table_columns(spark):
    """Each table has types of its own; a name that several tables share gets their common one."""
    html = (
        "<table><tr><th>k</th><th>share</th><th>flag</th><th>none</th><th>mix</th></tr>"
        "<tr><td>1,000</td><td>1.5</td><td>True</td><td></td><td>7</td></tr>"
        "<tr><td>-2</td><td>n/a</td><td>false</td><td>NA</td><td>x</td></tr></table>"
        "<table><tr><th>k</th><th>flag</th></tr><tr><td>2.5</td><td>yes</td></tr></table><script>1</script>"
    )
    parsed = parse_pages(pages(spark, html), keep=["page_id", "html"])
    types = [(r["table_idx"], r["name"], r["type"]) for r in extract.table_column_types(parsed).orderBy("table_idx", "col_idx").collect()]
    assert types == [(0, "k", "integer"), (0, "share", "float"), (0, "flag", "boolean"), (0, "none", "float"), (0, "mix", "string"), (1, "k", "float"), (1, "flag", "string")]
    cells = {(r["table_idx"], r["row_idx"], r["name"]): (r["text"], r["number"], r["truth"]) for r in extract.extract_typed_cells(parsed).collect()}
    assert cells[0, 0, "k"] == (None, 1000.0, None) and cells[0, 1, "flag"] == (None, None, False)
    assert cells[0, 1, "share"] == cells[0, 0, "none"] == (None, None, None) and cells[0, 0, "mix"] == ("7", None, None)
    report = extract.extract_report(parsed, html="html").first()
    assert report["content_type"] == "dynamic"
    assert report["data_types"] == {"flag": "string", "k": "float", "mix": "string", "none": "float", "share": "float"}


def test_rows_are_dealt_by_the_size_of_their_files(spark, tmp_path):
    """A larger table has more parts, not longer tasks."""
    path = f"{tmp_path}/wide.parquet"
    spark.range(1_000_000).selectExpr("id", "sha2(cast(id as string), 256) AS text").coalesce(1).write.parquet(path)
    size = sum(f.stat().st_size for f in (tmp_path / "wide.parquet").glob("*.parquet"))
    found = views.dealt(spark.read.parquet(path))
    assert found.rdd.getNumPartitions() >= size // views.PART_BYTES > 16
    assert found.select("id").distinct().count() == 1_000_000


def test_plain_markup_is_read_like_any_other():
    class Slow(page_parser.PageParser):
        def _read_plain(self, html):
            return 0

    pieces = ["<p>", "</p>", "<TABLE>", "</table>", "<tr>", "<td>", "</td>", "<br>", "<script>", "</script>", "a<b", " x\n y ", "&amp;", "<td colspan=2>", "<!-- c -->", "</", "<style>", "<textarea>", "<li>", "<", "\u0130<\u0130>", "</script >"]
    draw = random.Random(5)
    for _ in range(3000):
        html = "".join(draw.choice(pieces) for _ in range(draw.randrange(14)))
        one, other = page_parser.PageParser(html), Slow(html)
        assert (one.nodes, one.texts, one.tables()) == (other.nodes, other.texts, other.tables()), html


def test_xml_files_hold_a_bounded_number_of_rows(spark, tmp_path):
    path = f"{tmp_path}/rows.xml"
    writers.write_dataset(spark.range(0, 120_000, 1, 1).selectExpr("id", "concat('x', id) AS text"), path)
    assert len([f for f in (tmp_path / "rows.xml").iterdir() if f.name.startswith("part-")]) == 3
    assert writers.read_dataset(spark, path, "xml", "id bigint, text string").distinct().count() == 120_000


def test_plain_scripts_are_read_like_others(monkeypatch):
    """Scripts without attributes need no general parser, and give what it gives; those with inner markup go to it."""
    plain = ["<p>x</p><script>let a = [1];</script><SCRIPT>if (a<b && c) d('&amp;');</Script>t<style></style>", "<b>a</b> <script> </script>"]
    odd = ["<script>a</b></script>c", "<script><!-- </script> --></script>", "<script>a</script >b", "<script>a", "<script>a</style></script><i>k", "<script>1</\u017fcript>2</script>", "a&amp;b<script>x</script>", "<p>q<script>1</script><script>2</p>", "<div><script>a</script><a href=x>l</a></div>"]
    read = lambda html: [(page.nodes, page.texts) for page in [page_parser.PageParser(html)]]
    found = [read(html) for html in plain + odd]
    with monkeypatch.context() as patch:
        patch.setattr(page_parser.PageParser, "_read_plain", lambda self, html: 0)
        assert [read(html) for html in plain + odd] == found
    monkeypatch.setattr(page_parser.PageParser, "feed", lambda self, html: pytest.fail(html))
    assert [read(html) for html in plain] == found[: len(plain)]


def test_embedded_json_of_odd_scripts(spark):
    """Every pattern, arrays without objects, escaped braces and broken text: only valid objects of the right pattern stay."""
    scripts = ["let a = [1, oops];", "var b = [];", 'const c = [{"k": 1}, 2];', "window.d = [{'k': 2}];", 'window.e = [{"k": 3}];', 'x = {"data": [{"k": 4}]}', 'data : [{"k": 5}', 'let f = ["\\u007bk"];', "nothing", "Var g = [{}];"]
    html = "".join(f"<script>{s}</script>" for s in scripts)
    found = extract.extract_embedded_json(parse_pages(pages(spark, html), fields=["nodes"])).orderBy("script_idx", "pattern_idx").collect()
    assert [(r.script_idx, r.pattern_idx, r.record) for r in found] == [(2, 2, '{"k":1}'), (4, 3, '{"k":3}'), (5, 5, '{"k":4}'), (7, 1, "{k")]
