"""Extraction from the page corpus and from pages built out of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions import urls
from tablewright.functions.names import clean_name_column
from tablewright.operators import extract
from tablewright.operators.admission import admit_urls
from tablewright.operators.dedup import drop_duplicates
from tablewright.operators.text import clean_text
from tablewright.operators.union import combine_pages, unify
from tablewright.sources.pages import parse_pages
from workload.views import dealt, read, with_view


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return dealt(read(spark, sf, "pages"))


def nav_item_counts(spark, sf):
    """Flagship: pages -> list items -> tidy text -> first page of each item, with its uses."""
    items = extract.extract_list_items(parse_pages(_pages(spark, sf), fields=["nodes", "texts"], tags=extract.LIST_TAGS, attributes=()))
    tidy = clean_text(items, ["item"], ["remove_extra_spaces"])
    order = ["page_id", "list_idx", "item_idx"]
    return drop_duplicates(tidy, ["item"], "first", order, copies="uses")


_ITEMS = """
WITH raw AS (
  SELECT page_id, unnest(regexp_extract_all(html, '<li><a[^>]*>([^<]*)</a></li>', 1)) AS item,
         generate_subscripts(regexp_extract_all(html, '<li><a[^>]*>([^<]*)</a></li>', 1), 1) - 1 AS item_idx
  FROM pages
), items AS (
  SELECT page_id, CAST(0 AS INTEGER) AS list_idx, CAST(item_idx AS INTEGER) AS item_idx,
         trim(replace(item, '&amp;', '&')) AS item
  FROM raw
)
"""


def _elements(spark, sf, tags):
    """Only the wanted elements leave the parser."""
    fields = ["nodes", "texts"]
    parsed = parse_pages(_pages(spark, sf), fields=fields, tags=tags, attributes=extract.ELEMENT_ATTRIBUTES)
    return extract.extract_elements(parsed, tags)


def _records(spark, sf):
    tags = ["h1", "div"]
    parsed = parse_pages(_pages(spark, sf), tags=[*tags, *extract.LIST_TAGS], attributes=extract.ELEMENT_ATTRIBUTES)
    return extract.extract_records(parsed, tags)


def list_items(spark, sf):
    return extract.extract_list_items(parse_pages(_pages(spark, sf), fields=["nodes", "texts"], tags=extract.LIST_TAGS, attributes=()))


def elements(spark, sf):
    return _elements(spark, sf, ["h1", "div"])


def paragraphs(spark, sf):
    return _elements(spark, sf, ["p", "footer"])


# a page may end an entity without its semicolon; it means the same
_TEXT_OF = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'),"
    " '&quot;?', '\"', 'g'), '&amp;?', '&', 'g'))"
)


def _order_tables(spark, sf) -> DataFrame:
    """One page per order with a table of two rows, the second written loosely."""
    orders = dealt(read(spark, sf, "orders"))
    row = F.concat(
        F.lit("<tr><td>"),
        F.col("o_orderkey").cast("string"),
        F.lit("</td><td> "),
        F.col("o_orderpriority"),
        F.lit(" </td><td>"),
        F.format_number(F.floor("o_totalprice"), 0),
        F.lit("</td></tr>"),
    )
    head = "<tr><th>Order Key!</th><th> O  Priority </th><th>Total ($)</th></tr>"
    gap = F.concat(
        F.lit("<tr><td>"), F.col("o_custkey").cast("string"), F.lit("<td>n/a<td></tr>")
    )
    html = F.concat(
        F.lit(f"<h2>x</h2><table><thead>{head}</thead>"), row, gap, F.lit("</table><table></table>")
    )
    return orders.select(F.col("o_orderkey").alias("page_id"), html.alias("html"))


def table_cells(spark, sf):
    return extract.extract_table_cells(parse_pages(_order_tables(spark, sf), fields=["tables"]))


def table_types(spark, sf):
    return extract.table_column_types(parse_pages(_order_tables(spark, sf), fields=["tables"]))


def typed_cells(spark, sf):
    return extract.extract_typed_cells(parse_pages(_order_tables(spark, sf), fields=["tables"]))


def table_rows(spark, sf):
    parsed = parse_pages(_order_tables(spark, sf), fields=["tables"])
    return extract.extract_table_rows(
        parsed, "order_key bigint, o_priority string, total_ double"
    )


def _event_scripts(spark, sf) -> DataFrame:
    """One page per event whose script holds the event as nested JSON data."""
    events = dealt(read(spark, sf, "events"))
    record = F.to_json(
        F.struct(
            "event_id",
            F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("kind")).alias("user"),
            "value",
        )
    )
    html = F.concat(
        F.lit("<p>x</p><script>let seen = [1, oops];\nvar rows = ["),
        record,
        F.lit("];</script><script>load({data: ["),
        record,
        F.lit("]});</script>"),
    )
    return events.select(F.col("event_id").alias("page_id"), html.alias("html"))


def embedded_json(spark, sf):
    records = extract.extract_embedded_json(parse_pages(_event_scripts(spark, sf), fields=["nodes"], tags=["script"], attributes=()))
    flat = extract.flatten_records(
        records, "event_id bigint, user struct<id bigint, kind string>, value double"
    )
    return flat.select(
        "page_id",
        "script_idx",
        "pattern_idx",
        "event_id",
        F.col("`user.id`").alias("user_id"),
        F.col("`user.kind`").alias("user_kind"),
        F.round("value", 6).alias("value"),
    )


def _pager(spark, sf) -> DataFrame:
    links = F.concat(
        F.lit('<div class="nav pager"><a href="?page=2">2</a><a href="/list/./'),
        F.col("page_id").cast("string"),
        F.lit('">x</a><a href="'),
        F.col("url"),
        F.lit('">self</a><a href="?page=2">again</a></div><a href="//cdn.example.org/p='),
        F.col("page_id").cast("string"),
        F.lit('">n</a><a href="/skip/../next/'),
        F.col("page_id").cast("string"),
        F.lit('" rel="next">go</a><a href="/forth?offset=9">Next</a>'),
    )
    return _pages(spark, sf).select("page_id", "url", F.concat("html", links).alias("html"))


def pagination(spark, sf):
    parsed = parse_pages(_pager(spark, sf), keep=["page_id", "url"])
    return extract.pagination_links(parsed, max_pages=5).select("page_id", "link_idx", "link")


def classify_pages(spark, sf):
    html = F.when(
        F.col("page_id") % 2 == 0, F.regexp_replace("html", "(?s)<script.*?</script>", "")
    ).otherwise(F.col("html"))
    return _pages(spark, sf).select("page_id", extract.content_type(html).alias("content_type"))


def robots(spark, sf):
    """Rules for every host of the corpus; blogs have a rule for the named agent."""
    pages = _pages(spark, sf)
    hosts = pages.select(urls.host_of(F.col("url")).alias("host")).distinct()
    rule = "named_struct('agent', '{}', 'seq', {}, 'allow', {}, 'path_prefix', '{}')"
    general = [rule.format("*", 1, "true", "/en/7"), rule.format("*", 2, "false", "/en/")]
    named = [rule.format("TestBot", 1, "false", "/de"), rule.format("TestBot", 2, "true", "/")]
    rules = hosts.select(
        "host",
        F.explode(
            F.when(
                F.col("host").startswith("blog."), F.expr(f"array({', '.join(general + named)})")
            ).otherwise(F.expr(f"array({', '.join(general)})"))
        ).alias("r"),
    ).select("host", "r.*")
    frontier = pages.select("page_id", "url")
    return admit_urls(frontier, rules, agent="testbot/1.0").select("page_id", "allowed")


def url_validate(spark, sf):
    mangled = F.when(
        F.col("page_id") % 3 == 0, F.regexp_replace("url", "^https?://", "")
    ).when(F.col("page_id") % 3 == 1, F.regexp_replace("url", "^https?://[^/]*", "http://")).otherwise(
        F.col("url")
    )
    return _pages(spark, sf).select(
        "page_id",
        urls.is_valid_url(mangled).alias("valid"),
        urls.with_scheme(mangled).alias("full_url"),
        urls.host_of(urls.with_scheme(mangled)).alias("host"),
    )


def resolve_links(spark, sf):
    parsed = parse_pages(_pages(spark, sf), keep=["page_id", "url"])
    anchors = F.transform(
        F.filter("nodes", lambda n: n["tag"] == "a"), lambda n: n["attrs"]["href"]
    )
    links = parsed.select("page_id", "url", F.posexplode(anchors).alias("link_idx", "href"))
    return links.select(
        "page_id", "link_idx", urls.resolve(F.col("url"), F.col("href")).alias("link")
    )


def report(spark, sf):
    """Every tenth page loses its navigation and boxes, so some pages are empty."""
    bare = F.regexp_replace("html", "(?s)<nav>.*?</nav>|<div.*?</div>", "")
    pages = _pages(spark, sf).select(
        "page_id", F.when(F.col("page_id") % 10 == 0, bare).otherwise(F.col("html")).alias("html")
    )
    return extract.extract_report(parse_pages(pages)).select(
        "page_id",
        "total_records",
        F.array_join("columns", ",").alias("columns"),
        "pages",
        F.size("errors").alias("errors"),
        F.array_join("warnings", ";").alias("warnings"),
        "status",
    )


def report_types(spark, sf):
    """Types of the columns that a page holds, and what kind of page it is."""
    tags = [*extract.DEFAULT_ELEMENTS, *extract.LIST_TAGS]
    parsed = parse_pages(_order_tables(spark, sf), keep=["page_id", "html"], tags=tags, attributes=extract.ELEMENT_ATTRIBUTES)
    found = extract.extract_report(parsed, html="html")
    pairs = F.transform(F.map_entries("data_types"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select("page_id", "content_type", F.array_join(F.array_sort(pairs), ",").alias("data_types"))


def unify_union(spark, sf):
    customer = read(spark, sf, "customer").select(
        F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_custkey").alias("customer_key"),
        F.col("c_nationkey").alias("nation"),
    )
    supplier = read(spark, sf, "supplier").select(
        F.col("s_name").alias("name"),
        F.col("s_acctbal").alias("balance"),
        F.col("s_suppkey").alias("supplier_key"),
        F.col("s_nationkey").cast("string").alias("nation"),
    )
    return unify([customer, supplier, customer])


def combine_union(spark, sf):
    """Columns in order of first appearance; the key differs in type."""
    part = read(spark, sf, "part").select(
        F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), "p_size"
    )
    nation = read(spark, sf, "nation").select(
        F.col("n_name").alias("name"), F.concat(F.lit("N"), "n_nationkey").alias("key"), "n_regionkey"
    )
    return combine_pages([part, nation])


def records(spark, sf):
    found = _records(spark, sf)
    return extract.record_columns(found, ["item", "element_type", "content"])


def records_wide(spark, sf):
    found = _records(spark, sf)
    return extract.unify_records(found)


def record_shapes(spark, sf):
    found = _records(spark, sf)
    return extract.record_shapes(found).select("fingerprint", F.array_join("names", ",").alias("names"), "rows")


def records_gathered(spark, sf):
    """Records of both shapes in one table of VARIANT objects, read by name."""
    found = _records(spark, sf)
    return extract.record_values(extract.gather_records(found), ["item", "element_type", "content"])


def normalize_names(spark, sf):
    """Names made of real texts: header data as a column."""
    header = F.when(F.col("doc_id") % 50 == 0, F.lit(" !? ")).otherwise(F.col("text"))
    documents = dealt(read(spark, sf, "documents"))
    return documents.select("doc_id", clean_name_column(header).alias("name"))


QUERIES = {
    "nav_item_counts": nav_item_counts,
    "extract_list_items": list_items,
    "extract_elements": elements,
    "extract_paragraphs": paragraphs,
    "extract_table_cells": table_cells,
    "extract_table_rows": table_rows,
    "table_column_types": table_types,
    "extract_typed_cells": typed_cells,
    "extract_embedded_json": embedded_json,
    "pagination_links": pagination,
    "classify_pages": classify_pages,
    "robots_admission": robots,
    "url_validate": url_validate,
    "resolve_links": resolve_links,
    "extract_report": report,
    "report_types": report_types,
    "unify_union": unify_union,
    "combine_union": combine_union,
    "extract_records": records,
    "records_wide": records_wide,
    "record_shapes": record_shapes,
    "records_gathered": records_gathered,
    "normalize_names": normalize_names,
}

_ELEMENTS = f"""
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY rank, i) - 1 AS INTEGER) AS element_idx,
  element_type, content, class, '' AS id
FROM (
  SELECT page_id, 1 AS rank, 'h1' AS element_type, '' AS class,
    {_TEXT_OF.format("unnest(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1))")} AS content,
    generate_subscripts(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1), 1) AS i FROM pages
  UNION ALL
  SELECT page_id, 2, 'div', unnest(regexp_extract_all(html, '<div class="([^"]*)">[^<]*</div>', 1)),
    {_TEXT_OF.format("unnest(regexp_extract_all(html, '<div[^>]*>([^<]*)</div>', 1))")},
    generate_subscripts(regexp_extract_all(html, '<div[^>]*>([^<]*)</div>', 1), 1) FROM pages
) WHERE content <> ''
"""

_BASE = "regexp_replace(url, '[?#].*$', '')"
_ORIGIN = "regexp_extract(url, '^(https?://[^/?#]*)', 1)"
_SPACE = r"\t-\r\x1c-\x20\x{85}\p{Z}"

ORACLES = {
    "nav_item_counts": _ITEMS
    + """
SELECT item, page_id, list_idx, item_idx, uses FROM (
  SELECT *, count(*) OVER (PARTITION BY item) AS uses,
    row_number() OVER (PARTITION BY item ORDER BY page_id, list_idx, item_idx) AS rn FROM items
) WHERE rn = 1
""",
    "extract_list_items": _ITEMS + "SELECT page_id, list_idx, item_idx, item FROM items",
    "extract_elements": _ELEMENTS,
    "extract_table_cells": """
SELECT page_id, CAST(0 AS INTEGER) AS table_idx, row_idx, col_idx, name, value FROM (
  SELECT o_orderkey AS page_id, CAST(0 AS INTEGER) AS row_idx, CAST(0 AS INTEGER) AS col_idx, 'order_key' AS name,
    CAST(o_orderkey AS VARCHAR) AS value FROM orders
  UNION ALL SELECT o_orderkey, 0, 1, 'o_priority', o_orderpriority FROM orders
  UNION ALL SELECT o_orderkey, 0, 2, 'total_', format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) FROM orders
  UNION ALL SELECT o_orderkey, 1, 0, 'order_key', CAST(o_custkey AS VARCHAR) FROM orders
  UNION ALL SELECT o_orderkey, 1, 1, 'o_priority', NULL FROM orders
  UNION ALL SELECT o_orderkey, 1, 2, 'total_', NULL FROM orders
)""",
    "table_column_types": """
SELECT o_orderkey AS page_id, CAST(0 AS INTEGER) AS table_idx, CAST(i AS INTEGER) AS col_idx,
  ['order_key', 'o_priority', 'total_'][i + 1] AS name, ['integer', 'string', 'float'][i + 1] AS type
FROM orders, (SELECT unnest([0, 1, 2]) AS i)""",
    "extract_typed_cells": """
SELECT page_id, CAST(0 AS INTEGER) AS table_idx, row_idx, col_idx, name, type, text, CAST(number AS DOUBLE) AS number, CAST(NULL AS BOOLEAN) AS truth FROM (
  SELECT o_orderkey AS page_id, CAST(0 AS INTEGER) AS row_idx, CAST(0 AS INTEGER) AS col_idx, 'order_key' AS name,
    'integer' AS type, NULL AS text, o_orderkey AS number FROM orders
  UNION ALL SELECT o_orderkey, 0, 1, 'o_priority', 'string', o_orderpriority, NULL FROM orders
  UNION ALL SELECT o_orderkey, 0, 2, 'total_', 'float', NULL, floor(o_totalprice) FROM orders
  UNION ALL SELECT o_orderkey, 1, 0, 'order_key', 'integer', NULL, o_custkey FROM orders
  UNION ALL SELECT o_orderkey, 1, 1, 'o_priority', 'string', NULL, NULL FROM orders
  UNION ALL SELECT o_orderkey, 1, 2, 'total_', 'float', NULL, NULL FROM orders
)""",
    "report_types": """
SELECT o_orderkey AS page_id, 'static' AS content_type, 'o_priority=string,order_key=integer,total_=float' AS data_types FROM orders""",
    "extract_table_rows": """
SELECT o_orderkey AS page_id, CAST(0 AS INTEGER) AS table_idx, CAST(0 AS INTEGER) AS row_idx,
  o_orderkey AS order_key, o_orderpriority AS o_priority, floor(o_totalprice) AS total_ FROM orders
UNION ALL SELECT o_orderkey, 0, 1, o_custkey, NULL, NULL FROM orders""",
    "extract_embedded_json": """
SELECT event_id AS page_id, CAST(s AS INTEGER) AS script_idx, CAST(CASE s WHEN 0 THEN 0 ELSE 4 END AS INTEGER) AS pattern_idx,
  event_id, user_id, event_type AS user_kind, round(value, 6) AS value
FROM events, (SELECT unnest([0, 1]) AS s)""",
    "pagination_links": f"""
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY rank) - 1 AS INTEGER) AS link_idx, link FROM (
  SELECT page_id, url, 1 AS rank, {_BASE} || '?page=2' AS link FROM pages
  UNION ALL SELECT page_id, url, 2, regexp_extract(url, '^(https?:)', 1) || '//cdn.example.org/p=' || page_id FROM pages
  UNION ALL SELECT page_id, url, 3, {_ORIGIN} || '/forth?offset=9' FROM pages
  UNION ALL SELECT page_id, url, 4, {_ORIGIN} || '/list/' || page_id FROM pages
  UNION ALL SELECT page_id, url, 5, {_ORIGIN} || '/next/' || page_id FROM pages
) WHERE link <> url QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY rank) <= 4""",
    "classify_pages": """
SELECT page_id, CASE WHEN contains(h, '<script') OR contains(h, 'javascript:') OR contains(h, 'document.')
  OR contains(h, 'window.') OR contains(h, 'jquery') OR contains(h, 'angular') OR contains(h, 'react')
  OR contains(h, 'vue') THEN 'dynamic' ELSE 'static' END AS content_type
FROM (SELECT page_id, lower(CASE WHEN page_id % 2 = 0
  THEN regexp_replace(html, '(?s)<script.*?</script>', '', 'g') ELSE html END) AS h FROM pages)""",
    "robots_admission": """
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host,
  regexp_extract(url, '^https?://[^/?#]*([^#]*)', 1) AS path FROM pages),
rules AS (
  SELECT DISTINCT host, CASE WHEN starts_with(host, 'blog.') THEN 'named' ELSE 'general' END AS kind FROM p
), r AS (
  SELECT host, 1 AS seq, CASE kind WHEN 'named' THEN false ELSE true END AS allow,
    CASE kind WHEN 'named' THEN '/de' ELSE '/en/7' END AS prefix FROM rules
  UNION ALL SELECT host, 2, kind = 'named', CASE kind WHEN 'named' THEN '/' ELSE '/en/' END FROM rules
), m AS (
  SELECT page_id, allow, row_number() OVER (PARTITION BY page_id ORDER BY seq) AS rn
  FROM p JOIN r ON p.host = r.host AND starts_with(p.path, r.prefix)
)
SELECT p.page_id, coalesce(m.allow, true) AS allowed FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.rn = 1""",
    "url_validate": """
SELECT page_id, regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') AS valid,
  f AS full_url, nullif(lower(regexp_extract(f, '^https?://([^/?#]*)', 1)), '') AS host
FROM (SELECT page_id, u, CASE WHEN regexp_matches(u, '^https?://') THEN u ELSE 'https://' || u END AS f FROM (
  SELECT page_id, CASE page_id % 3 WHEN 0 THEN regexp_replace(url, '^https?://', '')
    WHEN 1 THEN regexp_replace(url, '^https?://[^/]*', 'http://') ELSE url END AS u FROM pages))""",
    "resolve_links": f"""
SELECT page_id, CAST(i - 1 AS INTEGER) AS link_idx,
  CASE WHEN starts_with(href, '/') THEN origin || href ELSE href END AS link
FROM (SELECT page_id, {_ORIGIN} AS origin,
    replace(unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)), '&amp;', '&') AS href,
    generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS i FROM pages)""",
    "extract_report": """
SELECT page_id, CAST(items + boxes AS BIGINT) AS total_records,
  concat_ws(',', CASE WHEN boxes > 0 THEN 'class,content,element_type,id' END, CASE WHEN items > 0 THEN 'item' END) AS columns,
  CAST(1 AS INTEGER) AS pages, CAST(0 AS INTEGER) AS errors,
  CASE WHEN items + boxes = 0 THEN 'No structured data found on the page' ELSE '' END AS warnings,
  CASE WHEN items + boxes = 0 THEN 'NO_DATA' ELSE 'SUCCESS' END AS status
FROM (SELECT page_id, len(regexp_extract_all(h, '<li><a[^>]*>[^<]*[^<\\s][^<]*</a></li>')) AS items,
    len(regexp_extract_all(h, '<div[^>]*>[^<]*[^<\\s][^<]*</div>')) AS boxes
  FROM (SELECT page_id, CASE WHEN page_id % 10 = 0
    THEN regexp_replace(html, '(?s)<nav>.*?</nav>|<div.*?</div>', '', 'g') ELSE html END AS h FROM pages))""",
    "unify_union": """
WITH c AS (SELECT c_acctbal AS balance, c_custkey AS customer_key, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation,
  CAST(NULL AS BIGINT) AS supplier_key FROM customer)
SELECT * FROM c UNION ALL SELECT * FROM c
UNION ALL SELECT s_acctbal, NULL, s_name, CAST(s_nationkey AS VARCHAR), s_suppkey FROM supplier""",
    "combine_union": """
SELECT CAST(p_partkey AS VARCHAR) AS key, p_name AS name, p_size, NULL AS n_regionkey FROM part
UNION ALL SELECT 'N' || n_nationkey, n_name, NULL, n_regionkey FROM nation""",
    "extract_records": _ITEMS
    + f"""
SELECT page_id, 'list' AS source, list_idx AS group_idx, item_idx AS row_idx, item, NULL AS element_type, NULL AS content FROM items
UNION ALL SELECT page_id, 'element', CAST(0 AS INTEGER), element_idx, NULL, element_type, content FROM ({_ELEMENTS})""",
    "records_wide": _ITEMS
    + f"""
SELECT page_id, 'list' AS source, list_idx AS group_idx, item_idx AS row_idx, NULL AS class, NULL AS content,
  NULL AS element_type, NULL AS id, item FROM items
UNION ALL SELECT page_id, 'element', CAST(0 AS INTEGER), element_idx, class, content, element_type, id, NULL FROM ({_ELEMENTS})""",
    "record_shapes": _ITEMS
    + f"""
SELECT sha256('["item"]') AS fingerprint, 'item' AS names, count(*) AS rows FROM items HAVING count(*) > 0
UNION ALL SELECT sha256('["class","content","element_type","id"]'), 'class,content,element_type,id', count(*) FROM ({_ELEMENTS}) HAVING count(*) > 0""",
    "records_gathered": _ITEMS
    + f"""
SELECT page_id, 'list' AS source, list_idx AS group_idx, item_idx AS row_idx, sha256('["item"]') AS fingerprint,
  item, NULL AS element_type, NULL AS content FROM items
UNION ALL SELECT page_id, 'element', CAST(0 AS INTEGER), element_idx, sha256('["class","content","element_type","id"]'),
  NULL, element_type, content FROM ({_ELEMENTS})""",
    "normalize_names": rf"""
SELECT doc_id, CASE WHEN s = '' THEN 'unnamed_column' ELSE s END AS name FROM (
  SELECT doc_id, lower(regexp_replace(regexp_replace(regexp_replace(h,
    '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g'), '[^\p{{L}}\p{{N}}_{_SPACE}]', '', 'g'), '[{_SPACE}]+', '_', 'g')) AS s
  FROM (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN ' !? ' ELSE text END AS h FROM documents))""",
}
