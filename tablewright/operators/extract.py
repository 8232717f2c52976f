"""Structured rows out of parsed pages.

Input is the output of ``parse_pages``.  Everything below works on the arrays
of one page at a time, so no operator shuffles; rows appear in a final
``explode``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import casts, urls
from tablewright.functions.names import clean_name_column
from tablewright.functions.text import strip_edges
from tablewright.operators.columns import quoted
from tablewright.sources.page_parser import HIDDEN

# Default element list, markers of scripted pages, cell texts
# that stand for a missing value, embedded-data patterns, link selectors.
DEFAULT_ELEMENTS = ("table", "div", "span")
STRUCTURED = ("table", "ul", "ol")
# What ``parse_pages`` has to hand back for lists, and of elements besides their own tags.
LIST_TAGS = ("ul", "ol", "li")
ELEMENT_ATTRIBUTES = ("class", "id")
DYNAMIC_MARKERS = (
    "<script",
    "javascript:",
    "document.",
    "window.",
    "jquery",
    "angular",
    "react",
    "vue",
)
# Names of one wide table.
MAX_WIDE = 10_000

MISSING_CELLS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)
EMBEDDED_DATA = (
    r"var\s+\w+\s*=\s*(\[.*?\]);",
    r"let\s+\w+\s*=\s*(\[.*?\]);",
    r"const\s+\w+\s*=\s*(\[.*?\]);",
    r"window\.\w+\s*=\s*(\[.*?\]);",
    r"data\s*:\s*(\[.*?\])",
    r'"data"\s*:\s*(\[.*?\])',
)
# What a script has to hold for the pattern of the same place; looked for first, since most scripts fit few patterns.
EMBEDDED_WORDS = ("var", "let", "const", "window.", "data", '"data"')
HREF_PARTS = ("page", "p=", "offset")
PAGER_CLASSES = ("pagination", "pager", "page-numbers")
LINK_TEXTS = ("Next", ">")
NEXT_REL = "next"
NO_DATA = "No structured data found on the page"


def _keys(parsed: DataFrame) -> list[str]:
    return [c for c in parsed.columns if c not in ("nodes", "texts", "tables", "error")]


def _raw_text(node: Column) -> Column:
    """Text pieces below a node as they stand."""
    pieces = F.slice(F.col("texts"), node["t0"] + 1, node["t1"] - node["t0"])
    return F.array_join(pieces, "")


def _text(node: Column) -> Column:
    """Text pieces below a node, each stripped, joined without a separator."""
    pieces = F.slice(F.col("texts"), node["t0"] + 1, node["t1"] - node["t0"])
    stripped = F.array_join(F.transform(pieces, strip_edges), "")
    own = strip_edges(F.coalesce(node["raw"], F.lit("")))
    return F.when(node["tag"].isin(*sorted(HIDDEN)), own).otherwise(stripped)


def _attribute(node: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(node["attrs"], F.lit(name)), F.lit(""))


def _subtree(node: Column) -> Column:
    return F.slice(F.col("nodes"), node["pos"] + 2, node["end"] - node["pos"] - 1)


def _nodes(*tags: str) -> Column:
    return F.filter("nodes", lambda n: n["tag"].isin(*tags))


def _lists() -> Column:
    """array<array<item>> of the page, empty lists left out."""

    def items(node: Column) -> Column:
        entries = F.filter(_subtree(node), lambda n: n["tag"] == "li")
        return F.filter(F.transform(entries, _text), lambda t: t != "")

    return F.filter(F.transform(_nodes("ul", "ol"), items), lambda x: F.size(x) > 0)


def _elements(tags: Sequence[str]) -> Column:
    """array<struct> of the wanted elements, grouped in the order of ``tags``."""

    def describe(node: Column) -> Column:
        classes = F.regexp_replace(_attribute(node, "class"), r"\s+", " ")
        return F.struct(
            node["tag"].alias("element_type"),
            _text(node).alias("content"),
            F.trim(classes).alias("class"),
            _attribute(node, "id").alias("id"),
        )

    groups = [F.transform(_nodes(tag), describe) for tag in tags if tag not in STRUCTURED]
    every = F.concat(*groups) if groups else F.array()
    return F.filter(every, lambda e: e["content"] != "")


def _usable_tables() -> Column:
    """Tables with at least one row below the header."""
    return F.filter("tables", lambda t: F.size(t) > 1)


def extract_list_items(parsed: DataFrame) -> DataFrame:
    """(keys, list_idx, item_idx, item); nested items count for every enclosing list."""
    keys = _keys(parsed)
    lists = parsed.select(*keys, F.posexplode(_lists()).alias("list_idx", "items"))
    return lists.select(*keys, "list_idx", F.posexplode("items").alias("item_idx", "item"))


def extract_elements(parsed: DataFrame, tags: Sequence[str] = DEFAULT_ELEMENTS) -> DataFrame:
    """(keys, element_idx, element_type, content, class, id); blank text left out."""
    keys = _keys(parsed)
    found = parsed.select(*keys, F.posexplode(_elements(tags)).alias("element_idx", "e"))
    return found.select(*keys, "element_idx", "e.element_type", "e.content", "e.class", "e.id")


def _header_names(header: Column, width: Column) -> Column:
    """Clean names, one per column; blanks are numbered, repeats get the next free number."""
    padded = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.get(header, i))
    filled = F.transform(
        padded,
        lambda h, i: F.when(
            F.coalesce(h, F.lit("")) == "", F.concat(F.lit("Unnamed "), i.cast("string"))
        ).otherwise(h),
    )

    def free(taken: Column, name: Column) -> Column:
        """The name, or with the first number that makes it new."""
        numbered = F.transform(
            F.sequence(F.lit(1), F.size(taken) + 1), lambda n: F.concat(name, n.cast("string"))
        )
        unused = F.filter(numbered, lambda c: ~F.array_contains(taken, c))
        return F.when(F.array_contains(taken, name), F.get(unused, F.lit(0))).otherwise(name)

    return F.aggregate(
        _bound(filled, lambda names: F.transform(names, clean_name_column)),
        F.array().cast("array<string>"),
        lambda taken, name: F.array_append(taken, free(taken, name)),
    )


def _grid_rows(parsed: DataFrame) -> DataFrame:
    """(keys, table_idx, names, row_idx, cells): body rows with their column names."""
    keys = _keys(parsed)
    tables = parsed.select(*keys, F.posexplode(_usable_tables()).alias("table_idx", "grid"))
    width = F.array_max(F.transform("grid", F.size))
    named = tables.select(
        *keys,
        "table_idx",
        _header_names(F.get("grid", F.lit(0)), width).alias("names"),
        F.slice("grid", F.lit(2), F.size("grid")).alias("body"),
        width.alias("width"),
    )
    kept = F.filter(
        "body", lambda r: (F.col("width") > 1) | (F.coalesce(F.get(r, F.lit(0)), F.lit("")) != "")
    )
    return named.select(*keys, "table_idx", "names", F.posexplode(kept).alias("row_idx", "cells"))


def _filled(value: Column, missing: Sequence[str]) -> Column:
    return F.when(~value.isin(*missing), value)


def _cell_number(value: Column) -> Column:
    """A number with or without thousands separators, else NULL."""
    bare = F.replace(value, F.lit(","), F.lit(""))
    return F.when(bare.rlike(casts.NUMBER_PATTERN), bare.try_cast("double"))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it occurs there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _column_type(values: Column) -> Column:
    """Type of a table's column from all of its cells, missing ones NULL.

    integer needs whole numbers in every row, boolean true or false in every
    row; numbers with gaps or fractions, or nothing but gaps, are float.
    """

    def of(known: Column, full: Column) -> Column:
        whole = F.forall(known, lambda v: F.replace(v, F.lit(","), F.lit("")).rlike(r"^\s*[+-]?\d+\s*$"))
        return (
            F.when(F.size(known) == 0, "float")
            .when(full & whole, "integer")
            .when(F.forall(known, lambda v: _cell_number(v).isNotNull()), "float")
            .when(full & F.forall(known, lambda v: F.lower(v).isin("true", "false")), "boolean")
            .otherwise("string")
        )

    return _bound(values, lambda every: _bound(F.filter(every, lambda v: v.isNotNull()), lambda known: of(known, F.size(known) == F.size(every))))


def _table_columns(grid: Column, missing: Sequence[str]) -> Column:
    """array<struct<name, type>> of one laid-out table."""
    names = _header_names(F.get(grid, F.lit(0)), F.array_max(F.transform(grid, F.size)))

    def columns(body: Column) -> Column:
        return F.transform(
            names,
            lambda name, i: F.struct(
                name.alias("name"), _column_type(F.transform(body, lambda row: _filled(F.get(row, i), missing))).alias("type")
            ),
        )

    return _bound(F.slice(grid, F.lit(2), F.size(grid)), columns)


def table_column_types(parsed: DataFrame, missing: Sequence[str] = MISSING_CELLS) -> DataFrame:
    """(keys, table_idx, col_idx, name, type): what each column of each table holds, without a schema given."""
    keys = _keys(parsed)
    tables = parsed.select(*keys, F.posexplode(_usable_tables()).alias("table_idx", "grid"))
    found = tables.select(*keys, "table_idx", F.posexplode(_table_columns(F.col("grid"), missing)).alias("col_idx", "c"))
    return found.select(*keys, "table_idx", "col_idx", "c.name", "c.type")


def extract_typed_cells(parsed: DataFrame, missing: Sequence[str] = MISSING_CELLS) -> DataFrame:
    """(keys, table_idx, row_idx, col_idx, name, type, text, number, truth), one row per cell.

    The value stands in the column of its type: ``number`` for integer and
    float, ``truth`` for boolean, ``text`` for string columns.  Types are those of
    ``table_column_types``; pages stay rows, nothing is shuffled.
    """
    keys = _keys(parsed)
    tables = parsed.select(*keys, F.posexplode(_usable_tables()).alias("table_idx", "grid"))
    typed = tables.select(*keys, "table_idx", _table_columns(F.col("grid"), missing).alias("columns"), F.slice("grid", F.lit(2), F.size("grid")).alias("body"))
    kept = F.filter("body", lambda r: (F.size("columns") > 1) | (F.coalesce(F.get(r, F.lit(0)), F.lit("")) != ""))
    rows = typed.select(*keys, "table_idx", "columns", F.posexplode(kept).alias("row_idx", "cells"))
    cells = rows.select(*keys, "table_idx", "row_idx", "cells", F.posexplode("columns").alias("col_idx", "c"))
    value = _filled(F.get("cells", F.col("col_idx")), missing)
    kind = F.col("c.type")
    return cells.select(
        *keys,
        "table_idx",
        "row_idx",
        "col_idx",
        "c.name",
        "c.type",
        F.when(kind == "string", value).alias("text"),
        F.when(kind.isin("integer", "float"), _cell_number(value)).alias("number"),
        F.when(kind == "boolean", F.lower(value) == "true").alias("truth"),
    )


def extract_table_cells(parsed: DataFrame, missing: Sequence[str] = MISSING_CELLS) -> DataFrame:
    """(keys, table_idx, row_idx, col_idx, name, value), one row per cell.

    The first row of a table names the columns.  The long form holds pages
    with any columns in one schema.
    """
    keys = _keys(parsed)

    def cell(name: Column, i: Column) -> Column:
        value = _filled(F.get(F.col("cells"), i), missing)
        return F.struct(i.alias("col_idx"), name.alias("name"), value.alias("value"))

    cells = _grid_rows(parsed).select(
        *keys, "table_idx", "row_idx", F.explode(F.transform("names", cell)).alias("c")
    )
    return cells.select(*keys, "table_idx", "row_idx", "c.col_idx", "c.name", "c.value")


def extract_table_rows(
    parsed: DataFrame, schema: str | T.StructType, missing: Sequence[str] = MISSING_CELLS
) -> DataFrame:
    """Wide rows of the tables that have every column of ``schema``.

    Values are cast leniently; thousands separators are accepted.
    """
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    keys = _keys(parsed)
    rows = _grid_rows(parsed).filter(
        F.size(F.array_intersect("names", F.array(*[F.lit(f.name) for f in wanted]))) == len(wanted)
    )

    def typed(field: T.StructField) -> Column:
        at = F.array_position("names", field.name) - 1
        value = _filled(F.get("cells", at.cast("int")), missing)
        if isinstance(field.dataType, T.NumericType):
            number = F.replace(value, F.lit(","), F.lit(""))
            exact = number.try_cast(field.dataType)
            value = F.when(
                number.rlike(casts.NUMBER_PATTERN),
                F.coalesce(exact, number.try_cast("double").try_cast(field.dataType)),
            )
            return value.alias(field.name)
        return value.try_cast(field.dataType).alias(field.name)

    return rows.select(*keys, "table_idx", "row_idx", *[typed(f) for f in wanted])


def extract_records(parsed: DataFrame, tags: Sequence[str] = DEFAULT_ELEMENTS) -> DataFrame:
    """All rows of a page in one pass: (keys, source, group_idx, row_idx, cells).

    ``source`` is table, list or element; ``cells`` is an array of
    (name, value), so pages with any columns share one schema.
    ``record_columns`` turns cells into columns.
    """
    keys = _keys(parsed)

    def pair(name: Column, value: Column) -> Column:
        return F.struct(name.alias("name"), value.alias("value"))

    def record(source: str, group: Column, row: Column, cells: Column) -> Column:
        return F.struct(
            F.lit(source).alias("source"),
            group.cast("int").alias("group_idx"),
            row.cast("int").alias("row_idx"),
            cells.alias("cells"),
        )

    def table(grid: Column, group: Column) -> Column:
        names = _header_names(F.get(grid, F.lit(0)), F.array_max(F.transform(grid, F.size)))

        def row(line: Column, i: Column) -> Column:
            def cell(name: Column, at: Column) -> Column:
                return pair(name, _filled(F.get(line, at), MISSING_CELLS))

            return record("table", group, i, F.transform(names, cell))

        return F.transform(F.slice(grid, F.lit(2), F.size(grid)), row)

    def items(entries: Column, group: Column) -> Column:
        return F.transform(
            entries, lambda t, i: record("list", group, i, F.array(pair(F.lit("item"), t)))
        )

    def element(e: Column, i: Column) -> Column:
        names = ("element_type", "content", "class", "id")
        return record("element", F.lit(0), i, F.array(*[pair(F.lit(n), e[n]) for n in names]))

    rows = F.concat(
        F.flatten(F.transform(_usable_tables(), table)),
        F.flatten(F.transform(_lists(), items)),
        F.transform(_elements(tags), element),
    )
    return parsed.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def record_columns(records: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace ``cells`` by the named columns, NULL where a row has none."""

    def value(name: str) -> Column:
        first = F.get(F.filter("cells", lambda cell: cell["name"] == name), F.lit(0))
        return first["value"].alias(name)

    keep = [quoted(c) for c in records.columns if c != "cells"]
    return records.select(*keep, *[value(c) for c in columns])


def unify_records(records: DataFrame, most: int = MAX_WIDE) -> DataFrame:
    """One wide table of all records: every name that occurs, in sorted order, NULL where a row lacks it.

    The names come from one aggregate with map-side reduction; there are as
    many as the wide table has columns.  More than ``most`` make no table;
    ``gather_records`` holds records of any shapes.
    """
    names = records.select(F.explode("cells.name").alias("name")).groupBy("name").agg(F.count(F.lit(1)))
    found = sorted(r["name"] for r in names.select("name").limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"more than {most} different names for one wide table; use gather_records")
    return record_columns(records, found)


def gather_records(records: DataFrame) -> DataFrame:
    """(keys, fingerprint, record): records of any shapes in one table.

    ``record`` is a VARIANT object with a row's own names, of a repeated name
    the first; ``fingerprint`` is the SHA-256 of its sorted names as JSON, so that
    rows of one shape can be grouped, counted, or written to one partition.
    Neither names nor shapes are collected anywhere.
    """
    names = F.array_distinct("cells.name")
    first = F.transform(names, lambda n: F.get(F.filter("cells", lambda cell: cell["name"] == n), F.lit(0)))
    own = F.when(F.size(names) == F.size("cells"), F.col("cells")).otherwise(first)
    record = F.parse_json(F.to_json(F.map_from_entries(own), {"ignoreNullFields": "false"}))
    keep = [quoted(c) for c in records.columns if c != "cells"]
    return records.select(*keep, F.sha2(F.to_json(F.array_sort(names)), 256).alias("fingerprint"), record.alias("record"))


def record_shapes(records: DataFrame) -> DataFrame:
    """(fingerprint, names, rows): the different sets of names, each with the number of its records."""
    names = F.array_sort(F.array_distinct("cells.name")).alias("names")
    counted = records.select(names).groupBy("names").agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(F.sha2(F.to_json("names"), 256).alias("fingerprint"), "names", "rows")


def record_values(gathered: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace ``record`` by the named columns as text, NULL where a record has none."""

    keep = [quoted(c) for c in gathered.columns if c != "record"]
    values = gathered.withColumn("_values", F.col("record").cast("map<string,string>"))
    return values.select(*keep, *[F.try_element_at("_values", F.lit(c)).alias(c) for c in columns])


def extract_embedded_json(parsed: DataFrame) -> DataFrame:
    """(keys, script_idx, pattern_idx, match_idx, row_idx, record) from script data.

    ``record`` is the JSON text of one object of a valid, non-empty array;
    ``flatten_records`` spreads it over columns.
    """
    keys = _keys(parsed)
    scripts = F.transform(_nodes("script"), lambda n: n["raw"])
    found = parsed.select(*keys, F.posexplode(scripts).alias("script_idx", "script"))
    none = F.array().cast("array<string>")
    matches = F.array(
        *[
            F.when(F.col("script").contains(word), F.regexp_extract_all("script", F.lit(f"(?sU){pattern}"), F.lit(1))).otherwise(none)
            for word, pattern in zip(EMBEDDED_WORDS, EMBEDDED_DATA)
        ]
    )
    per_pattern = found.filter(F.col("script").isNotNull()).select(
        *keys, "script_idx", F.posexplode(matches).alias("pattern_idx", "found")
    )
    arrays = per_pattern.select(
        *keys, "script_idx", "pattern_idx", F.posexplode("found").alias("match_idx", "text")
    )
    # Without a brace, plain or escaped, no record can begin with one; parsing such text in vain costs an exception.
    braced = arrays.filter(F.col("text").contains("{") | F.col("text").contains("\\"))
    valid = braced.filter(F.try_parse_json("text").isNotNull())
    records = valid.select(
        *keys,
        "script_idx",
        "pattern_idx",
        "match_idx",
        F.posexplode(F.from_json("text", "array<string>")).alias("row_idx", "record"),
    )
    return records.filter(F.col("record").startswith("{"))


def record_schema(records: DataFrame, column: str = "record") -> T.StructType:
    """Schema that covers all JSON records, found with one aggregate."""
    ddl = records.agg(F.schema_of_variant_agg(F.try_parse_json(column))).first()[0]
    return T._parse_datatype_string(_TYPE_WORDS.sub(lambda m: _STORED_AS.get(m[0], m[0]), ddl))


# Types of the found schema that are stored as others; field names, quoted or before a colon, stay.
_STORED_AS = {"OBJECT": "STRUCT", "VARIANT": "STRING", "VOID": "STRING"}
_TYPE_WORDS = re.compile(r"`(?:[^`]|``)*`|(?<!\w)(?:OBJECT(?=<)|(?:VARIANT|VOID)(?=[>,]|$))")


def flatten_records(
    records: DataFrame, schema: str | T.StructType | None = None, column: str = "record"
) -> DataFrame:
    """Replace the JSON column by typed columns; nested objects become ``a.b``."""
    schema = record_schema(records, column) if schema is None else schema
    parsed = records.withColumn("_json", F.from_json(column, schema))

    def leaves(kind: T.StructType, at: Column, prefix: str) -> list[Column]:
        out = []
        for field in kind:
            name = f"{prefix}{field.name}"
            if isinstance(field.dataType, T.StructType):
                out += leaves(field.dataType, at[field.name], f"{name}.")
            else:
                out.append(at[field.name].alias(name))
        return out

    keep = [quoted(c) for c in records.columns if c != column]
    return parsed.select(*keep, *leaves(parsed.schema["_json"].dataType, F.col("_json"), ""))


def pagination_links(parsed: DataFrame, base_url: str = "url", max_pages: int | None = None) -> DataFrame:
    """(keys, link_idx, link): follow-up pages in order of discovery.

    Selectors are tried one after the other; a link counts where it is found
    first, the page itself is left out; all remain, or with ``max_pages`` at
    most one less than that.  The pagers of each class are found once per page.
    """
    if max_pages is not None and max_pages < 1:
        raise ValueError("max_pages must be positive")
    keys = _keys(parsed)
    anchors = F.filter("nodes", lambda n: (n["tag"] == "a") & (_attribute(n, "href") != ""))

    def inside(css_class: str) -> Column:
        """Anchors below a pager; the page's pagers are bound once, as a one-element array."""
        pagers = F.filter(
            "nodes",
            lambda p: F.array_contains(F.split(_attribute(p, "class"), r"\s+"), css_class),
        )
        spans = F.transform(pagers, lambda p: F.struct(p["pos"].alias("pos"), p["end"].alias("end")))
        found = F.transform(
            F.array(spans),
            lambda ps: F.filter(
                anchors, lambda n: F.exists(ps, lambda p: (p["pos"] < n["pos"]) & (n["pos"] < p["end"]))
            ),
        )
        return F.get(found, F.lit(0))

    def href_has(part: str):
        return lambda n: _attribute(n, "href").contains(part)

    def text_has(part: str):
        return lambda n: _raw_text(n).contains(part)

    hits = F.concat(
        *[F.filter(anchors, href_has(part)) for part in HREF_PARTS],
        *[inside(css_class) for css_class in PAGER_CLASSES],
        *[F.filter(anchors, text_has(part)) for part in LINK_TEXTS],
        F.filter(anchors, lambda n: _attribute(n, "rel") == NEXT_REL),
    )
    resolved = F.transform(hits, lambda n: urls.resolve(F.col(base_url), _attribute(n, "href")))
    links = F.filter(F.array_distinct(resolved), lambda link: link != F.col(base_url))
    if max_pages is not None:
        links = F.slice(links, 1, max_pages - 1)
    return parsed.select(*keys, F.posexplode(links).alias("link_idx", "link"))


def content_type(html: Column) -> Column:
    """``dynamic`` when the lower-cased page holds a script marker, else ``static``."""
    page = F.lower(html)
    marked = F.lit(False)
    for marker in DYNAMIC_MARKERS:
        marked = marked | page.contains(marker)
    return F.when(marked, F.lit("dynamic")).otherwise(F.lit("static"))


def _common_type(types: Column) -> Column:
    """One type for columns of several tables that share a name."""
    different = F.array_distinct(types)
    numeric = F.forall(different, lambda t: t.isin("integer", "float"))
    return F.when(F.size(different) == 1, F.get(different, F.lit(0))).when(numeric, "float").otherwise("string")


def extract_report(parsed: DataFrame, tags: Sequence[str] = DEFAULT_ELEMENTS, html: str | None = None) -> DataFrame:
    """One row per page: records, columns, their types, warnings, errors and status.

    Counts are array sizes of the page itself, so empty pages need no join.
    With ``html``, a kept column with the page's source, ``content_type`` says
    static or dynamic in its place.
    """
    keys = [c for c in _keys(parsed) if c != html]
    lists, elements, tables = _lists(), _elements(tags), _usable_tables()
    none = F.array().cast("array<struct<name:string,type:string>>")

    def texts(*names: str) -> Column:
        return F.array(*[F.struct(F.lit(c).alias("name"), F.lit("string").alias("type")) for c in names])

    entries = F.concat(
        F.flatten(F.transform(tables, lambda t: _table_columns(t, MISSING_CELLS))),
        F.when(F.size(lists) > 0, texts("item")).otherwise(none),
        F.when(F.size(elements) > 0, texts("class", "content", "element_type", "id")).otherwise(none),
    )

    def total(arrays: Column, less: int = 0) -> Column:
        return F.aggregate(arrays, F.lit(0).cast("bigint"), lambda n, a: n + F.size(a) - less)

    words = F.array().cast("array<string>")
    extra = [content_type(quoted(html)).alias("content_type")] if html else []
    counted = parsed.select(
        *keys,
        *extra,
        (total(tables, 1) + total(lists) + F.size(elements)).alias("total_records"),
        entries.alias("_entries"),
        F.when(F.col("error").isNull(), words).otherwise(F.array("error")).alias("errors"),
    )
    counted = counted.withColumn("columns", F.array_sort(F.array_distinct("_entries.name")))

    def type_of(name: Column) -> Column:
        return _common_type(F.transform(F.filter("_entries", lambda e: e["name"] == name), lambda e: e["type"]))

    return counted.select(
        *[quoted(c) for c in counted.columns if c != "_entries"],
        F.map_from_arrays("columns", F.transform("columns", type_of)).alias("data_types"),
        F.lit(1).alias("pages"),
        F.when(
            (F.col("total_records") == 0) & (F.size("errors") == 0), F.array(F.lit(NO_DATA))
        ).otherwise(words).alias("warnings"),
        F.when(F.size("errors") > 0, "FAILED")
        .when(F.col("total_records") > 0, "SUCCESS")
        .otherwise("NO_DATA")
        .alias("status"),
        F.current_timestamp().alias("extracted_at"),
    )
