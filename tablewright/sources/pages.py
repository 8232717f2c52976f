"""Page corpus scan: a table of raw HTML to one parsed row per page."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tablewright.sources import page_parser

# Executors receive the helpers with the task and need no installed package.
cloudpickle.register_pickle_by_value(page_parser)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PARSED_FIELDS = {
    "nodes": (
        "array<struct<tag:string,attrs:map<string,string>,pos:int,end:int,t0:int,t1:int,raw:string>>"
    ),
    "texts": "array<string>",
    "tables": "array<array<array<string>>>",
    "error": "string",
}
_SLICE = 64  # pages turned into one output batch


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Page table from Parquet or JSON, or one page per file for ``text``."""
    if fmt == "text":
        raw = spark.read.text(path, wholetext=True).selectExpr(
            "_metadata.file_path AS url", "value AS html"
        )
        return raw.selectExpr("xxhash64(url) AS page_id", "url", "html")
    return spark.read.format(fmt).load(path)


def _offsets(sizes: list[int]) -> pa.Array:
    return pa.array([0, *accumulate(sizes)], pa.int32())


def _node_array(pages: list[list[dict]]) -> pa.Array:
    """Column-wise build; a list of dicts would be converted value by value."""
    nodes = [node for page in pages for node in page]
    attrs = [node["attrs"] for node in nodes]
    columns = {
        "tag": pa.array([node["tag"] for node in nodes], pa.string()),
        "attrs": pa.MapArray.from_arrays(
            _offsets([len(a) for a in attrs]),
            pa.array([name for a in attrs for name in a], pa.string()),
            pa.array([value for a in attrs for value in a.values()], pa.string()),
        ),
        **{c: pa.array([node[c] for node in nodes], pa.int32()) for c in ("pos", "end", "t0", "t1")},
        "raw": pa.array([node["raw"] for node in nodes], pa.string()),
    }
    flat = pa.StructArray.from_arrays(list(columns.values()), names=list(columns))
    return pa.ListArray.from_arrays(_offsets([len(page) for page in pages]), flat)


def _nested_array(pages: list[list], depth: int) -> pa.Array:
    """Lists of texts, ``depth`` levels deep, built from flat offsets."""
    sizes, level = [], pages
    for _ in range(depth):
        sizes.append([len(entry) for entry in level])
        level = [item for entry in level for item in entry]
    array = pa.array(level, pa.string())
    for counts in reversed(sizes):
        array = pa.ListArray.from_arrays(_offsets(counts), array)
    return array


def _parse(
    source: str | None, fields: Sequence[str], tags: set[str] | None, attributes: set[str] | None
) -> tuple[list, list, list, str | None]:
    """Nodes, texts, tables and error of one page; a broken page cannot fail the job."""
    try:
        page = page_parser.PageParser(source or "")
    except Exception as problem:
        return [], [], [], repr(problem)
    nodes, texts = ([], []) if fields == ["tables"] else (page.nodes, page.texts) if tags is None else page.pruned(tags, attributes)
    try:
        return nodes, texts, page.tables() if "tables" in fields else [], None
    except Exception as problem:  # a broken table does not hide the page
        return nodes, texts, [], repr(problem)


def parse_batch(
    batch: pa.RecordBatch,
    html: str,
    keep: list[str],
    fields: list[str],
    tags: set[str] | None = None,
    attributes: set[str] | None = None,
):
    parsed = [_parse(source, fields, tags, attributes) for source in batch.column(html).to_pylist()]
    nodes, texts, tables, errors = zip(*parsed) if parsed else ([], [], [], [])
    build = {
        "nodes": lambda: _node_array(nodes),
        "texts": lambda: _nested_array(texts, 1),
        "tables": lambda: _nested_array(tables, 3),
        "error": lambda: pa.array(errors, pa.string()),
    }
    arrays = [batch.column(c) for c in keep] + [build[name]() for name in fields]
    return pa.RecordBatch.from_arrays(arrays, names=[*keep, *fields])


def parse_pages(
    pages: DataFrame,
    keep: Sequence[str] = ("page_id",),
    html: str = "html",
    fields: Sequence[str] = tuple(PARSED_FIELDS),
    tags: Sequence[str] | None = None,
    attributes: Sequence[str] | None = None,
) -> DataFrame:
    """Parse each page once; a page that cannot be parsed gets an ``error``.

    No shuffle: pages are parsed where they are scanned, and only the kept
    columns and the HTML are read.  ``fields`` limits what is handed back, ``tags``
    the elements in it with the texts below them, ``attributes`` their
    attributes; both default to all.  Tables are always laid out whole.
    """
    keep, fields = list(keep), list(fields)
    tags, attributes = (None if names is None else set(names) for names in (tags, attributes))
    types = [T.StructField(n, T._parse_datatype_string(PARSED_FIELDS[n])) for n in fields]
    schema = T.StructType([*[pages.schema[c] for c in keep], *types])

    def parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _SLICE):
                yield parse_batch(batch.slice(start, _SLICE), html, keep, fields, tags, attributes)

    return pages.select(*dict.fromkeys([*keep, html])).mapInArrow(parse_batches, schema)
