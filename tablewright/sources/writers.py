"""Dataset writers: CSV, JSON in five layouts, Parquet, XML and HTML.

All of them write one part per task through Spark's commit protocol; nothing
passes through the driver.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.columns import quoted, reorder_columns
from tablewright.session import materialize

# Accepted options and cell formats.
ENCODINGS = ("utf-8", "utf-16", "ascii", "latin-1")
JSON_ORIENTS = ("records", "index", "values", "split", "table")
SUFFIXES = {
    ".csv": "csv",
    ".json": "json",
    ".parquet": "parquet",
    ".xml": "xml",
    ".html": "html",
}
FLOAT_FORMAT = "0.00"
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"

# Rows of an XML file, which is read by one task: a larger dataset has more files, not larger ones.
XML_ROWS = 50_000

METADATA_SCHEMA = (
    "export_date string, total_records bigint, total_columns int, columns array<string>,"
    " data_types map<string,string>, orientation string"
)

# Names Spark uses for the accepted encodings.
_CHARSETS = {"utf-8": "UTF-8", "utf-16": "UTF-16", "ascii": "US-ASCII", "latin-1": "ISO-8859-1"}


@dataclass(frozen=True)
class ExportOptions:
    format: str | None = None
    index_column: str | None = None
    encoding: str = "utf-8"
    delimiter: str = ","
    json_orient: str = "records"
    compression: str | None = None
    partition_by: Sequence[str] = field(default_factory=tuple)
    mode: str = "errorifexists"

    def validate(self) -> None:
        if self.encoding not in ENCODINGS:
            raise ValueError(f"encoding must be one of {ENCODINGS}")
        if self.json_orient not in JSON_ORIENTS:
            raise ValueError(f"json_orient must be one of {JSON_ORIENTS}")
        if self.format is not None and self.format not in SUFFIXES.values():
            raise ValueError(f"unsupported export format: {self.format}")

    def validate_for(self, fmt: str) -> None:
        """Refuse what the format cannot do."""
        if self.partition_by and fmt != "parquet":
            raise ValueError(f"{fmt} cannot be partitioned")
        if self.compression and fmt in ("xml", "html"):
            raise ValueError(f"{fmt} cannot be compressed")
        lines_only = fmt == "html" or fmt == "json" and self.json_orient not in ("records", "table")
        if self.encoding not in ("utf-8", "ascii") and lines_only:
            raise ValueError(f"{fmt} in this layout is written as utf-8 only")


def _format_of(path: str, options: ExportOptions) -> str:
    fmt = options.format or SUFFIXES.get(PurePosixPath(path).suffix.lower())
    if fmt is None:
        raise ValueError(f"no export format given and none known for {path}")
    return fmt


def printable(df: DataFrame) -> DataFrame:
    """Cells as the text formats print them: two decimals, seconds, '' for NULL."""

    def text(f: T.StructField) -> Column:
        c = quoted(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            shown = F.call_function("format_number", c, F.lit(FLOAT_FORMAT))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            shown = F.date_format(c, TIMESTAMP_FORMAT)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            shown = F.to_json(c)
        else:
            shown = c.cast("string")
        return shown.alias(f.name)

    return df.select(*[text(f) for f in df.schema])


def _write_csv(df: DataFrame, path: str, options: ExportOptions) -> None:
    writer = printable(df).write.mode(options.mode)
    writer = writer.option("header", True).option("sep", options.delimiter)
    writer = writer.option("encoding", _CHARSETS[options.encoding]).option("nullValue", "")
    writer = writer.option("escape", '"')
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    if options.compression:
        writer = writer.option("compression", options.compression)
    writer.csv(path)


def _json_cells(df: DataFrame, index_column: str | None) -> dict[str, Column]:
    scalars = (T.NumericType, T.StringType, T.BooleanType, T.ArrayType, T.MapType, T.StructType)
    return {
        c: quoted(c) if isinstance(df.schema[c].dataType, scalars) else quoted(c).cast("string")
        for c in df.columns
        if c != index_column
    }


def json_lines(df: DataFrame, orient: str = "records", index_column: str | None = None) -> DataFrame:
    """One JSON text per row in the given layout.

    records/table: an object; index: ``{row id: object}``; values: an array
    of cells; split: ``[row id, [cells]]``.  Cells that JSON cannot hold are
    printed.
    """
    cells = _json_cells(df, index_column)
    whole = F.struct(*[x.alias(c) for c, x in cells.items()])
    keep_nulls = {"ignoreNullFields": "false"}
    as_json = [
        F.coalesce(
            F.regexp_extract(
                F.to_json(F.struct(x.alias("v")), keep_nulls), r'(?s)^\{"v":(.*)\}$', 1
            ),
            F.lit("null"),
        )
        for x in cells.values()
    ]
    array = F.concat(F.lit("["), F.concat_ws(",", *as_json), F.lit("]"))
    if orient in ("records", "table"):
        line = F.to_json(whole, keep_nulls)
    elif orient == "values":
        line = array
    else:
        if index_column is None:
            raise ValueError(f"json_orient {orient} needs index_column")
        row_id = quoted(index_column).cast("string")
        if orient == "index":
            line = F.to_json(F.create_map(row_id, whole), keep_nulls)
        else:
            line = F.concat(F.lit("["), row_id, F.lit(","), array, F.lit("]"))
    return df.select(line.alias("value"))


def _write_json(df: DataFrame, path: str, options: ExportOptions) -> None:
    """``data/`` holds one JSON text per line, ``metadata/`` one describing object.

    The rows are counted while they are written.
    """
    counter = Observation()
    counted = df.observe(counter, F.count(F.lit(1)).alias("rows"))
    objects = options.json_orient in ("records", "table")
    if objects:  # the JSON sink knows encodings
        cells = _json_cells(counted, options.index_column)
        rows = counted.select(*[x.alias(c) for c, x in cells.items()])
    else:
        rows = json_lines(counted, options.json_orient, options.index_column)
    writer = rows.write.mode(options.mode).option("ignoreNullFields", False)
    if options.encoding != "utf-8":
        writer = writer.option("encoding", _CHARSETS[options.encoding])
    if options.compression:
        writer = writer.option("compression", options.compression)
    (writer.json if objects else writer.text)(f"{path}/data")
    columns = [c for c in df.columns if c != options.index_column]
    facts = (
        datetime.now(timezone.utc).isoformat(),
        counter.get["rows"],
        len(columns),
        columns,
        {c: df.schema[c].dataType.simpleString() for c in columns},
        options.json_orient,
    )
    described = df.sparkSession.createDataFrame([facts], METADATA_SCHEMA)
    described.write.mode(options.mode).json(f"{path}/metadata")


def _write_parquet(df: DataFrame, path: str, options: ExportOptions) -> None:
    writer = df.write.mode(options.mode).option("compression", options.compression or "snappy")
    if options.partition_by:
        writer = writer.partitionBy(*options.partition_by)
    writer.parquet(path)


def _write_xml(df: DataFrame, path: str, options: ExportOptions) -> None:
    writer = df.write.mode(options.mode).format("xml").option("rowTag", "row").option("maxRecordsPerFile", XML_ROWS)
    writer.option("rootTag", "rows").option("encoding", _CHARSETS[options.encoding]).save(path)


_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))


def html_rows(df: DataFrame) -> DataFrame:
    """One ``<tr>`` per row with escaped cells."""

    def cell(c: str) -> Column:
        text = F.coalesce(quoted(c), F.lit(""))
        for char, entity in _ENTITIES:
            text = F.replace(text, F.lit(char), F.lit(entity))
        return F.concat(F.lit("<td>"), text, F.lit("</td>"))

    cells = printable(df)
    row = F.concat(F.lit("<tr>"), *[cell(c) for c in cells.columns], F.lit("</tr>"))
    return cells.select(row.alias("value"))


def _write_html(df: DataFrame, path: str, options: ExportOptions) -> None:
    """``rows/`` holds the table rows, ``header/`` the line that names the columns."""
    html_rows(df).write.mode(options.mode).text(f"{path}/rows")
    names = df.columns
    for char, entity in _ENTITIES:
        names = [c.replace(char, entity) for c in names]
    header = "<tr>" + "".join(f"<th>{c}</th>" for c in names) + "</tr>"
    head = df.sparkSession.createDataFrame([(header,)], "value string")
    head.write.mode(options.mode).text(f"{path}/header")


_WRITERS = {
    "csv": _write_csv,
    "json": _write_json,
    "parquet": _write_parquet,
    "xml": _write_xml,
    "html": _write_html,
}


def write_dataset(
    df: DataFrame,
    path: str,
    options: ExportOptions | None = None,
    counter: Observation | None = None,
) -> str:
    """Write in the format of the options, else of the path's suffix; returns the format.

    ``counter`` observes the rows while they are written.  An index column
    comes first in the output.
    """
    options = options or ExportOptions()
    options.validate()
    fmt = _format_of(path, options)
    options.validate_for(fmt)
    if df.isEmpty():
        raise ValueError("cannot export an empty dataset")
    if options.index_column:
        df = reorder_columns(df, [options.index_column])
    if counter is not None:
        df = df.observe(counter, F.count(F.lit(1)).alias("rows"))
    _WRITERS[fmt](df, path, options)
    return fmt


LOG_SCHEMA = (
    "timestamp timestamp_ntz, filepath string, format string, records_exported bigint,"
    " columns_exported int, file_size_mb double, execution_time double, success boolean, message string"
)


def size_on_disk(spark: SparkSession, path: str) -> int:
    """Bytes of all files below ``path``, from the file system's own listing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return files.getContentSummary(at).getLength()


def write_logged(
    df: DataFrame, path: str, log_path: str, options: ExportOptions | None = None
) -> bool:
    """Write and append one row to the run log, whether it worked or not.

    The rows are counted while they are written; the size is that of the files.
    """
    options = options or ExportOptions()
    started, clock = datetime.now(timezone.utc).replace(tzinfo=None), time.monotonic()
    counter = Observation("export")
    fmt, records, size, problem = options.format, 0, 0, None
    try:
        fmt = write_dataset(df, path, options, counter)
        records = counter.get["rows"]
        size = size_on_disk(df.sparkSession, path)
    except Exception as error:  # logged and reported by the result
        problem = str(error)
    row = (
        started,
        path,
        fmt,
        records,
        len(df.columns),
        size / (1 << 20),
        time.monotonic() - clock,
        problem is None,
        problem,
    )
    log = df.sparkSession.createDataFrame([row], LOG_SCHEMA)
    log.write.mode("append").parquet(log_path)
    return problem is None


def read_dataset(spark: SparkSession, path: str, fmt: str, schema: str | None = None) -> DataFrame:
    """Read back what ``write_dataset`` wrote; records layout for JSON."""
    if fmt == "csv":
        reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
        # an empty cell is NULL, a quoted empty one is ''
        reader = reader.option("nullValue", "\0")
        return (reader.schema(schema) if schema else reader).csv(path)
    if fmt == "json":
        reader = spark.read
        return (reader.schema(schema) if schema else reader).json(f"{path}/data")
    if fmt == "xml":
        reader = spark.read.option("rowTag", "row")
        return (reader.schema(schema) if schema else reader).format("xml").load(path)
    if fmt == "html":
        return spark.read.text(f"{path}/rows")
    return spark.read.parquet(path)


def write_formats(
    df: DataFrame, base: str, formats: Sequence[str], options: ExportOptions | None = None
) -> dict[str, str | None]:
    """Write the same rows in several formats; maps each to None or its error.

    The rows are computed once: Parquet comes first and the other formats are
    made from those files, or from a scratch table when Parquet is not wanted
    or fails.  A format that fails does not stop the others.
    """
    options = options or ExportOptions()
    results: dict[str, str | None] = dict.fromkeys(formats)
    source = None
    for fmt in sorted(formats, key=lambda f: f != "parquet"):
        path = f"{base}.{fmt}"
        try:
            if source is None and fmt != "parquet":
                source = materialize(df, "formats")
            write_dataset(df if source is None else source, path, replace(options, format=fmt))
            if fmt == "parquet":
                source = df.sparkSession.read.parquet(path).select(*[quoted(c) for c in df.columns])
        except Exception as problem:  # reported per format
            results[fmt] = str(problem)
    return results
