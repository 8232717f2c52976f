"""Questions to run logs and dataset catalogs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.columns import quoted, require_columns

# Listing lengths and retention.
RECENT_EXPORTS, RECENT_ERRORS = 10, 10
TOP_TAGS, RECENT_ACTIVITY = 10, 5
RECENT_PROJECTS, RECENT_URLS = 10, 20
KEEP_DAYS = 30


def newest(df: DataFrame, n: int, time: str, tiebreak: Sequence[str]) -> DataFrame:
    """The n latest rows, a top-n without a full sort."""
    keys = [quoted(time).desc(), *[quoted(c).desc() for c in tiebreak]]
    return df.orderBy(*keys).limit(n)


def export_statistics(log: DataFrame) -> DataFrame:
    """One row over (success, records_exported, file_size_mb, execution_time)."""
    ok = F.col("success")
    total = F.count(F.lit(1))
    return log.agg(
        total.alias("total_exports"),
        F.count_if(ok).alias("successful_exports"),
        F.count_if(~ok).alias("failed_exports"),
        F.round(F.try_divide(F.count_if(ok) * 100, total), 6).alias("success_rate"),
        F.coalesce(F.sum(F.when(ok, F.col("records_exported"))), F.lit(0)).alias(
            "total_records_exported"
        ),
        F.round(F.coalesce(F.sum(F.when(ok, F.col("file_size_mb"))), F.lit(0.0)), 2).alias(
            "total_file_size_mb"
        ),
        F.round(F.coalesce(F.avg(F.when(ok, F.col("execution_time"))), F.lit(0.0)), 2).alias(
            "average_execution_time"
        ),
    )


def format_breakdown(log: DataFrame) -> DataFrame:
    """(format, exports) over successes and failures."""
    return log.groupBy("format").agg(F.count(F.lit(1)).alias("exports"))


def operation_timing(log: DataFrame, operation: str = "operation", seconds: str = "seconds") -> DataFrame:
    """(operation, runs, total_seconds, average_seconds, longest_seconds) of a log with one row per run.

    Reads audit tables of recipes as well as run logs; rows without a time count as runs only.
    """
    timed = log.groupBy(F.col(operation).alias("operation")).agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum(seconds).alias("total_seconds"),
        F.avg(seconds).alias("average_seconds"),
        F.max(seconds).alias("longest_seconds"),
    )
    return timed.select("operation", "runs", *[F.round(c, 3).alias(c) for c in timed.columns[2:]])


def recent_exports(log: DataFrame, time: str, tiebreak: Sequence[str]) -> DataFrame:
    return newest(log, RECENT_EXPORTS, time, tiebreak)


def error_statistics(
    log: DataFrame,
    time: str,
    tiebreak: Sequence[str],
    kind: str = "error_type",
    window: int | None = None,
) -> DataFrame:
    """(error_type, recent_count, total_errors): types among all errors, or among the latest ``window``."""
    latest = log if window is None else newest(log, window, time, tiebreak)
    total = log.agg(F.count(F.lit(1)).alias("total_errors"))
    counts = latest.groupBy(quoted(kind).alias("error_type")).agg(
        F.count(F.lit(1)).alias("recent_count")
    )
    # total is one row
    return counts.join(F.broadcast(total), F.lit(True))


def recent_errors(log: DataFrame, time: str, tiebreak: Sequence[str]) -> DataFrame:
    return newest(log, RECENT_ERRORS, time, tiebreak)


def list_catalog(catalog: DataFrame, time: str = "last_modified", name: str = "name") -> DataFrame:
    """Newest first."""
    return catalog.orderBy(quoted(time).desc(), quoted(name))


def search_catalog(catalog: DataFrame, query: str, fields: Sequence[str]) -> DataFrame:
    """Rows with the text in any of the fields, ignoring case; blank finds all."""
    needle = query.lower().strip()
    if not needle:
        return catalog

    def hit(field: str) -> Column:
        if isinstance(catalog.schema[field].dataType, T.ArrayType):
            return F.exists(quoted(field), lambda x: F.lower(x.cast("string")).contains(needle))
        return F.lower(quoted(field).cast("string")).contains(needle)

    known = [f for f in fields if f in catalog.columns]
    if not known:
        return catalog.filter(F.lit(False))
    return catalog.filter(reduce(lambda a, b: a | b, [F.coalesce(hit(f), F.lit(False)) for f in known]))


def catalog_statistics(catalog: DataFrame) -> DataFrame:
    """One row over (created_date, file_size in bytes)."""
    total, size = F.count(F.lit(1)), F.sum("file_size")
    return catalog.agg(
        total.alias("total_projects"),
        F.min("created_date").alias("oldest_project_date"),
        F.max("created_date").alias("newest_project_date"),
        F.round(size / 1024 / 1024, 2).alias("total_size_mb"),
        F.round(F.try_divide(size, total) / 1024, 2).alias("average_size_kb"),
    )


def top_tags(catalog: DataFrame, tags: str = "tags", n: int = TOP_TAGS) -> DataFrame:
    """(tag, uses), most used first."""
    return (
        catalog.select(F.explode(quoted(tags)).alias("tag"))
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("uses"))
        .orderBy(F.col("uses").desc(), "tag")
        .limit(n)
    )


def month_of(c: Column) -> Column:
    return F.date_format(c.cast("timestamp_ntz"), "yyyy-MM")


def per_month(catalog: DataFrame, time: str = "created_date") -> DataFrame:
    """(month, projects); dates that do not parse are left out."""
    parsed = quoted(time)
    if isinstance(catalog.schema[time].dataType, T.StringType):
        parsed = parsed.try_cast("timestamp_ntz")
    return (
        catalog.select(month_of(parsed).alias("month"))
        .na.drop()
        .groupBy("month")
        .agg(F.count(F.lit(1)).alias("projects"))
    )


def recent_distinct(log: DataFrame, key: str, time: str, n: int) -> DataFrame:
    """(key, last_used): the n most recently used different keys."""
    require_columns(log, [key, time])
    return (
        log.groupBy(quoted(key))
        .agg(F.max(quoted(time)).alias("last_used"))
        .orderBy(F.col("last_used").desc(), quoted(key))
        .limit(n)
    )


def retain_recent(log: DataFrame, time: str, days: int = KEEP_DAYS) -> DataFrame:
    """Rows within ``days`` of the newest one.

    The newest time is read first (one aggregate over one column), so that
    the cut-off is a constant the scan can skip files with.
    """
    newest_time = log.agg(F.max(quoted(time)).alias("t")).select(
        (F.col("t") - F.make_dt_interval(days=F.lit(days))).cast("string").alias("cutoff")
    )
    # as text, so that no time zone of the driver gets in between
    cutoff = newest_time.first()["cutoff"]
    return log.filter(quoted(time) >= F.lit(cutoff).cast(log.schema[time].dataType))


#: What to tell the user about a failure class, and what to do next.
FAILURE_ADVICE = {
    "connection": ("The site could not be reached.", "Check the network and run the page again."),
    "timeout": ("The site took too long to answer.", "Run the page again later or allow more time."),
    "not_found": ("The page does not exist.", "Correct the address."),
    "forbidden": ("The site refuses access.", "Respect the refusal or ask for permission."),
    "server_error": ("The site has a fault of its own.", "Run the page again later."),
    "http_error": ("The site answered with an error.", "Look at the status code."),
    "invalid_url": ("The address is not valid.", "Write the address in full, with its scheme."),
    "network_error": ("The page could not be loaded.", "Check the network and the address."),
    "invalid_structure": ("The page's markup cannot be parsed.", "Read the page as plain elements."),
    "encoding": ("The text's encoding is not understood.", "State the encoding and read again."),
    "empty_page": ("The page holds nothing to read.", "See whether the page needs a browser."),
    "unparseable": ("The page cannot be read.", "Leave the page out and report it."),
    "out_of_memory": ("The data did not fit in memory.", "Use more and smaller partitions."),
    "type_conversion": ("Values do not fit the wanted type.", "Clean the column before converting it."),
    "missing_column": ("A column is not there.", "Compare the column names."),
    "duplicate_handling": ("Duplicates could not be handled.", "Name the columns that form the key."),
    "data_error": ("The data could not be processed.", "Profile the table and run the step alone."),
    "file_not_found": ("The file is not there.", "Correct the path."),
    "permission_denied": ("The file may not be opened.", "Change its permissions or the folder."),
    "disk_full": ("There is no room left.", "Free space or write elsewhere."),
    "file_error": ("The file could not be read or written.", "Check the path and the file."),
    "invalid_value": ("A given value is not allowed.", "Correct the value."),
    "unknown": ("Something unexpected happened.", "Look at the log."),
}


def failure_advice(classified: DataFrame) -> DataFrame:
    """Add ``user_message`` and ``suggested_action`` for each ``failure_class``."""
    new = {}
    for i, name in enumerate(("user_message", "suggested_action")):
        texts = F.create_map(*[F.lit(x) for kind, advice in FAILURE_ADVICE.items() for x in (kind, advice[i])])
        new[name] = texts[F.col("failure_class")]
    return classified.withColumns(new)


def classify_failures(log: DataFrame) -> DataFrame:
    """Add ``failure_class`` and ``retryable`` to (area, error, status_code, message).

    ``area`` says where it failed (network, parsing, data, file, validation),
    ``error`` is the exception's name.
    """
    message = F.lower("message")
    error, status = F.col("error"), F.col("status_code")
    network = (
        F.when(error == "ConnectionError", "connection")
        .when(error == "Timeout", "timeout")
        .when((error == "HTTPError") & (status == 404), "not_found")
        .when((error == "HTTPError") & (status == 403), "forbidden")
        .when((error == "HTTPError") & (status >= 500), "server_error")
        .when(error == "HTTPError", "http_error")
        .when(error == "InvalidURL", "invalid_url")
        .otherwise("network_error")
    )
    parsing = (
        F.when(message.contains("lxml"), "invalid_structure")
        .when(message.contains("encoding"), "encoding")
        .when(message.contains("empty"), "empty_page")
        .otherwise("unparseable")
    )
    data = (
        F.when(message.contains("memory") | (error == "MemoryError"), "out_of_memory")
        .when(message.contains("type"), "type_conversion")
        .when(message.contains("index") | error.isin("IndexError", "KeyError"), "missing_column")
        .when(message.contains("duplicate"), "duplicate_handling")
        .otherwise("data_error")
    )
    file = (
        F.when(error == "FileNotFoundError", "file_not_found")
        .when(error == "PermissionError", "permission_denied")
        .when((error == "OSError") & message.contains("disk"), "disk_full")
        .when(message.contains("encoding"), "encoding")
        .otherwise("file_error")
    )
    found = (
        F.when(F.col("area") == "network", network)
        .when(F.col("area") == "parsing", parsing)
        .when(F.col("area") == "data", data)
        .when(F.col("area") == "file", file)
        .when(F.col("area") == "validation", "invalid_value")
        .otherwise("unknown")
    )
    final = ("not_found", "invalid_url", "file_not_found")
    return log.withColumn("failure_class", found).withColumn(
        "retryable", ~F.col("failure_class").isin(*final)
    )
