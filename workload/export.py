"""Writers: every query writes to the scratch folder and reads the files back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators.catalog import export_statistics
from tablewright.session import scratch_path
from tablewright.sources.writers import (
    ExportOptions,
    read_dataset,
    write_dataset,
    write_formats,
    write_logged,
)
from workload.views import read, spark_view

_EVENT_DDL = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"


def _events(spark, sf):
    return spark_view(spark, sf, "events_gaps")


def csv(spark, sf):
    path = scratch_path(spark, "events") + ".csv"
    write_dataset(_events(spark, sf), path, ExportOptions(delimiter=";"))
    text = "event_id string, ts string, user_id string, event_type string, value string"
    return spark.read.option("sep", ";").option("header", True).schema(text).csv(path)


def csv_documents(spark, sf):
    """Texts with quotes, delimiters and line breaks survive."""
    path = scratch_path(spark, "documents") + ".csv"
    write_dataset(read(spark, sf, "documents"), path)
    ddl = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    return read_dataset(spark, path, "csv", ddl)


def json_records(spark, sf):
    path = scratch_path(spark, "events") + ".json"
    write_dataset(_events(spark, sf), path)
    return read_dataset(spark, path, "json", _EVENT_DDL)


def json_metadata(spark, sf):
    path = scratch_path(spark, "events") + ".json"
    write_dataset(_events(spark, sf), path, ExportOptions(json_orient="table"))
    facts = spark.read.json(f"{path}/metadata")
    return facts.select(
        "total_records", "total_columns", F.array_join("columns", ",").alias("columns"), "orientation"
    )


def json_index(spark, sf):
    path = scratch_path(spark, "events") + ".json"
    slim = _events(spark, sf).select("event_id", "user_id", "event_type")
    write_dataset(slim, path, ExportOptions(json_orient="index", index_column="event_id"))
    lines = spark.read.text(f"{path}/data")
    entry = F.from_json("value", "map<string,struct<user_id:bigint,event_type:string>>")
    return lines.select(F.explode(entry).alias("row_id", "r")).select("row_id", "r.*")


def json_values(spark, sf):
    path = scratch_path(spark, "events") + ".json"
    slim = _events(spark, sf).select("event_id", "event_type", "user_id")
    write_dataset(slim, path, ExportOptions(json_orient="values"))
    return spark.read.text(f"{path}/data").select(F.col("value").alias("line"))


def json_split(spark, sf):
    path = scratch_path(spark, "events") + ".json"
    slim = _events(spark, sf).select("event_id", "event_type", "user_id")
    write_dataset(slim, path, ExportOptions(json_orient="split", index_column="event_id"))
    return spark.read.text(f"{path}/data").select(F.col("value").alias("line"))


def parquet(spark, sf):
    path = scratch_path(spark, "orders") + ".parquet"
    options = ExportOptions(compression="zstd", partition_by=("o_orderstatus",))
    write_dataset(read(spark, sf, "orders"), path, options)
    return read_dataset(spark, path, "parquet").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"
    )


def xml(spark, sf):
    path = scratch_path(spark, "events") + ".xml"
    write_dataset(_events(spark, sf).drop("ts"), path)
    ddl = "event_id bigint, user_id bigint, event_type string, value double"
    return read_dataset(spark, path, "xml", ddl)


def html(spark, sf):
    path = scratch_path(spark, "events") + ".html"
    write_dataset(_events(spark, sf), path)
    return read_dataset(spark, path, "html").select(F.col("value").alias("line"))


def multi(spark, sf):
    base = scratch_path(spark, "orders")
    orders = read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    results = write_formats(orders, base, ["csv", "json", "parquet", "xml", "nosuch"])
    ddl = "o_orderkey bigint, o_custkey bigint"
    counts = [
        read_dataset(spark, f"{base}.{fmt}", fmt, ddl).agg(
            F.lit(fmt).alias("format"), F.lit(True).alias("ok"), F.sum("o_orderkey").alias("checksum")
        )
        for fmt, problem in results.items()
        if problem is None
    ]
    failed = [
        orders.agg(F.lit(fmt).alias("format"), F.lit(False).alias("ok"), F.max(F.lit(None).cast("bigint")).alias("checksum"))
        for fmt, problem in results.items()
        if problem is not None
    ]
    out = counts[0]
    for other in counts[1:] + failed:
        out = out.unionByName(other)
    return out


def logged(spark, sf):
    """Three exports, one of them refused, and the statistics of their log."""
    base, log = scratch_path(spark, "orders"), scratch_path(spark, "log")
    orders = read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    for suffix in ("csv", "json", "docx"):
        write_logged(orders, f"{base}.{suffix}", log)
    stats = export_statistics(spark.read.parquet(log).withColumn("file_size_mb", F.lit(0.0)))
    return stats.select(
        "total_exports", "successful_exports", "failed_exports", "success_rate", "total_records_exported"
    )


QUERIES = {
    "export_logged": logged,
    "export_csv": csv,
    "export_csv_documents": csv_documents,
    "export_json_records": json_records,
    "export_json_metadata": json_metadata,
    "export_json_index": json_index,
    "export_json_values": json_values,
    "export_json_split": json_split,
    "export_parquet": parquet,
    "export_xml": xml,
    "export_html": html,
    "export_multi": multi,
}

_GAPS = """(SELECT event_id, ts, user_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS event_type,
  CASE WHEN event_id % 7 IN (0, 1) THEN NULL ELSE value END AS value FROM events)"""
_JSON_TYPE = "coalesce('\"' || event_type || '\"', 'null')"

ORACLES = {
    "export_logged": """SELECT CAST(3 AS BIGINT) AS total_exports, CAST(2 AS BIGINT) AS successful_exports,
  CAST(1 AS BIGINT) AS failed_exports, 66.666667::DOUBLE AS success_rate, 2 * count(*) AS total_records_exported FROM orders""",
    "export_csv": f"""SELECT CAST(event_id AS VARCHAR) AS event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
  CAST(user_id AS VARCHAR) AS user_id, event_type, format('{{:.2f}}', value) AS value FROM {_GAPS}""",
    "export_csv_documents": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "export_json_records": f"SELECT * FROM {_GAPS}",
    "export_json_metadata": """SELECT count(*) AS total_records, CAST(5 AS BIGINT) AS total_columns,
  'event_id,ts,user_id,event_type,value' AS columns, 'table' AS orientation FROM events""",
    "export_json_index": f"SELECT CAST(event_id AS VARCHAR) AS row_id, user_id, event_type FROM {_GAPS}",
    "export_json_values": f"SELECT '[' || event_id || ',' || {_JSON_TYPE} || ',' || user_id || ']' AS line FROM {_GAPS}",
    "export_json_split": f"SELECT '[' || event_id || ',[' || {_JSON_TYPE} || ',' || user_id || ']]' AS line FROM {_GAPS}",
    "export_parquet": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders",
    "export_xml": f"SELECT event_id, user_id, event_type, value FROM {_GAPS}",
    "export_html": f"""SELECT '<tr><td>' || event_id || '</td><td>' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '</td><td>' || user_id
  || '</td><td>' || coalesce(event_type, '') || '</td><td>' || coalesce(format('{{:.2f}}', value), '') || '</td></tr>' AS line FROM {_GAPS}""",
    "export_multi": """SELECT unnest(['csv', 'json', 'parquet', 'xml', 'nosuch']) AS format,
  unnest([true, true, true, true, false]) AS ok,
  unnest([s, s, s, s, NULL]) AS checksum FROM (SELECT CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders)""",
}
