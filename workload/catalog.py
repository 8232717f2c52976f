"""Run logs and dataset catalogs: events as a log, orders as a catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import catalog
from workload.views import read, spark_view, with_view


def _runs(spark, sf):
    return spark_view(spark, sf, "runs")


def _failures(spark, sf):
    return spark_view(spark, sf, "failures")


def _projects(spark, sf):
    return spark_view(spark, sf, "projects").withColumn("tags", F.array("tag1", "tag2"))


def export_stats(spark, sf):
    return catalog.export_statistics(_runs(spark, sf))


def format_breakdown(spark, sf):
    return catalog.format_breakdown(_runs(spark, sf))


def timing(spark, sf):
    return catalog.operation_timing(_runs(spark, sf), "format", "execution_time")


def recent_exports(spark, sf):
    return catalog.recent_exports(_runs(spark, sf), "ts", ["run_id"]).select("run_id", "format", "success")


def error_stats(spark, sf):
    return catalog.error_statistics(_failures(spark, sf), "ts", ["event_id"], "area", window=50)


def error_stats_all(spark, sf):
    return catalog.error_statistics(_failures(spark, sf), "ts", ["event_id"], "area")


def recent_errors(spark, sf):
    classified = catalog.classify_failures(_failures(spark, sf))
    latest = catalog.recent_errors(classified, "ts", ["event_id"])
    return latest.select("event_id", "area", "failure_class", "retryable")


def classify_failures(spark, sf):
    classified = catalog.classify_failures(_failures(spark, sf))
    return classified.select("event_id", "failure_class", "retryable")


def failure_advice(spark, sf):
    advised = catalog.failure_advice(catalog.classify_failures(_failures(spark, sf)))
    return advised.select("event_id", "failure_class", "user_message", "suggested_action")


def catalog_list(spark, sf):
    return catalog.list_catalog(_projects(spark, sf)).select("name", "last_modified")


def catalog_search(spark, sf):
    found = catalog.search_catalog(
        _projects(spark, sf), " Urgent ", ["name", "description", "tags", "url"]
    )
    return found.select("name", "description")


def catalog_stats(spark, sf):
    return catalog.catalog_statistics(_projects(spark, sf))


def top_tags(spark, sf):
    return catalog.top_tags(_projects(spark, sf))


def projects_per_month(spark, sf):
    return catalog.per_month(_projects(spark, sf))


def recent_activity(spark, sf):
    newest = catalog.newest(_projects(spark, sf), catalog.RECENT_ACTIVITY, "last_modified", ["name"])
    return newest.select("name", "last_modified")


def recent_urls(spark, sf):
    """Users as keys, most recently active first."""
    return catalog.recent_distinct(read(spark, sf, "events"), "user_id", "ts", catalog.RECENT_URLS)


def retention(spark, sf):
    return catalog.retain_recent(_runs(spark, sf), "ts", 3).select("run_id", "ts")


QUERIES = {
    "operation_timing": timing,
    "export_stats": export_stats,
    "format_breakdown": format_breakdown,
    "recent_exports": recent_exports,
    "error_stats": error_stats,
    "error_stats_all": error_stats_all,
    "recent_errors": recent_errors,
    "classify_failures": classify_failures,
    "failure_advice": failure_advice,
    "catalog_list": catalog_list,
    "catalog_search": catalog_search,
    "catalog_stats": catalog_stats,
    "top_tags": top_tags,
    "projects_per_month": projects_per_month,
    "recent_activity": recent_activity,
    "recent_distinct": recent_urls,
    "retention": retention,
}

_CLASS = """CASE area
  WHEN 'network' THEN CASE WHEN error = 'ConnectionError' THEN 'connection' WHEN error = 'Timeout' THEN 'timeout'
    WHEN error = 'HTTPError' THEN CASE WHEN status_code = 404 THEN 'not_found' WHEN status_code = 403 THEN 'forbidden'
      WHEN status_code >= 500 THEN 'server_error' ELSE 'http_error' END
    WHEN error = 'InvalidURL' THEN 'invalid_url' ELSE 'network_error' END
  WHEN 'parsing' THEN CASE WHEN m LIKE '%lxml%' THEN 'invalid_structure' WHEN m LIKE '%encoding%' THEN 'encoding'
    WHEN m LIKE '%empty%' THEN 'empty_page' ELSE 'unparseable' END
  WHEN 'data' THEN CASE WHEN m LIKE '%memory%' OR error = 'MemoryError' THEN 'out_of_memory'
    WHEN m LIKE '%type%' THEN 'type_conversion' WHEN m LIKE '%index%' OR error IN ('IndexError', 'KeyError') THEN 'missing_column'
    WHEN m LIKE '%duplicate%' THEN 'duplicate_handling' ELSE 'data_error' END
  WHEN 'file' THEN CASE WHEN error = 'FileNotFoundError' THEN 'file_not_found' WHEN error = 'PermissionError' THEN 'permission_denied'
    WHEN error = 'OSError' AND m LIKE '%disk%' THEN 'disk_full' WHEN m LIKE '%encoding%' THEN 'encoding' ELSE 'file_error' END
  WHEN 'validation' THEN 'invalid_value' ELSE 'unknown' END"""
_CLASSIFIED = f"""SELECT *, c AS failure_class, c NOT IN ('not_found', 'invalid_url', 'file_not_found') AS retryable
FROM (SELECT *, {_CLASS} AS c FROM (SELECT *, lower(message) AS m FROM failures))"""



def _advice(i: int) -> str:
    cases = " ".join(f"WHEN '{kind}' THEN '{_sql(texts[i])}'" for kind, texts in catalog.FAILURE_ADVICE.items())
    return f"CASE failure_class {cases} END"


def _sql(text: str) -> str:
    return text.replace("'", "''")


ORACLES = {
    "operation_timing": with_view(
        "runs",
        """SELECT format AS operation, count(*) AS runs, round(sum(execution_time), 3) AS total_seconds,
  round(avg(execution_time), 3) AS average_seconds, round(max(execution_time), 3) AS longest_seconds FROM runs GROUP BY format""",
    ),
    "export_stats": with_view(
        "runs",
        """SELECT count(*) AS total_exports, count(*) FILTER (WHERE success) AS successful_exports,
  count(*) FILTER (WHERE NOT success) AS failed_exports,
  round(count(*) FILTER (WHERE success) * 100.0::DOUBLE / count(*), 6) AS success_rate,
  CAST(sum(records_exported) FILTER (WHERE success) AS BIGINT) AS total_records_exported,
  round(sum(file_size_mb) FILTER (WHERE success), 2) AS total_file_size_mb,
  round(avg(execution_time) FILTER (WHERE success), 2) AS average_execution_time FROM runs""",
    ),
    "format_breakdown": with_view("runs", "SELECT format, count(*) AS exports FROM runs GROUP BY 1"),
    "recent_exports": with_view(
        "runs", "SELECT run_id, format, success FROM runs ORDER BY ts DESC, run_id DESC LIMIT 10"
    ),
    "error_stats": with_view(
        "failures",
        """SELECT area AS error_type, count(*) AS recent_count, (SELECT count(*) FROM failures) AS total_errors
FROM (SELECT * FROM failures ORDER BY ts DESC, event_id DESC LIMIT 50) GROUP BY 1""",
    ),
    "error_stats_all": with_view(
        "failures",
        """SELECT area AS error_type, count(*) AS recent_count, (SELECT count(*) FROM failures) AS total_errors
FROM failures GROUP BY 1""",
    ),
    "recent_errors": with_view(
        "failures",
        f"""SELECT event_id, area, failure_class, retryable FROM ({_CLASSIFIED})
ORDER BY ts DESC, event_id DESC LIMIT 10""",
    ),
    "classify_failures": with_view(
        "failures", f"SELECT event_id, failure_class, retryable FROM ({_CLASSIFIED})"
    ),
    "failure_advice": with_view(
        "failures",
        f"""SELECT event_id, failure_class, {_advice(0)} AS user_message, {_advice(1)} AS suggested_action
FROM ({_CLASSIFIED})""",
    ),
    "catalog_list": with_view(
        "projects", "SELECT name, last_modified FROM projects ORDER BY last_modified DESC, name"
    ),
    "catalog_search": with_view(
        "projects",
        """SELECT name, description FROM projects WHERE contains(lower(name), 'urgent')
  OR contains(lower(description), 'urgent') OR contains(lower(tag1), 'urgent') OR contains(lower(tag2), 'urgent')""",
    ),
    "catalog_stats": with_view(
        "projects",
        """SELECT count(*) AS total_projects, min(created_date) AS oldest_project_date, max(created_date) AS newest_project_date,
  round(CAST(sum(file_size) AS DOUBLE) / 1024 / 1024, 2) AS total_size_mb,
  round(CAST(sum(file_size) AS DOUBLE) / count(*) / 1024, 2) AS average_size_kb FROM projects""",
    ),
    "top_tags": with_view(
        "projects",
        """SELECT tag, count(*) AS uses FROM (SELECT tag1 AS tag FROM projects UNION ALL SELECT tag2 FROM projects)
GROUP BY 1 ORDER BY uses DESC, tag LIMIT 10""",
    ),
    "projects_per_month": with_view(
        "projects",
        "SELECT strftime(created_date, '%Y-%m') AS month, count(*) AS projects FROM projects GROUP BY 1",
    ),
    "recent_activity": with_view(
        "projects",
        "SELECT name, last_modified FROM projects ORDER BY last_modified DESC, name DESC LIMIT 5",
    ),
    "recent_distinct": """SELECT user_id, max(ts) AS last_used FROM events GROUP BY 1
ORDER BY last_used DESC, user_id LIMIT 20""",
    "retention": with_view(
        "runs", "SELECT run_id, ts FROM runs WHERE ts >= (SELECT max(ts) FROM runs) - INTERVAL 3 DAY"
    ),
}
