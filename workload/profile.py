"""Summaries, quality, type inference and export estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import profile
from tablewright.sources.writers import ExportOptions
from workload.views import read, spark_view, with_view

_ORDER_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]


def _gaps(spark, sf):
    return spark_view(spark, sf, "events_gaps")


def summary_missing(spark, sf):
    return profile.missing_summary(_gaps(spark, sf))


def summary_numeric(spark, sf):
    out = profile.numeric_summary(_gaps(spark, sf).select("event_id", "user_id", "value"))
    rounded = [F.round(c, 6).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")]
    return out.select("column", "count", *rounded)


def summary_text(spark, sf):
    return profile.text_summary(read(spark, sf, "documents"), ["text", "lang", "source"])


def summary_text_gaps(spark, sf):
    return profile.text_summary(_gaps(spark, sf).select("event_type"))


def shape_bytes(spark, sf):
    return profile.shape_summary(read(spark, sf, "documents"))


def export_size(spark, sf):
    return profile.export_size_estimate(read(spark, sf, "documents"))


def export_profile(spark, sf):
    orders = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    out = profile.export_profile(orders)
    return out.select(
        "column", "dtype", "rows", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "display_width"
    )


def export_metadata(spark, sf):
    orders = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    out = profile.export_metadata(orders, ExportOptions(format="csv", encoding="utf-16"))
    return out.filter("item <> 'export_date'")


def quality_events(spark, sf):
    return profile.quality_score(spark_view(spark, sf, "events_messy"))


def quality_documents(spark, sf):
    return profile.quality_score(spark_view(spark, sf, "docs_messy").select("txt"))


def quality_issues_events(spark, sf):
    return profile.quality_issues(spark_view(spark, sf, "events_messy")).select("column", "issue", "cells")


def quality_issues_documents(spark, sf):
    return profile.quality_issues(spark_view(spark, sf, "docs_messy").select("txt")).select("column", "issue", "cells")


def infer_types(spark, sf):
    return profile.infer_types(spark_view(spark, sf, "mixed_txt"))


def apply_inferred(spark, sf):
    return profile.apply_inferred_types(spark_view(spark, sf, "mixed_txt"))


QUERIES = {
    "summary_missing": summary_missing,
    "summary_numeric": summary_numeric,
    "summary_text": summary_text,
    "summary_text_gaps": summary_text_gaps,
    "shape_bytes": shape_bytes,
    "export_size_estimate": export_size,
    "export_profile": export_profile,
    "export_metadata": export_metadata,
    "quality_score_events": quality_events,
    "quality_score_documents": quality_documents,
    "quality_issues_events": quality_issues_events,
    "quality_issues_documents": quality_issues_documents,
    "infer_types": infer_types,
    "apply_inferred_types": apply_inferred,
}

_NULLS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS missing, count(*) AS rows FROM events_gaps"
    for c in ("event_id", "ts", "user_id", "event_type", "value")
)
_DESCRIBE = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
  round(CAST(min({c}) AS DOUBLE), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
  round(quantile_cont({c}, 0.75), 6) AS p75, round(CAST(max({c}) AS DOUBLE), 6) AS max FROM events_gaps"""
    for c in ("event_id", "user_id", "value")
)


def _top(table: str, column: str) -> str:
    return f"""SELECT '{column}' AS "column", (SELECT count(DISTINCT {column}) FROM {table}) AS unique_values,
  CAST(row_number() OVER (ORDER BY n DESC, v) AS INTEGER) AS rank, v AS value, n AS count
FROM (SELECT {column} AS v, count(*) AS n FROM {table} WHERE {column} IS NOT NULL GROUP BY 1)
QUALIFY row_number() OVER (ORDER BY n DESC, v) <= 3"""


_BYTES = """strlen(CAST(doc_id AS VARCHAR)) + strlen(text) + strlen(lang) + strlen(source) + strlen(CAST(n_chars AS VARCHAR))"""
_SPACE = r"\t-\r\x1c-\x20\x{85}\p{Z}"
_BAND = "CASE WHEN s < 60 THEN 'poor' WHEN s < 80 THEN 'moderate' ELSE 'good' END"
_ISSUES = """concat_ws('; ', CASE WHEN mp > 20 THEN 'high missing data' END, CASE WHEN dp > 5 THEN 'high duplicate records' END,
  CASE WHEN inc > 0 THEN 'numbers stored as text' END, CASE WHEN outl > 0 THEN 'high outlier count' END,
  CASE WHEN ti > 0 THEN 'text needs cleaning' END)"""
_SCORE = f"""SELECT n AS rows, round(mp, 6) AS missing_percent, round(dp, 6) AS duplicate_percent, inc AS inconsistent_columns,
  outl AS outlier_columns, ti AS text_issues, round(s, 6) AS overall_score, {_BAND} AS band, {_ISSUES} AS issues FROM (
  SELECT *, greatest(0, 100 - least(mp, 30) - least(dp, 20) - inc * 5 - outl * 3 - ti * 2) AS s FROM parts)"""
_NUMERIC = ("event_id", "user_id", "value", "empty_col", "sparse_col", "half_col")
_ALL = ("event_id", "user_id", "event_type", "value", "empty_col", "sparse_col", "half_col", "num_txt")
_TEXT = ("event_type", "num_txt")
_IS_NUMBER = r"regexp_matches(trim({0}), '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$')"


def _outlier(c: str) -> str:
    return f"""(SELECT (count(*) > 0.05 * (SELECT count(*) FROM events_messy))::BIGINT FROM events_messy,
  (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM events_messy)
  WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))"""


def _texty(table: str, c: str) -> tuple[str, str]:
    inconsistent = f"(count(*) FILTER (WHERE {_IS_NUMBER.format(c)}) > 0.8 * count(*))::BIGINT"
    issues = (
        f"(count(*) FILTER (WHERE regexp_matches({c}, '[{_SPACE}]{{2,}}')) > 0)::BIGINT"
        f" + (count(*) FILTER (WHERE regexp_matches({c}, '[^\\p{{L}}\\p{{N}}_{_SPACE}]')) > 0.3 * count(*))::BIGINT"
    )
    return inconsistent, issues


def _issues(table: str, columns: tuple[str, ...], numeric: tuple[str, ...], text: tuple[str, ...]) -> str:
    """Every fault of a table by name."""

    def fault(column: str, issue: str, cells: str, limit: str) -> str:
        return f"""SELECT {column} AS "column", '{issue}' AS issue, CAST({cells} AS BIGINT) AS cells FROM {table} HAVING {cells} > {limit}"""

    missing = f"sum({' + '.join(f'({c} IS NULL)::INT' for c in columns)})"
    copies = f"(count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(columns)} FROM {table})))"
    parts = [
        fault("NULL", "high missing data", missing, f"0.2 * {len(columns)} * count(*)"),
        fault("NULL", "high duplicate records", copies, "0.05 * count(*)"),
    ]
    for c in text:
        number = f"count(*) FILTER (WHERE {_IS_NUMBER.format(c)})"
        gaps = f"count(*) FILTER (WHERE regexp_matches({c}, '[{_SPACE}]{{2,}}'))"
        special = f"count(*) FILTER (WHERE regexp_matches({c}, '[^\\p{{L}}\\p{{N}}_{_SPACE}]'))"
        parts += [
            fault(f"'{c}'", "numbers stored as text", number, "0.8 * count(*)"),
            fault(f"'{c}'", "excessive whitespace", gaps, "0"),
            fault(f"'{c}'", "many special characters", special, "0.3 * count(*)"),
        ]
    for c in numeric:
        parts.append(
            f"""SELECT '{c}', 'high outlier count', count(*) FROM {table},
  (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {table})
  WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) HAVING count(*) > 0.05 * (SELECT count(*) FROM {table})"""
        )
    return " UNION ALL ".join(f"({p})" for p in parts)


_EVENT_TEXT = [_texty("events_messy", c) for c in _TEXT]
_DOC_TEXT = _texty("docs_messy", "txt")

ORACLES = {
    "summary_missing": with_view(
        "events_gaps",
        f"""SELECT "column", missing, rows, round(missing * 100.0 / rows, 2) AS missing_percent,
  CAST(sum(missing) OVER () AS BIGINT) AS total_missing FROM ({_NULLS})""",
    ),
    "summary_numeric": with_view("events_gaps", _DESCRIBE),
    "summary_text": " UNION ALL ".join(
        f"(SELECT * FROM ({_top('documents', c)}))" for c in ("text", "lang", "source")
    ),
    "summary_text_gaps": with_view("events_gaps", _top("events_gaps", "event_type")),
    "shape_bytes": f"""SELECT count(*) AS rows, CAST(5 AS BIGINT) AS columns, CAST(sum({_BYTES}) AS BIGINT) AS bytes,
  'bigint=2,string=3' AS column_types FROM documents""",
    "export_size_estimate": f"""SELECT format, round(factor * b, 1) AS estimated_bytes FROM
  (SELECT CAST(sum({_BYTES}) AS DOUBLE) AS b FROM documents),
  (SELECT unnest(['xlsx', 'csv', 'json']) AS format, unnest([0.8::DOUBLE, 1.2::DOUBLE, 1.5::DOUBLE]) AS factor)""",
    "export_profile": """
SELECT 'o_orderkey' AS "column", 'bigint' AS dtype, count(*) AS rows, round(avg(o_orderkey), 6) AS mean,
  round(stddev_samp(o_orderkey), 6) AS std,
  CAST(least(greatest(10, max(length(CAST(o_orderkey AS VARCHAR)))) + 2, 50) AS INTEGER) AS display_width FROM orders
UNION ALL SELECT 'o_custkey', 'bigint', count(*), round(avg(o_custkey), 6), round(stddev_samp(o_custkey), 6),
  CAST(least(greatest(9, max(length(CAST(o_custkey AS VARCHAR)))) + 2, 50) AS INTEGER) FROM orders
UNION ALL SELECT 'o_orderpriority', 'string', count(*), NULL, NULL,
  CAST(least(greatest(15, max(length(o_orderpriority))) + 2, 50) AS INTEGER) FROM orders""",
    "export_metadata": """
SELECT 'export' AS section, unnest(['total_records', 'total_columns', 'file_format', 'encoding', 'include_index']) AS item,
  unnest([count(*)::VARCHAR, '3', 'csv', 'utf-16', 'false']) AS value FROM orders
UNION ALL SELECT 'column', unnest(['o_orderkey', 'o_custkey', 'o_orderpriority']), unnest(['bigint', 'bigint', 'string'])
UNION ALL SELECT 'summary', 'o_orderkey', format('mean {:.2f}, std {:.2f}', avg(o_orderkey), stddev_samp(o_orderkey)) FROM orders
UNION ALL SELECT 'summary', 'o_custkey', format('mean {:.2f}, std {:.2f}', avg(o_custkey), stddev_samp(o_custkey)) FROM orders""",
    "quality_score_events": with_view(
        "events_messy",
        f""", parts AS (SELECT count(*) AS n,
    sum({' + '.join(f'({c} IS NULL)::INT' for c in _ALL)}) * 100.0::DOUBLE / (count(*) * {len(_ALL)}) AS mp,
    (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM events_messy))) * 100.0::DOUBLE / count(*) AS dp,
    {' + '.join(x for x, _ in _EVENT_TEXT)} AS inc, {' + '.join(_outlier(c) for c in _NUMERIC)} AS outl,
    {' + '.join(x for _, x in _EVENT_TEXT)} AS ti FROM events_messy)
{_SCORE}""",
    ),
    "quality_score_documents": with_view(
        "docs_messy",
        f""", parts AS (SELECT count(*) AS n, count(*) FILTER (WHERE txt IS NULL) * 100.0::DOUBLE / count(*) AS mp,
    (count(*) - (SELECT count(*) FROM (SELECT DISTINCT txt FROM docs_messy))) * 100.0::DOUBLE / count(*) AS dp,
    {_DOC_TEXT[0]} AS inc, 0::BIGINT AS outl, {_DOC_TEXT[1]} AS ti FROM docs_messy)
{_SCORE}""",
    ),
    "quality_issues_events": with_view("events_messy", _issues("events_messy", _ALL, _NUMERIC, _TEXT)),
    "quality_issues_documents": with_view("docs_messy", _issues("docs_messy", ("txt",), (), ("txt",))),
    "infer_types": with_view(
        "mixed_txt",
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {_IS_NUMBER.format(c)}) AS castable, count(*) AS rows,
  CASE WHEN count(*) FILTER (WHERE {_IS_NUMBER.format(c)}) > 0.8 * count(*) THEN
    CASE WHEN bool_and(TRY_CAST(trim({c}) AS DOUBLE) = floor(TRY_CAST(trim({c}) AS DOUBLE)))
      FILTER (WHERE {_IS_NUMBER.format(c)}) THEN 'integer' ELSE 'float' END
  WHEN bool_and(regexp_matches({c}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$')) THEN 'datetime'
  WHEN bool_and(lower({c}) IN ('true', 'false', 'yes', 'no', '1', '0', 'y', 'n')) THEN 'boolean' ELSE 'string' END
  AS inferred_type FROM mixed_txt"""
            for c in ("int_txt", "float_txt", "bool_txt", "date_txt", "free_txt", "tricky_txt")
        ),
    ),
    "apply_inferred_types": with_view(
        "mixed_txt",
        """SELECT event_id, TRY_CAST(int_txt AS BIGINT) AS int_txt, TRY_CAST(float_txt AS DOUBLE) AS float_txt,
  CASE lower(bool_txt) WHEN 'yes' THEN true WHEN 'no' THEN false END AS bool_txt,
  CAST(date_txt AS TIMESTAMP) AS date_txt, free_txt, tricky_txt FROM mixed_txt""",
    ),
}
