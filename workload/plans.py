"""Automatic cleaning, recipes, versions, differences and audit."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tablewright.operators import audit
from tablewright.operators.dedup import drop_duplicates
from tablewright.operators.text import clean_text
from tablewright.plans.auto_clean import auto_clean
from tablewright.plans.history import CleaningSession
from tablewright.plans.recipe import Recipe
from tablewright.session import scratch_path
from workload.views import read, spark_view, with_view

RECIPE = json.dumps(
    {
        "name": "documents",
        "steps": [
            {
                "operation": "drop_duplicates",
                "parameters": {"subset": ["text"], "keep": "first", "order_by": ["doc_id"]},
            },
            {
                "operation": "clean_text",
                "parameters": {"columns": ["text"], "operations": ["remove_extra_spaces", "lowercase"]},
            },
            {"operation": "rename_columns", "parameters": {"mapping": {"text": "body"}}},
            {"operation": "filter_rows", "parameters": {"condition": "n_chars >= 100"}},
        ],
        "export": {"format": "parquet"},
    }
)


def auto_clean_gentle(spark, sf):
    out, _ = auto_clean(spark_view(spark, sf, "events_messy"))
    return out


def auto_clean_aggressive(spark, sf):
    out, _ = auto_clean(spark_view(spark, sf, "events_messy"), aggressive=True)
    return out


def auto_clean_report(spark, sf):
    messy = spark_view(spark, sf, "events_messy")
    _, report = auto_clean(messy)
    return report.to_frame(messy)


def recipe_replay(spark, sf):
    recipe = Recipe.from_json(Recipe.from_json(RECIPE).to_json())
    return recipe.run(read(spark, sf, "documents"))


def recipe_export(spark, sf):
    """The same recipe with its export settings, read back from the written files."""
    return Recipe.from_json(RECIPE).run_and_export(read(spark, sf, "documents"), scratch_path(spark, "recipe"))


def recipe_long(spark, sf):
    """Twenty-five steps in a session; the recipe it leaves gives the same table."""
    docs = read(spark, sf, "documents").select("doc_id", "n_chars")
    session = CleaningSession(docs)
    for i in range(25):
        session.apply("add_columns", expressions={f"step_{i}": f"n_chars + {i}"})
    return session.to_recipe("long").run(docs)


def undo_redo(spark, sf):
    """Two steps, back twice, forward once, then a new step in place of the second."""
    session = CleaningSession(read(spark, sf, "documents").select("doc_id", "text", "lang"))
    session.apply("drop_duplicates", subset=["text"], keep="last", order_by=["doc_id"])
    session.apply("clean_text", columns=["text"], operations=["uppercase"])
    session.undo()
    session.undo()
    session.redo()
    session.apply("clean_text", columns=["text"], operations=["remove_numbers"])
    return session.data


def _before_after(spark, sf):
    before = read(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    unique = drop_duplicates(before, ["text"], "first", ["doc_id"])
    return before, clean_text(unique, ["text", "lang"], ["remove_extra_spaces"])


def before_after_diff(spark, sf):
    return audit.diff_tables(*_before_after(spark, sf), ["doc_id"])


def changed_counts(spark, sf):
    before = spark_view(spark, sf, "docs_messy")
    after = clean_text(before, ["txt"], ["remove_html_tags"])
    return audit.changed_values(before, after, ["doc_id"], ["txt"])


def audit_steps(spark, sf):
    recipe = Recipe.from_json(RECIPE)
    _, steps = recipe.run_with_audit(read(spark, sf, "documents"), ["doc_id"])
    return steps.select("step", "operation", "columns", "records_affected")


QUERIES = {
    "auto_clean": auto_clean_gentle,
    "auto_clean_aggressive": auto_clean_aggressive,
    "auto_clean_report": auto_clean_report,
    "recipe_replay": recipe_replay,
    "recipe_export": recipe_export,
    "recipe_long": recipe_long,
    "undo_redo": undo_redo,
    "before_after_diff": before_after_diff,
    "changed_values": changed_counts,
    "audit_steps": audit_steps,
}

_SPACE = r"\t-\r\x1c-\x20\x{85}\p{Z}"


def _tidy(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{_SPACE}]+', ' ', 'g'))"


_DOCS = "SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"

_CLEAN = """, distinct_rows AS (
  SELECT DISTINCT event_id, user_id, event_type, value, sparse_col, half_col, num_txt FROM events_messy
  WHERE event_id IS NOT NULL
), tidy AS (SELECT event_id, user_id, trim(event_type) AS event_type, value, half_col, trim(num_txt) AS num_txt
  FROM distinct_rows)"""

ORACLES = {
    "auto_clean": with_view(
        "events_messy",
        _CLEAN
        + """
SELECT event_id, user_id, event_type, coalesce(value, (SELECT median(value) FROM tidy)) AS value,
  coalesce(half_col, (SELECT median(half_col) FROM tidy)) AS half_col, CAST(num_txt AS BIGINT) AS num_txt FROM tidy""",
    ),
    "auto_clean_aggressive": with_view(
        "events_messy",
        _CLEAN
        + """, filled AS (
  SELECT event_id, user_id, lower(event_type) AS event_type,
    coalesce(value, (SELECT median(value) FROM tidy)) AS value, CAST(num_txt AS BIGINT) AS num_txt FROM tidy
), q AS (SELECT quantile_cont(event_id, 0.25) AS e1, quantile_cont(event_id, 0.75) AS e3,
  quantile_cont(user_id, 0.25) AS u1, quantile_cont(user_id, 0.75) AS u3,
  quantile_cont(value, 0.25) AS v1, quantile_cont(value, 0.75) AS v3 FROM filled)
SELECT filled.* FROM filled, q WHERE event_id BETWEEN e1 - 2 * (e3 - e1) AND e3 + 2 * (e3 - e1)
  AND user_id BETWEEN u1 - 2 * (u3 - u1) AND u3 + 2 * (u3 - u1)
  AND value BETWEEN v1 - 2 * (v3 - v1) AND v3 + 2 * (v3 - v1)""",
    ),
    "auto_clean_report": with_view(
        "events_messy",
        """, c AS (SELECT count(*) AS n, count(event_id) AS filled,
    (SELECT count(*) FROM (SELECT DISTINCT * FROM events_messy WHERE event_id IS NOT NULL)) AS kept,
    (SELECT (kept_rows - with_value) * 100.0 / kept_rows FROM (SELECT count(*) AS kept_rows, count(sparse_col) AS with_value
      FROM (SELECT DISTINCT * FROM events_messy WHERE event_id IS NOT NULL))) AS sparse FROM events_messy)
SELECT 'rows_before' AS measure, CAST(n AS VARCHAR) AS value FROM c
UNION ALL SELECT 'rows_after', CAST(kept AS VARCHAR) FROM c
UNION ALL SELECT 'rows_removed', CAST(n - kept AS VARCHAR) FROM c
UNION ALL SELECT 'columns_before', '8' UNION ALL SELECT 'columns_after', '6' UNION ALL SELECT 'columns_removed', '2'
UNION ALL SELECT 'operations', 'fixed encoding; removed duplicates; cleaned text; filled numbers with median; converted types'
UNION ALL SELECT 'issues', format('removed 1 empty columns; removed {} empty rows; removed {} duplicate rows; removed column sparse_col ({:.1f}% missing)',
  n - filled, filled - kept, CAST(sparse AS DOUBLE)) FROM c""",
    ),
    "recipe_export": f"""SELECT doc_id, lower({_tidy('text')}) AS body, lang, source, n_chars
FROM ({_DOCS}) WHERE n_chars >= 100""",
    "recipe_long": f"SELECT doc_id, n_chars, {', '.join(f'n_chars + {i} AS step_{i}' for i in range(25))} FROM documents",
    "recipe_replay": f"""SELECT doc_id, lower({_tidy('text')}) AS body, lang, source, n_chars
FROM ({_DOCS}) WHERE n_chars >= 100""",
    "undo_redo": """SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\\p{Nd}+', '', 'g'), '[%s]+', ' ', 'g')) AS text, lang
FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) = 1"""
    % _SPACE,
    "before_after_diff": f"""
WITH d AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS gone FROM documents)
SELECT doc_id, 'removed' AS change, "column", v AS old_value, NULL AS new_value FROM (
  SELECT doc_id, 'text' AS "column", text AS v FROM d WHERE gone UNION ALL SELECT doc_id, 'lang', lang FROM d WHERE gone
  UNION ALL SELECT doc_id, 'source', source FROM d WHERE gone)
UNION ALL SELECT doc_id, 'changed', 'text', text, {_tidy('text')} FROM d
WHERE NOT gone AND text <> {_tidy('text')}""",
    "changed_values": with_view(
        "docs_messy",
        f"""SELECT 'txt' AS "column", count(*) FILTER (
  WHERE txt IS DISTINCT FROM {_tidy("regexp_replace(txt, '<[^>]+>', '', 'g')")}) AS changed FROM docs_messy""",
    ),
    "audit_steps": f"""
WITH d AS ({_DOCS}), total AS (SELECT count(*) AS n FROM documents)
SELECT CAST(1 AS INTEGER) AS step, 'drop_duplicates' AS operation, 'text' AS columns,
  (SELECT n FROM total) - (SELECT count(*) FROM d) AS records_affected
UNION ALL SELECT 2, 'clean_text', 'text', (SELECT count(*) FROM d WHERE text <> lower({_tidy('text')}))
UNION ALL SELECT 3, 'rename_columns', 'text', 0
UNION ALL SELECT 4, 'filter_rows', '', (SELECT count(*) FROM d WHERE n_chars < 100)""",
}
