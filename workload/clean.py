"""Text, casts, formats, duplicates, missing values, outliers and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions import formats
from tablewright.operators import columns, dedup, missing, outliers, text
from workload.views import read, spark_view, with_view

SPACE = r"\t-\r\x1c-\x20\x{85}\p{Z}"


def _text_query(*operations):
    def run(spark, sf):
        return text.clean_text(spark_view(spark, sf, "docs_messy"), ["txt"], list(operations))

    return run


def _text_sql(expression: str) -> str:
    return with_view("docs_messy", f"SELECT doc_id, {expression} AS txt FROM docs_messy")


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{SPACE}]+', ' ', 'g'))"


_NO_SPECIAL = f"regexp_replace(txt, '[^\\p{{L}}\\p{{N}}_{SPACE}]', '', 'g')"
_REPAIRED = "txt"
for _bad, _good in (
    ("â€™", "''"), ("â€œ", '"'), ("â€", '"'), ("Ã¡", "á"), ("Ã©", "é"), ("Ã­", "í"),
    ("Ã³", "ó"), ("Ãº", "ú"), ("Ã±", "ñ"),
):
    _REPAIRED = f"replace({_REPAIRED}, '{_bad}', '{_good}')"


# --- casts -----------------------------------------------------------------

def _mixed(spark, sf) -> DataFrame:
    return spark_view(spark, sf, "mixed_txt")


def _converted(mapping):
    def run(spark, sf):
        return text.convert_types(_mixed(spark, sf), mapping)[0].select("event_id", *mapping)

    return run


def _number(c: str) -> str:
    return (
        f"CASE WHEN regexp_matches(trim({c}), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$')"
        f" THEN TRY_CAST(trim({c}) AS DOUBLE) END"
    )


def cast_category(spark, sf):
    named, _ = text.convert_types(_mixed(spark, sf), {"free_txt": "category"})
    coded = text.add_category_codes(named, "free_txt", "code")
    return text.add_category_codes(coded, "bool_txt", "bool_code").select(
        "event_id", "free_txt", "code", "bool_code"
    )


def cast_datetime_first_layout(spark, sf):
    contacts = spark_view(spark, sf, "contacts").select("id", "day")
    return text.convert_datetime(contacts, "day", ["id"])


# --- formats ---------------------------------------------------------------

def _contacts(spark, sf) -> DataFrame:
    return spark_view(spark, sf, "contacts")


def _formatted(column, rule):
    def run(spark, sf):
        return text.standardize_formats(_contacts(spark, sf), {column: rule}).select("id", column)

    return run


def email_validity(spark, sf):
    valid = formats.is_valid_email(F.col("email"))
    return _contacts(spark, sf).agg(
        F.count_if(valid).alias("valid"), F.count_if(~valid).alias("invalid")
    )


# --- duplicates ------------------------------------------------------------

def dedup_first(spark, sf):
    return dedup.drop_duplicates(read(spark, sf, "documents"), ["text"], "first", ["doc_id"])


def dedup_last(spark, sf):
    return dedup.drop_duplicates(read(spark, sf, "documents"), ["text"], "last", ["doc_id"])


def dedup_none(spark, sf):
    return dedup.drop_duplicates(
        read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "all"
    ).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate")


def dedup_rows(spark, sf):
    line = read(spark, sf, "lineitem").select("l_suppkey", "l_quantity", "l_returnflag")
    return dedup.drop_duplicates(line)


def dedup_hot_key(spark, sf):
    """Few keys, each with a large share of the rows."""
    events = read(spark, sf, "events").select("event_id", "event_type", "user_id", "value")
    return dedup.drop_duplicates(events, ["event_type"], "first", ["event_id"])


def dup_flag(spark, sf):
    docs = read(spark, sf, "documents")
    return dedup.flag_duplicates(docs, ["doc_id"], ["text"]).select("doc_id", "is_duplicate")


def dup_count(spark, sf):
    return dedup.duplicate_count(read(spark, sf, "documents"), ["text"])


# --- missing values --------------------------------------------------------

def _gaps(spark, sf) -> DataFrame:
    return spark_view(spark, sf, "events_gaps").select("event_id", "event_type", "value")


def _filled(strategy, **options):
    def run(spark, sf):
        return missing.handle_missing(_gaps(spark, sf), strategy, ["event_type", "value"], **options)

    return run


def missing_custom(spark, sf):
    filled = missing.fill_custom(_gaps(spark, sf), "unknown", ["event_type"])
    return missing.fill_custom(filled, -1, ["value"])


def missing_interpolate(spark, sf):
    out = missing.handle_missing(
        _gaps(spark, sf), "interpolate", ["value"], order_by=["event_id"]
    )
    return out.select("event_id", F.round("value", 6).alias("value"))


def missing_knn(spark, sf):
    out = missing.handle_missing(
        spark_view(spark, sf, "supplier_gaps"), "knn_impute", order_by=["s_suppkey"]
    )
    return out.select("s_suppkey", *[F.round(c, 6).alias(c) for c in ("x", "y", "z")])


def drop_empty_rows(spark, sf):
    bare = spark_view(spark, sf, "events_messy").select("event_type", "value", "half_col")
    return columns.drop_empty_rows(bare)


# --- outliers --------------------------------------------------------------

def outliers_iqr(spark, sf):
    kept = outliers.remove_outliers(_gaps(spark, sf), ["value", "event_type"], "iqr")
    return kept.select("event_id", "value")


def outliers_zscore(spark, sf):
    kept = outliers.remove_outliers(read(spark, sf, "events"), ["value"], "zscore", 3.0)
    return kept.select("event_id", "value")


def outlier_share(spark, sf):
    return outliers.outlier_share(_gaps(spark, sf), ["event_id", "value"])


# --- columns ---------------------------------------------------------------

def rename_reorder(spark, sf):
    orders = columns.rename_columns(
        read(spark, sf, "orders"), {"o_orderkey": "order_key", "o_totalprice": "total"}
    )
    return columns.reorder_columns(orders, ["total", "order_key"])


def drop_sparse(spark, sf):
    messy = columns.drop_empty_columns(spark_view(spark, sf, "events_messy"))
    return columns.drop_sparse_columns(messy, 0.8)


def column_ops(spark, sf):
    """Add, filter and drop columns, newest rows last."""
    orders = columns.add_columns(
        read(spark, sf, "orders"), {"month": "date_format(o_orderdate, 'yyyy-MM')"}
    )
    kept = columns.filter_rows(orders, "o_orderstatus = 'F'")
    slim = columns.drop_columns(kept, ["o_orderstatus", "o_orderpriority", "o_orderdate"])
    return columns.sort_rows(slim, ["o_orderkey"])


def preview(spark, sf):
    return columns.preview(read(spark, sf, "orders"), 10, ["o_orderkey"]).select(
        "o_orderkey", "o_custkey", "o_orderstatus"
    )


QUERIES = {
    "text_remove_special_chars": _text_query("remove_special_chars"),
    "text_remove_extra_spaces": _text_query("remove_extra_spaces"),
    "text_lowercase": _text_query("lowercase"),
    "text_uppercase": _text_query("uppercase"),
    "text_title_case": _text_query("title_case"),
    "text_remove_numbers": _text_query("remove_numbers"),
    "text_remove_html_tags": _text_query("remove_html_tags"),
    "text_normalize_whitespace": _text_query("normalize_whitespace"),
    "text_chain": _text_query(
        "remove_extra_spaces",
        "normalize_whitespace",
        "lowercase",
        "remove_html_tags",
        "remove_numbers",
        "remove_special_chars",
    ),
    "text_non_text_column": lambda spark, sf: text.clean_text(
        read(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], ["remove_extra_spaces"]
    ),
    "fix_encoding": lambda spark, sf: text.fix_encoding(spark_view(spark, sf, "docs_messy")),
    "fix_encoding_unicode": lambda spark, sf: text.fix_encoding(
        spark_view(spark, sf, "docs_messy"), ascii_only=False
    ),
    "cast_numeric": _converted({"tricky_txt": "numeric", "float_txt": "float", "free_txt": "numeric"}),
    "cast_integer": _converted({"int_txt": "integer", "float_txt": "integer"}),
    "cast_string": _converted({"int_txt": "string"}),
    "cast_datetime": _converted({"date_txt": "datetime", "free_txt": "datetime"}),
    "cast_datetime_first_layout": cast_datetime_first_layout,
    "cast_category": cast_category,
    "cast_boolean": _converted({"bool_txt": "boolean", "int_txt": "boolean"}),
    "format_phone": _formatted("phone", {"type": "phone"}),
    "format_date": _formatted("day", {"type": "date", "format": "%d %b %Y"}),
    "format_currency": _formatted("amount", {"type": "currency"}),
    "format_currency_text": _formatted("amount", {"type": "currency", "format": True, "symbol": "€"}),
    "format_email": _formatted("email", {"type": "email"}),
    "format_regex": _formatted(
        "phone", {"type": "regex", "pattern": r"(\d)\D+(\d)", "replacement": r"\2$\1"}
    ),
    "email_validity": email_validity,
    "dedup_first": dedup_first,
    "dedup_last": dedup_last,
    "dedup_none": dedup_none,
    "dedup_rows": dedup_rows,
    "dedup_hot_key": dedup_hot_key,
    "dup_flag": dup_flag,
    "dup_count": dup_count,
    "missing_drop": _filled("drop"),
    "missing_mean": _filled("fill_mean"),
    "missing_median": _filled("fill_median"),
    "missing_mode": _filled("fill_mode"),
    "missing_custom": missing_custom,
    "missing_ffill": _filled("forward_fill", order_by=["event_id"]),
    "missing_bfill": _filled("backward_fill", order_by=["event_id"]),
    "missing_interpolate": missing_interpolate,
    "missing_knn": missing_knn,
    "drop_empty_rows": drop_empty_rows,
    "outliers_iqr": outliers_iqr,
    "outliers_zscore": outliers_zscore,
    "outlier_share": outlier_share,
    "rename_reorder": rename_reorder,
    "drop_sparse": drop_sparse,
    "column_ops": column_ops,
    "preview": preview,
}

_CASED = r"\p{Lu}\p{Ll}\p{Lt}"
_CHAIN = _collapse("txt")
_CHAIN = f"regexp_replace(regexp_replace(lower({_CHAIN}), '<[^>]+>', '', 'g'), '\\p{{Nd}}+', '', 'g')"
_CHAIN = _collapse(f"regexp_replace({_CHAIN}, '[^\\p{{L}}\\p{{N}}_{SPACE}]', '', 'g')")
_IS_BOOL = """CASE lower({0}) WHEN 'true' THEN true WHEN 'yes' THEN true WHEN '1' THEN true WHEN 'y' THEN true
  WHEN 'false' THEN false WHEN 'no' THEN false WHEN '0' THEN false WHEN 'n' THEN false END"""
_DATE = """coalesce(try_strptime({0}, '%Y-%m-%d'), try_strptime({0}, '%Y/%m/%d'), try_strptime({0}, '%d.%m.%Y'))"""
_AMOUNT = "TRY_CAST(CASE WHEN amount <> 'n/a' THEN regexp_replace(amount, '[$,€£¥]', '', 'g') END AS DOUBLE)"
_GAPS = "SELECT event_id, event_type, value FROM events_gaps"


def _mixed_sql(select: str) -> str:
    return with_view("mixed_txt", f"SELECT event_id, {select} FROM mixed_txt")


def _contact_sql(select: str) -> str:
    return with_view("contacts", f"SELECT id, {select} FROM contacts")


def _gap_sql(query: str) -> str:
    return with_view("events_gaps", query)


ORACLES = {
    "text_remove_special_chars": _text_sql(_collapse(_NO_SPECIAL)),
    "text_remove_extra_spaces": _text_sql(_collapse("txt")),
    "text_lowercase": _text_sql("lower(txt)"),
    "text_uppercase": _text_sql("replace(upper(txt), 'ẞ', 'SS')"),
    "text_title_case": _text_sql(
        f"array_to_string(list_transform(regexp_extract_all(txt, '[{_CASED}]+|[^{_CASED}]+'),"
        " lambda w: CASE w[1] WHEN 'ß' THEN 'Ss' ELSE upper(w[1]) END || lower(w[2:])), '')"
    ),
    "text_remove_numbers": _text_sql(_collapse("regexp_replace(txt, '\\p{Nd}+', '', 'g')")),
    "text_remove_html_tags": _text_sql(_collapse("regexp_replace(txt, '<[^>]+>', '', 'g')")),
    "text_normalize_whitespace": _text_sql(_collapse("txt")),
    "text_chain": _text_sql(_CHAIN),
    "text_non_text_column": "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders",
    "fix_encoding": _text_sql(f"regexp_replace({_REPAIRED}, '[^\\x20-\\x7E]', '', 'g')"),
    "fix_encoding_unicode": _text_sql(f"regexp_replace({_REPAIRED}, '\\p{{Cc}}', '', 'g')"),
    "cast_numeric": _mixed_sql(
        f"{_number('tricky_txt')} AS tricky_txt, {_number('float_txt')} AS float_txt, {_number('free_txt')} AS free_txt"
    ),
    "cast_integer": _mixed_sql(
        f"TRY_CAST(int_txt AS BIGINT) AS int_txt, {_number('float_txt')} AS float_txt"
    ),
    "cast_string": _mixed_sql("int_txt"),
    "cast_datetime": _mixed_sql(
        "CAST(date_txt AS TIMESTAMP) AS date_txt, CAST(NULL AS TIMESTAMP) AS free_txt"
    ),
    "cast_datetime_first_layout": with_view(
        "contacts",
        """SELECT id, CASE (SELECT CASE WHEN contains(day, '/') THEN '/' WHEN contains(day, '.') THEN '.' ELSE '-' END
    FROM contacts ORDER BY id LIMIT 1)
  WHEN '/' THEN try_strptime(day, '%Y/%m/%d') WHEN '.' THEN try_strptime(day, '%d.%m.%Y')
  ELSE try_strptime(day, '%Y-%m-%d') END AS day FROM contacts""",
    ),
    "cast_category": _mixed_sql(
        "free_txt, dense_rank() OVER (ORDER BY free_txt) - 1 AS code,"
        " CASE bool_txt WHEN 'Yes' THEN 0 WHEN 'no' THEN 1 ELSE -1 END::BIGINT AS bool_code"
    ),
    "cast_boolean": _mixed_sql(
        f"{_IS_BOOL.format('bool_txt')} AS bool_txt, {_IS_BOOL.format('int_txt')} AS int_txt"
    ),
    "format_phone": _contact_sql(
        r"regexp_replace(regexp_replace(phone, '\D', '', 'g'), '(\d{3})(\d{3})(\d{4})', '(\1) \2-\3', 'g') AS phone"
    ),
    "format_date": _contact_sql(f"strftime({_DATE.format('day')}, '%d %b %Y') AS day"),
    "format_currency": _contact_sql(f"{_AMOUNT} AS amount"),
    "format_currency_text": _contact_sql(f"'€' || format('{{:,.2f}}', {_AMOUNT}) AS amount"),
    "format_email": _contact_sql("trim(lower(email)) AS email"),
    "format_regex": _contact_sql(r"regexp_replace(phone, '(\d)\D+(\d)', '\2$\1', 'g') AS phone"),
    "email_validity": with_view(
        "contacts",
        r"""SELECT count(*) FILTER (WHERE ok) AS valid, count(*) FILTER (WHERE NOT ok) AS invalid FROM (
SELECT regexp_matches(trim(lower(email)), '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$') AS ok FROM contacts)""",
    ),
    "dedup_first": "SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1",
    "dedup_last": "SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) = 1",
    "dedup_none": """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate FROM lineitem
QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1""",
    "dedup_rows": "SELECT DISTINCT l_suppkey, l_quantity, l_returnflag FROM lineitem",
    "dedup_hot_key": """SELECT event_id, event_type, user_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) = 1""",
    "dup_flag": """SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS is_duplicate
FROM documents""",
    "dup_count": """SELECT count(*) AS row_count, count(*) - count(DISTINCT text) AS duplicate_count,
  round((count(*) - count(DISTINCT text)) * 100.0 / count(*), 2) AS duplicate_percent FROM documents""",
    "missing_drop": _gap_sql(f"{_GAPS} WHERE event_type IS NOT NULL AND value IS NOT NULL"),
    "missing_mean": _gap_sql(
        "SELECT event_id, event_type, coalesce(value, (SELECT avg(value) FROM events_gaps)) AS value FROM events_gaps"
    ),
    "missing_median": _gap_sql(
        "SELECT event_id, event_type, coalesce(value, (SELECT median(value) FROM events_gaps)) AS value FROM events_gaps"
    ),
    "missing_mode": _gap_sql(
        """SELECT event_id, coalesce(event_type, (SELECT event_type FROM events_gaps WHERE event_type IS NOT NULL
    GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS event_type,
  coalesce(value, (SELECT value FROM events_gaps WHERE value IS NOT NULL
    GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS value FROM events_gaps"""
    ),
    "missing_custom": _gap_sql(
        "SELECT event_id, coalesce(event_type, 'unknown') AS event_type, coalesce(value, -1) AS value FROM events_gaps"
    ),
    "missing_ffill": _gap_sql(
        """SELECT event_id, last_value(event_type IGNORE NULLS) OVER w AS event_type,
  last_value(value IGNORE NULLS) OVER w AS value FROM events_gaps
WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
    ),
    "missing_bfill": _gap_sql(
        """SELECT event_id, first_value(event_type IGNORE NULLS) OVER w AS event_type,
  first_value(value IGNORE NULLS) OVER w AS value FROM events_gaps
WINDOW w AS (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""
    ),
    "missing_interpolate": _gap_sql(
        """SELECT event_id, round(CASE WHEN value IS NOT NULL THEN value WHEN nv IS NULL OR pv IS NULL THEN pv
  ELSE pv + (nv - pv) / (np - pp) * (p - pp) END, 6) AS value FROM (
  SELECT event_id, value, p, last_value(value IGNORE NULLS) OVER b AS pv, last_value(k IGNORE NULLS) OVER b AS pp,
    first_value(value IGNORE NULLS) OVER a AS nv, first_value(k IGNORE NULLS) OVER a AS np
  FROM (SELECT *, CASE WHEN value IS NOT NULL THEN p END AS k
    FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS p FROM events_gaps))
  WINDOW b AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    a AS (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
    ),
    "missing_knn": with_view(
        "supplier_gaps",
        """, pairs AS (
  SELECT r.s_suppkey, d.s_suppkey AS donor, d.y AS dy, d.z AS dz, r.y IS NULL AS need_y, r.z IS NULL AS need_z,
    3.0 * (pow(r.x - d.x, 2) + coalesce(pow(r.y - d.y, 2), 0) + coalesce(pow(r.z - d.z, 2), 0))
      / (1 + (r.y IS NOT NULL AND d.y IS NOT NULL)::INT + (r.z IS NOT NULL AND d.z IS NOT NULL)::INT) AS dist
  FROM supplier_gaps r, supplier_gaps d WHERE r.y IS NULL OR r.z IS NULL
), ky AS (SELECT s_suppkey, avg(dy) AS y FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY dist, donor) AS rn
    FROM pairs WHERE need_y AND dy IS NOT NULL) WHERE rn <= 5 GROUP BY 1),
kz AS (SELECT s_suppkey, avg(dz) AS z FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY dist, donor) AS rn
    FROM pairs WHERE need_z AND dz IS NOT NULL) WHERE rn <= 5 GROUP BY 1)
SELECT s.s_suppkey, round(s.x, 6) AS x, round(coalesce(s.y, ky.y), 6) AS y, round(coalesce(s.z, kz.z), 6) AS z
FROM supplier_gaps s LEFT JOIN ky USING (s_suppkey) LEFT JOIN kz USING (s_suppkey)""",
    ),
    "drop_empty_rows": with_view(
        "events_messy",
        """SELECT event_type, value, half_col FROM events_messy
WHERE event_type IS NOT NULL OR value IS NOT NULL OR half_col IS NOT NULL""",
    ),
    "outliers_iqr": _gap_sql(
        """SELECT event_id, value FROM events_gaps,
  (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events_gaps)
WHERE value IS NULL OR value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"""
    ),
    "outliers_zscore": """SELECT event_id, value FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)
WHERE NOT abs((value - m) / s) > 3""",
    "outlier_share": _gap_sql(
        """SELECT "column", CAST(sum((v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1))::INT) AS BIGINT) AS outliers,
  n AS rows, round(sum((v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1))::INT) / n, 6) AS outlier_share FROM (
  SELECT "column", v, count(*) OVER (PARTITION BY "column") AS n,
    quantile_cont(v, 0.25) OVER (PARTITION BY "column") AS q1, quantile_cont(v, 0.75) OVER (PARTITION BY "column") AS q3 FROM (
    SELECT 'event_id' AS "column", CAST(event_id AS DOUBLE) AS v FROM events_gaps
    UNION ALL SELECT 'value', value FROM events_gaps)) GROUP BY "column", n"""
    ),
    "rename_reorder": """SELECT o_totalprice AS total, o_orderkey AS order_key, o_custkey, o_orderstatus,
  o_orderdate, o_orderpriority FROM orders""",
    "drop_sparse": with_view(
        "events_messy", "SELECT event_id, user_id, event_type, value, half_col, num_txt FROM events_messy"
    ),
    "column_ops": """SELECT o_orderkey, o_custkey, o_totalprice, strftime(o_orderdate, '%Y-%m') AS month
FROM orders WHERE o_orderstatus = 'F'""",
    "preview": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 10",
}
