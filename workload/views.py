"""Derived inputs with gaps and mess, as SQL that both engines read.

The test tables have no NULLs and little mess.  ``{table}`` stands for a base
table; ``spark_view`` binds it to a DataFrame, ``sql`` to the table's name.
All rows and whole texts are used.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


VIEWS = {
    "events_gaps": """
SELECT event_id, ts, user_id,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS event_type,
  CASE WHEN event_id % 7 IN (0, 1) THEN NULL ELSE value END AS value
FROM {events}""",
    "supplier_gaps": """
SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS x,
  CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE s_acctbal END AS y,
  CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE CAST(s_suppkey * 37 % 101 AS DOUBLE) END AS z
FROM {supplier}""",
    "docs_messy": """
SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE concat('  ', text, chr(9),
  '<b>', upper(lang), '</b>', chr(10), '  it', chr(39), 's x', CAST(doc_id % 10 AS STRING),
  'y  â€œqâ€ cafÃ© ', source) END AS txt
FROM {documents}""",
    "contacts": """
SELECT id, CASE WHEN id % 11 = 0 THEN NULL
    WHEN id % 4 = 0 THEN concat(substr(d,1,3),'-',substr(d,4,3),'-',substr(d,7,4))
    WHEN id % 4 = 1 THEN concat('(',substr(d,1,3),') ',substr(d,4,3),'-',substr(d,7,4))
    WHEN id % 4 = 2 THEN d ELSE concat('1.',substr(d,1,3),'.',substr(d,4,3),'.',substr(d,7,4))
    END AS phone,
  concat(CASE WHEN id % 2 = 0 THEN 'USER' ELSE ' user' END, CAST(id AS STRING),
    CASE WHEN id % 13 = 0 THEN '@invalid' ELSE '@Example.com ' END) AS email,
  CASE WHEN id % 9 = 2 THEN 'n/a' WHEN id % 3 = 0 THEN concat('$', CAST(amt AS STRING))
    WHEN id % 3 = 1 THEN CAST(amt AS STRING) ELSE concat('€', CAST(amt AS STRING), '.50') END AS amount,
  CASE WHEN id % 3 = 0 THEN concat(y,'-',m,'-',dd) WHEN id % 3 = 1 THEN concat(y,'/',m,'/',dd)
    ELSE concat(dd,'.',m,'.',y) END AS day
FROM (SELECT o_orderkey AS id, CAST(2000000000 + o_orderkey * 7919 % 7999999999 AS STRING) AS d,
  CAST(floor(o_totalprice) AS BIGINT) AS amt, CAST(year(o_orderdate) AS STRING) AS y,
  lpad(CAST(month(o_orderdate) AS STRING), 2, '0') AS m,
  lpad(CAST(day(o_orderdate) AS STRING), 2, '0') AS dd FROM {orders}) q""",
    "mixed_txt": """
SELECT event_id,
  CASE WHEN event_id % 20 = 0 THEN 'n/a' ELSE CAST(user_id AS STRING) END AS int_txt,
  CASE WHEN event_id % 10 = 0 THEN '' ELSE concat(CAST(user_id AS STRING), '.25') END AS float_txt,
  CASE WHEN event_id % 3 = 0 THEN 'Yes' WHEN event_id % 3 = 1 THEN 'no' ELSE NULL END AS bool_txt,
  concat('2024-01-', lpad(CAST(day(ts) AS STRING), 2, '0')) AS date_txt,
  event_type AS free_txt,
  CASE event_id % 12 WHEN 0 THEN '1e5' WHEN 1 THEN ' 12 ' WHEN 2 THEN '$7' WHEN 3 THEN '1,000'
    WHEN 4 THEN '0x1A' WHEN 5 THEN '.5' WHEN 6 THEN '5.' WHEN 7 THEN '1_000' WHEN 8 THEN ''
    WHEN 9 THEN '1d' WHEN 10 THEN NULL ELSE '-3.0' END AS tricky_txt
FROM {events}""",
    "events_messy": """
SELECT event_id, user_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value,
  CAST(NULL AS DOUBLE) AS empty_col, CASE WHEN event_id % 10 = 0 THEN value END AS sparse_col,
  CASE WHEN event_id % 10 < 4 THEN value END AS half_col,
  concat('  ', CAST(user_id AS STRING), '  ') AS num_txt
FROM (SELECT event_id, user_id, event_type, value FROM {events}
  UNION ALL SELECT event_id, user_id, event_type, value FROM {events} WHERE event_type = 'purchase') e
UNION ALL SELECT CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS STRING), CAST(NULL AS DOUBLE),
  CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS STRING) FROM {region}""",
    "runs": """
SELECT event_id AS run_id, ts, event_type AS format, event_id % 5 <> 0 AS success,
  user_id AS records_exported, value / 10 AS file_size_mb, value AS execution_time
FROM {events}""",
    "failures": """
SELECT event_id, ts,
  CASE event_id % 6 WHEN 0 THEN 'network' WHEN 1 THEN 'parsing' WHEN 2 THEN 'data' WHEN 3 THEN 'file'
    WHEN 4 THEN 'validation' ELSE 'other' END AS area,
  CASE event_id % 6
    WHEN 0 THEN CASE user_id % 5 WHEN 0 THEN 'ConnectionError' WHEN 1 THEN 'Timeout' WHEN 2 THEN 'HTTPError'
      WHEN 3 THEN 'HTTPError' ELSE 'InvalidURL' END
    WHEN 2 THEN CASE user_id % 3 WHEN 0 THEN 'MemoryError' WHEN 1 THEN 'KeyError' ELSE 'ValueError' END
    WHEN 3 THEN CASE user_id % 3 WHEN 0 THEN 'FileNotFoundError' WHEN 1 THEN 'PermissionError' ELSE 'OSError' END
    ELSE 'ValueError' END AS error,
  CASE user_id % 4 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 503 ELSE 418 END AS status_code,
  CASE user_id % 7 WHEN 0 THEN 'LXML failed' WHEN 1 THEN 'bad encoding' WHEN 2 THEN 'empty page'
    WHEN 3 THEN 'dtype mismatch' WHEN 4 THEN 'index out of range' WHEN 5 THEN 'duplicate labels'
    ELSE 'no space left on disk' END AS message
FROM {events}""",
    "projects": """
SELECT CAST(o_orderkey AS STRING) AS name, concat('order of customer ', CAST(o_custkey AS STRING)) AS description,
  o_orderdate AS last_modified, o_orderdate AS created_date, o_orderpriority AS tag1, o_orderstatus AS tag2,
  floor(o_totalprice) AS file_size
FROM {orders}""",
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bytes of table files for each part that rows are dealt to.
PART_BYTES = 1 << 20


def _file_bytes(df: DataFrame) -> int:
    """The size of the files that ``df`` is read from, as the scan has listed them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def dealt(df):
    """Rows over all cores before queries make wide values of them, where a table has fewer parts than cores or larger
    ones than PART_BYTES: a test table is one row group, and a larger one has more parts, not longer tasks. Rows are dealt
    in turn, whatever their values."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-_file_bytes(df) // PART_BYTES))
    return df if df.rdd.getNumPartitions() >= parts else df.repartition(parts)


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    query = VIEWS[name]
    tables = set(re.findall(r"\{(\w+)\}", query))
    return spark.sql(query, **{t: dealt(read(spark, sf_dir, t)) for t in tables})


def sql(name: str) -> str:
    """The view as a common table expression body for the SQL engine."""
    return re.sub(r"\{(\w+)\}", r"\1", VIEWS[name])


def with_view(name: str, query: str) -> str:
    return f"WITH {name} AS ({sql(name)}\n)\n{query}"
