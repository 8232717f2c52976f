"""Summaries, quality score, type inference and export estimates.

Statistics of all columns come from one aggregate per phase, tidied into one
row per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import casts
from tablewright.functions.text import SPACE_CLASS, WORD_CLASS
from tablewright.operators.columns import (
    numeric_columns,
    quoted,
    require_batch,
    require_columns,
    text_columns,
    value_of,
)
from tablewright.operators.dedup import duplicate_count
from tablewright.operators.outliers import iqr_flags
from tablewright.operators.stats import exact_percentiles
from tablewright.operators.texts import top_texts
from tablewright.sources.writers import ExportOptions

# Size factors per export format, widest display column,
# limits and penalties of the quality score.
SIZE_FACTORS = {"xlsx": 0.8, "csv": 1.2, "json": 1.5}
MAX_DISPLAY_WIDTH = 50
MISSING_LIMIT, DUPLICATE_LIMIT = 20, 5
MISSING_CAP, DUPLICATE_CAP = 30, 20
CASTABLE_SHARE, OUTLIER_SHARE, SPECIAL_SHARE = 0.8, 0.05, 0.3
TYPE_PENALTY, OUTLIER_PENALTY, TEXT_PENALTY = 5, 3, 2
BANDS = ((60, "poor"), (80, "moderate"))

# What helps against each fault.
RECOMMENDATIONS = {
    "dataset is empty": "load data first",
    "high missing data": "fill gaps or drop columns that are mostly empty",
    "high duplicate records": "remove duplicate records",
    "numbers stored as text": "convert the column to a number",
    "high outlier count": "review outliers and remove those that are wrong",
    "excessive whitespace": "collapse repeated white space",
    "many special characters": "remove special characters",
}


def _tidy(df: DataFrame, per_column: dict[str, dict[str, Column]], shared: dict[str, Column]):
    """Evaluate all aggregates in one pass and return one row per column."""
    aggs = [expr.alias(name) for name, expr in shared.items()]
    for i, stats in enumerate(per_column.values()):
        aggs += [expr.alias(f"_{i}_{name}") for name, expr in stats.items()]
    wide = df.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"), *[F.col(f"_{i}_{name}").alias(name) for name in stats]
            )
            for i, (c, stats) in enumerate(per_column.items())
        ]
    )
    return wide.select(F.explode(rows).alias("r"), *shared).select("r.*", *shared)


def _percent(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part, whole) * 100, 2)


def missing_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, missing, rows, missing_percent, total_missing)."""
    require_batch(df, "missing_summary")
    columns = require_columns(df, df.columns if columns is None else columns)
    total = sum((value_of(df, c).isNull().cast("bigint") for c in columns), F.lit(0).cast("bigint"))
    tidy = _tidy(
        df,
        {c: {"missing": F.count_if(value_of(df, c).isNull())} for c in columns},
        {"rows": F.count(F.lit(1)), "total_missing": F.coalesce(F.sum(total), F.lit(0))},
    )
    return tidy.select(
        "column",
        "missing",
        "rows",
        _percent(F.col("missing"), F.col("rows")).alias("missing_percent"),
        "total_missing",
    )


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, count, mean, std, min, p25, p50, p75, max) of the numeric columns."""
    require_batch(df, "numeric_summary")
    columns = numeric_columns(df) if columns is None else require_columns(df, columns)
    quartiles = exact_percentiles(df, columns, [0.25, 0.5, 0.75])
    tidy = _tidy(
        df,
        {
            c: {
                "count": F.count(value_of(df, c)),
                "mean": F.avg(value_of(df, c)),
                "std": F.stddev_samp(value_of(df, c)),
                "min": F.min(value_of(df, c)).cast("double"),
                **{
                    name: F.max(F.lit(q).cast("double"))
                    for name, q in zip(("p25", "p50", "p75"), quartiles[c])
                },
                "max": F.max(value_of(df, c)).cast("double"),
            }
            for c in columns
        },
        {},
    )
    return tidy


def text_summary(df: DataFrame, columns: Sequence[str] | None = None, top: int = 3) -> DataFrame:
    """(column, unique_values, rank, value, count): distinct count and top values.

    Exact, with texts told apart by digests: no text is moved but the top ones.
    """
    columns = text_columns(df) if columns is None else list(columns)
    schema = "column string, unique_values bigint"
    if not columns:
        empty = df.sparkSession.createDataFrame([], schema)
        return empty.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("rank", "int"), ("value", "string"), ("count", "bigint"))])
    unique, best = top_texts(df, columns, top)
    names = df.sparkSession.createDataFrame(list(unique.items()), schema)
    # both have a handful of rows per column of the table
    return names.join(best, "column", "left").select("column", "unique_values", "rank", "value", "count")


def byte_size(df: DataFrame) -> Column:
    """Aggregate: bytes of all cells printed as text."""
    cells = [F.coalesce(F.octet_length(quoted(c).cast("string")), F.lit(0)) for c in df.columns]
    return F.coalesce(F.sum(sum((c.cast("bigint") for c in cells), F.lit(0).cast("bigint"))), F.lit(0))


def shape_summary(df: DataFrame) -> DataFrame:
    """One row: rows, columns, bytes and the number of columns per type."""
    require_batch(df, "shape_summary")
    kinds: dict[str, int] = {}
    for field in df.schema:
        kinds[field.dataType.simpleString()] = kinds.get(field.dataType.simpleString(), 0) + 1
    histogram = ",".join(f"{kind}={n}" for kind, n in sorted(kinds.items()))
    return df.agg(F.count(F.lit(1)).alias("rows"), byte_size(df).alias("bytes")).select(
        "rows",
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        "bytes",
        F.lit(histogram).alias("column_types"),
    )


def export_size_estimate(df: DataFrame) -> DataFrame:
    """(format, estimated_bytes) from the printed size of the table."""
    require_batch(df, "export_size_estimate")
    factors = F.array(
        *[
            F.struct(F.lit(name).alias("format"), F.lit(factor).alias("factor"))
            for name, factor in SIZE_FACTORS.items()
        ]
    )
    return (
        df.agg(byte_size(df).alias("bytes"))
        .select(F.explode(factors).alias("f"), "bytes")
        .select("f.format", F.round(F.col("bytes") * F.col("f.factor"), 1).alias("estimated_bytes"))
    )


def export_profile(df: DataFrame) -> DataFrame:
    """(column, dtype, rows, mean, std, display_width) for an export's metadata."""
    require_batch(df, "export_profile")
    numeric = set(numeric_columns(df))
    none = F.max(F.lit(None).cast("double"))
    per_column = {}
    for field in df.schema:
        c = quoted(field.name)
        longest = F.coalesce(F.max(F.length(c.cast("string"))), F.lit(0))
        width = F.greatest(F.lit(len(field.name)), longest) + 2
        per_column[field.name] = {
            "mean": F.avg(value_of(df, field.name)) if field.name in numeric else none,
            "std": F.stddev_samp(value_of(df, field.name)) if field.name in numeric else none,
            "display_width": F.least(width, F.lit(MAX_DISPLAY_WIDTH)),
        }
    tidy = _tidy(df, per_column, {"rows": F.count(F.lit(1))})
    kinds = F.create_map(
        *[x for f in df.schema for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))]
    )
    return tidy.select(
        "column", kinds[F.col("column")].alias("dtype"), "rows", "mean", "std", "display_width"
    )


def export_metadata(df: DataFrame, options: ExportOptions | None = None) -> DataFrame:
    """(section, item, value): what an export says about itself.

    Date, records, columns, format, encoding and index; each column's type; mean and deviation of numeric columns.
    """
    options = options or ExportOptions()
    described = export_profile(df)
    facts = {
        "export_date": F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"),
        "total_records": F.coalesce(F.max("rows"), F.lit(0)).cast("string"),
        "total_columns": F.lit(str(len(df.columns))),
        "file_format": F.lit(options.format or "parquet"),
        "encoding": F.lit(options.encoding),
        "include_index": F.lit(str(options.index_column is not None).lower()),
    }
    about = F.array(*[F.struct(F.lit(name).alias("item"), value.alias("value")) for name, value in facts.items()])
    general = described.agg(about.alias("facts")).select(F.explode("facts").alias("f")).select(F.lit("export").alias("section"), "f.item", "f.value")
    kinds = described.select(F.lit("column").alias("section"), F.col("column").alias("item"), F.col("dtype").alias("value"))
    shown = F.format_string("mean %.2f, std %.2f", "mean", F.coalesce("std", F.lit(0.0)))
    numbers = described.filter(F.col("mean").isNotNull()).select(F.lit("summary").alias("section"), F.col("column").alias("item"), shown.alias("value"))
    return general.unionByName(kinds).unionByName(numbers)


def _castable(c: str) -> Column:
    return F.count_if(casts.to_number(quoted(c)).isNotNull())


def _quality_counts(df: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """One row with all counts of a quality report, and the numeric and text columns that they are numbered by.

    Three jobs whatever the number of columns: quartiles, the duplicate
    count, and one aggregate for everything else.
    """
    numeric, text = numeric_columns(df), text_columns(df)
    flags = iqr_flags(df, numeric)
    total_missing = sum((value_of(df, c).isNull().cast("bigint") for c in df.columns), F.lit(0).cast("bigint"))
    aggs = [F.count(F.lit(1)).alias("rows"), F.sum(total_missing).alias("missing")]
    aggs += [F.count_if(flag).alias(f"outliers_{i}") for i, flag in enumerate(flags.values())]
    for i, c in enumerate(text):
        value = quoted(c)
        aggs += [
            _castable(c).alias(f"castable_{i}"),
            F.count_if(value.rlike(f"[{SPACE_CLASS}]{{2,}}")).alias(f"gaps_{i}"),
            F.count_if(value.rlike(f"[^{WORD_CLASS}{SPACE_CLASS}]")).alias(f"special_{i}"),
        ]
    # both sides are a single aggregate row
    duplicates = duplicate_count(df).select("duplicate_count")
    counted = df.agg(*aggs).join(F.broadcast(duplicates), F.lit(True))
    return counted, list(flags), text


def quality_issues(df: DataFrame) -> DataFrame:
    """(column, issue, cells, recommendation): every fault that the quality score counts, by name.

    ``column`` is NULL for faults of the whole table; ``cells`` says how many
    cells, or rows for duplicates, are concerned.  A sound table has no rows.
    """
    require_batch(df, "quality_issues")
    counted, numeric, text = _quality_counts(df)
    rows = F.col("rows")

    def issue(column: str | None, name: str, cells: Column, holds: Column) -> Column:
        found = F.struct(
            F.lit(column).cast("string").alias("column"),
            F.lit(name).alias("issue"),
            cells.cast("bigint").alias("cells"),
            F.lit(RECOMMENDATIONS[name]).alias("recommendation"),
        )
        return F.when(holds, found)

    every = [
        issue(None, "dataset is empty", rows, rows == 0),
        issue(None, "high missing data", F.col("missing"), F.col("missing") * 100 > MISSING_LIMIT * rows * len(df.columns)),
        issue(None, "high duplicate records", F.col("duplicate_count"), F.col("duplicate_count") * 100 > DUPLICATE_LIMIT * rows),
    ]
    for i, c in enumerate(text):
        castable, gaps, special = (F.col(f"{n}_{i}") for n in ("castable", "gaps", "special"))
        every += [
            issue(c, "numbers stored as text", castable, castable > rows * CASTABLE_SHARE),
            issue(c, "excessive whitespace", gaps, gaps > 0),
            issue(c, "many special characters", special, special > rows * SPECIAL_SHARE),
        ]
    for i, c in enumerate(numeric):
        every.append(issue(c, "high outlier count", F.col(f"outliers_{i}"), F.col(f"outliers_{i}") > rows * OUTLIER_SHARE))
    found = F.filter(F.array(*every), lambda x: x.isNotNull())
    return counted.select(F.explode(found).alias("i")).select("i.*")


def quality_score(df: DataFrame) -> DataFrame:
    """One row: the parts of the quality score, the score and its band; ``quality_issues`` names the faults."""
    require_batch(df, "quality_score")
    counted, flags, text = _quality_counts(df)
    rows = F.col("rows")

    def how_many(conditions: list[Column]) -> Column:
        return sum((c.cast("bigint") for c in conditions), F.lit(0).cast("bigint"))

    parts = counted.select(
        rows,
        (F.try_divide(F.col("missing"), rows * len(df.columns)) * 100).alias("missing_percent"),
        (F.try_divide(F.col("duplicate_count"), rows) * 100).alias("duplicate_percent"),
        how_many([F.col(f"castable_{i}") > rows * CASTABLE_SHARE for i in range(len(text))]).alias(
            "inconsistent_columns"
        ),
        how_many([F.col(f"outliers_{i}") > rows * OUTLIER_SHARE for i in range(len(flags))]).alias(
            "outlier_columns"
        ),
        how_many(
            [F.col(f"gaps_{i}") > 0 for i in range(len(text))]
            + [F.col(f"special_{i}") > rows * SPECIAL_SHARE for i in range(len(text))]
        ).alias("text_issues"),
    )
    score = F.greatest(
        F.lit(0.0),
        F.lit(100.0)
        - F.least("missing_percent", F.lit(float(MISSING_CAP)))
        - F.least("duplicate_percent", F.lit(float(DUPLICATE_CAP)))
        - F.col("inconsistent_columns") * TYPE_PENALTY
        - F.col("outlier_columns") * OUTLIER_PENALTY
        - F.col("text_issues") * TEXT_PENALTY,
    )
    scored = parts.withColumn("overall_score", F.when(rows == 0, F.lit(0.0)).otherwise(score))
    (poor, poor_name), (moderate, moderate_name) = BANDS
    issues = F.filter(
        F.array(
            F.when(rows == 0, "dataset is empty"),
            F.when(F.col("missing_percent") > MISSING_LIMIT, "high missing data"),
            F.when(F.col("duplicate_percent") > DUPLICATE_LIMIT, "high duplicate records"),
            F.when(F.col("inconsistent_columns") > 0, "numbers stored as text"),
            F.when(F.col("outlier_columns") > 0, "high outlier count"),
            F.when(F.col("text_issues") > 0, "text needs cleaning"),
        ),
        lambda issue: issue.isNotNull(),
    )
    return scored.select(
        "rows",
        F.round("missing_percent", 6).alias("missing_percent"),
        F.round("duplicate_percent", 6).alias("duplicate_percent"),
        "inconsistent_columns",
        "outlier_columns",
        "text_issues",
        F.round("overall_score", 6).alias("overall_score"),
        F.when(F.col("overall_score") < poor, poor_name)
        .when(F.col("overall_score") < moderate, moderate_name)
        .otherwise("good")
        .alias("band"),
        F.array_join(issues, "; ").alias("issues"),
    )


def infer_types(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    formats: Sequence[str] = casts.DATETIME_FORMATS,
) -> DataFrame:
    """(column, castable, rows, inferred_type) for the text columns.

    Numeric wins over datetime, datetime over boolean; a column that fits
    none, or has no value, stays ``string``.  All values that are not NULL
    decide, in one aggregate.
    """
    require_batch(df, "infer_types")
    columns = text_columns(df) if columns is None else require_columns(df, columns)
    per_column, facts = {}, []
    for i, c in enumerate(columns):
        facts += [
            casts.to_number(quoted(c)).alias(f"n{i}"),
            F.lower(quoted(c)).isin(*casts.BOOLEAN_WORDS).alias(f"w{i}"),
            F.when(quoted(c).isNotNull(), casts.to_datetime(quoted(c), formats).isNotNull()).alias(f"d{i}"),
        ]
        per_column[c] = {
            "castable": F.count(f"n{i}"),
            "whole": F.coalesce(F.bool_and(casts.is_whole(F.col(f"n{i}"))), F.lit(True)),
            "words": F.coalesce(F.bool_and(f"w{i}"), F.lit(False)),
            "dated": F.coalesce(F.bool_and(f"d{i}"), F.lit(False)),
        }
    stats = _tidy(df.select(*facts), per_column, {"rows": F.count(F.lit(1))})
    return stats.select(
        "column",
        "castable",
        "rows",
        F.when(
            F.col("castable") > F.col("rows") * CASTABLE_SHARE,
            F.when(F.col("whole"), "integer").otherwise("float"),
        )
        .when(F.col("dated"), "datetime")
        .when(F.col("words"), "boolean")
        .otherwise("string")
        .alias("inferred_type"),
    )


def apply_inferred_types(df: DataFrame) -> DataFrame:
    """Convert every text column to its inferred type."""
    from tablewright.operators.text import convert_types

    found = {r["column"]: r["inferred_type"] for r in infer_types(df).collect()}
    return convert_types(df, {c: t for c, t in found.items() if t != "string"})[0]
