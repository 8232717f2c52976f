"""Text cleaning, encoding repair, format rules and type conversion on tables."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import casts, formats, text
from tablewright.operators.columns import (
    quoted,
    replace_columns,
    require_batch,
    require_columns,
    text_columns,
)

CONVERSIONS = {
    "numeric": casts.to_number,
    "float": casts.to_number,
    "integer": casts.to_integer,
    "string": lambda c: c.cast("string"),
    "datetime": casts.to_datetime,
    "category": lambda c: c.cast("string"),
    "boolean": casts.to_boolean,
}


def clean_text(df: DataFrame, columns: Sequence[str], operations: Sequence[str]) -> DataFrame:
    """Apply the operations in order to each column; other types become text first."""
    require_columns(df, columns)
    new = {c: text.apply_operations(quoted(c).cast("string"), operations) for c in columns}
    return replace_columns(df, new)


def fix_encoding(
    df: DataFrame, columns: Sequence[str] | None = None, ascii_only: bool = True
) -> DataFrame:
    """Repair damaged text; unknown columns are skipped."""
    columns = text_columns(df) if columns is None else [c for c in columns if c in df.columns]
    return replace_columns(
        df, {c: text.fix_encoding(quoted(c).cast("string"), ascii_only) for c in columns}
    )


def standardize_formats(df: DataFrame, rules: dict[str, dict[str, Any]]) -> DataFrame:
    """Apply one format rule per column; unknown columns are skipped."""
    known = {c: rule for c, rule in rules.items() if c in df.columns}
    return replace_columns(df, {c: formats.apply_rule(quoted(c), r) for c, r in known.items()})


def fractional_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns that hold a number which is not whole, from one aggregate."""
    if not columns:
        return []
    require_batch(df, "conversion to integer")
    numbers = df.select(*[casts.to_number(quoted(c)).alias(f"n{i}") for i, c in enumerate(columns)])
    broken = [F.bool_or(~casts.is_whole(F.col(n))).alias(n) for n in numbers.columns]
    row = numbers.agg(*broken).first()
    return [c for c, bad in zip(columns, row) if bad]


def datetime_format(
    df: DataFrame, column: str, order_by: Sequence[str], formats: Sequence[str] = casts.DATETIME_FORMATS
) -> str | None:
    """Layout of the first value in the given order, None if it fits no layout."""
    require_batch(df, "datetime_format")
    value = quoted(column).cast("string")
    position = F.when(value.isNotNull(), F.struct(*[quoted(c) for c in order_by]))
    first = df.agg(F.min_by(value, position).alias("v"))
    fits = [F.try_to_timestamp("v", F.lit(fmt)).isNotNull().alias(f"_{i}") for i, fmt in enumerate(formats)]
    row = first.select(*fits).first()
    return next((fmt for fmt, fit in zip(formats, row) if fit), None)


def convert_datetime(df: DataFrame, column: str, order_by: Sequence[str]) -> DataFrame:
    """Datetimes in the layout of the first value; other layouts become NULL."""
    fmt = datetime_format(df, column, order_by)
    formats = [fmt] if fmt else casts.DATETIME_FORMATS
    return replace_columns(df, {column: casts.to_datetime(quoted(column), formats)})


def convert_types(df: DataFrame, mapping: dict[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """Convert columns; returns the table and the conversions that did not hold.

    ``integer`` is all or nothing: a column with a fractional value stays
    double and is reported.  Unknown columns and types are skipped and
    reported as well.
    """
    problems = {c: "column not found" for c in mapping if c not in df.columns}
    known = {c: t for c, t in mapping.items() if c not in problems}
    problems |= {c: f"unknown type {t}" for c, t in known.items() if t not in CONVERSIONS}
    known = {c: t for c, t in known.items() if c not in problems}
    integers = [c for c, t in known.items() if t == "integer"]
    for c in fractional_columns(df, integers):
        problems[c] = "fractional values, kept as float"
        known[c] = "float"
    return replace_columns(df, {c: CONVERSIONS[t](quoted(c)) for c, t in known.items()}), problems


def cast_values(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Convert columns value by value: what does not fit becomes NULL, whatever the others are.

    The row-local form of ``convert_types``, for streams as well.
    """
    require_columns(df, mapping)
    unknown = {t for t in mapping.values() if t not in CONVERSIONS}
    if unknown:
        raise ValueError(f"unknown types: {sorted(unknown)}; known: {sorted(CONVERSIONS)}")

    def one(name: str, kind: str) -> Column:
        value = CONVERSIONS[kind](quoted(name))
        return F.when(casts.is_whole(casts.to_number(quoted(name))), value) if kind == "integer" else value

    return replace_columns(df, {c: one(c, t) for c, t in mapping.items()})


def add_category_codes(df: DataFrame, column: str, code_column: str) -> DataFrame:
    """Zero-based code of each value in sorted order; NULL gets -1.

    The codes are numbered on the distinct values, spread over range
    partitions, and joined back.  The code side has one row per value, so a
    hot value makes one large partition of the table at worst, and the
    adaptive skew join splits that.
    """
    require_columns(df, [column])
    require_batch(df, "add_category_codes")
    from tablewright.operators.ordered import global_row_number

    values = df.select(quoted(column).alias("_value")).na.drop().distinct()
    codes = global_row_number(values, ["_value"], "_code", start=0)
    joined = df.join(codes, quoted(column) == F.col("_value"), "left")
    return joined.select(
        *[df[f"`{c}`"] for c in df.columns],
        F.coalesce(F.col("_code"), F.lit(-1).cast("bigint")).alias(code_column),
    )
