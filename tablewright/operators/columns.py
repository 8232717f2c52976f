"""Column selection, renaming, ordering and row filters on NULLs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.names import clean_name


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def require_columns(df: DataFrame, columns: Iterable[str]) -> list[str]:
    columns = list(columns)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return columns


def require_batch(df: DataFrame, operator: str) -> None:
    if df.isStreaming:
        raise ValueError(f"{operator} needs statistics of the whole table; not for streams")


def quoted(name: str) -> Column:
    """Column by exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def value_of(df: DataFrame, name: str) -> Column:
    """Column by exact name with NaN as NULL: the one rule for what is missing."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.nanvl(quoted(name), F.lit(None).cast(kind))
    return quoted(name)


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """One projection that swaps in the given expressions and keeps the order."""
    return df.select(*[new[c].alias(c) if c in new else quoted(c) for c in df.columns])


def prepare(df: DataFrame) -> DataFrame:
    """Fold NaN into NULL once, so that every operator sees one kind of missing."""
    return replace_columns(df, {c: value_of(df, c) for c in df.columns})


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    require_columns(df, mapping)
    names = [mapping.get(c, c) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"renaming makes duplicate columns: {names}")
    return df.withColumnsRenamed(mapping)


def normalize_column_names(df: DataFrame) -> DataFrame:
    """Clean every column name; a clash gets a numeric suffix."""
    names: list[str] = []
    for raw in df.columns:
        base = name = clean_name(raw)
        n = 1
        while name in names:
            n += 1
            name = f"{base}_{n}"
        names.append(name)
    return df.toDF(*names)


def reorder_columns(df: DataFrame, order: Sequence[str]) -> DataFrame:
    require_columns(df, order)
    rest = [c for c in df.columns if c not in order]
    return df.select(*[quoted(c) for c in [*order, *rest]])


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[int, dict[str, int]]:
    """Row count and NULLs per column, from one aggregate."""
    require_batch(df, "null_counts")
    columns = list(df.columns if columns is None else columns)
    aggs = [F.count(F.lit(1))] + [F.count_if(value_of(df, c).isNull()) for c in columns]
    row = df.agg(*[a.alias(f"_{i}") for i, a in enumerate(aggs)]).first()
    return row[0], dict(zip(columns, row[1:]))


def drop_sparse_columns(df: DataFrame, threshold: float) -> DataFrame:
    """Drop columns whose share of NULLs is above ``threshold``."""
    rows, nulls = null_counts(df)
    return df.drop(*[c for c, n in nulls.items() if rows and n / rows > threshold])


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns that hold nothing but NULL."""
    rows, nulls = null_counts(df)
    return df.drop(*[c for c, n in nulls.items() if rows and n == rows])


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("all")


def drop_incomplete_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = require_columns(df, df.columns if columns is None else columns)
    return df.na.drop("any", subset=columns)


def add_columns(df: DataFrame, expressions: dict[str, str]) -> DataFrame:
    return df.withColumns({name: F.expr(sql) for name, sql in expressions.items()})


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*require_columns(df, columns))


def filter_rows(df: DataFrame, condition: str) -> DataFrame:
    return df.filter(condition)


def sort_rows(df: DataFrame, order: Sequence[str], descending: bool = False) -> DataFrame:
    keys = [quoted(c) for c in require_columns(df, order)]
    return df.orderBy(*[k.desc() if descending else k.asc() for k in keys])


def preview(df: DataFrame, rows: int = 5, order_by: Sequence[str] = ()) -> DataFrame:
    """First rows in the given order; a top-n, not a full sort."""
    ordered = sort_rows(df, order_by) if order_by else df
    return ordered.limit(rows)
