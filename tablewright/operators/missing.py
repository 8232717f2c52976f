"""Missing-value strategies."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.columns import (
    drop_incomplete_rows,
    numeric_columns,
    replace_columns,
    require_batch,
    require_columns,
    value_of,
)
from tablewright.operators.ordered import fill_ordered, interpolate_ordered
from tablewright.operators.stats import exact_percentiles, modes


def _numeric(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    wanted = require_columns(df, df.columns if columns is None else columns)
    numeric = set(numeric_columns(df))
    return [c for c in wanted if c in numeric]


def fill_values(df: DataFrame, values: dict[str, Any], widen: bool = False) -> DataFrame:
    """Replace NULL and NaN by a constant per column, cast to the column's type.

    ``widen`` turns the column into double first, for statistics that are
    fractional on whole-number columns.
    """
    new = {}
    for c, value in values.items():
        if value is None:
            continue
        kind = "double" if widen else df.schema[c].dataType
        new[c] = F.coalesce(value_of(df, c).cast(kind), F.lit(value).cast(kind))
    return replace_columns(df, new)


def fill_mean(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Column mean into the NULLs of numeric columns; other columns stay."""
    require_batch(df, "fill_mean")
    columns = _numeric(df, columns)
    if not columns:
        return df
    row = df.agg(*[F.avg(value_of(df, c)).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    return fill_values(df, dict(zip(columns, row)), widen=True)


def fill_median(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = _numeric(df, columns)
    medians = exact_percentiles(df, columns, [0.5])
    return fill_values(df, {c: m[0] for c, m in medians.items()}, widen=True)


def fill_mode(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Most frequent value, smallest on a tie; an all-NULL column stays."""
    require_batch(df, "fill_mode")
    return fill_values(df, modes(df, df.columns if columns is None else columns))


def fill_custom(df: DataFrame, value: Any, columns: Sequence[str] | None = None) -> DataFrame:
    if value is None:
        raise ValueError("fill_custom needs a value")
    columns = require_columns(df, df.columns if columns is None else columns)
    return fill_values(df, dict.fromkeys(columns, value))


def handle_missing(
    df: DataFrame,
    strategy: str,
    columns: Sequence[str] | None = None,
    fill_value: Any = None,
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """Apply a named strategy to the columns (default: all of them).

    ``forward_fill``, ``backward_fill``, ``interpolate`` and ``knn_impute``
    need ``order_by``, the row position.
    """
    columns = require_columns(df, df.columns if columns is None else columns)
    if strategy == "drop":
        return drop_incomplete_rows(df, columns)
    if strategy == "fill_mean":
        return fill_mean(df, columns)
    if strategy == "fill_median":
        return fill_median(df, columns)
    if strategy == "fill_mode":
        return fill_mode(df, columns)
    if strategy == "fill_custom":
        return fill_custom(df, fill_value, columns)
    if strategy not in ("forward_fill", "backward_fill", "interpolate", "knn_impute"):
        raise ValueError(f"unknown strategy: {strategy!r}")
    if not order_by:
        raise ValueError(f"{strategy} needs order_by")
    targets = [c for c in columns if c not in order_by]
    df = replace_columns(df, {c: value_of(df, c) for c in targets})
    if strategy == "forward_fill":
        return fill_ordered(df, targets, order_by, "forward")
    if strategy == "backward_fill":
        return fill_ordered(df, targets, order_by, "backward")
    if strategy == "interpolate":
        return interpolate_ordered(df, _numeric(df, targets), order_by)
    from tablewright.operators.knn import knn_impute

    return knn_impute(df, _numeric(df, targets), order_by)
