"""Outlier filters and outlier shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.columns import numeric_columns, require_batch, value_of
from tablewright.operators.stats import exact_percentiles


def iqr_flags(df: DataFrame, columns: Sequence[str], threshold: float = 1.5) -> dict[str, Column]:
    """Per column, true outside the quartiles widened by ``threshold`` x IQR."""
    flags = {}
    for c, (q1, q3) in exact_percentiles(df, columns, [0.25, 0.75]).items():
        if q1 is None:
            flags[c] = F.lit(False)
            continue
        margin = threshold * (q3 - q1)
        outside = (value_of(df, c) < q1 - margin) | (value_of(df, c) > q3 + margin)
        flags[c] = F.coalesce(outside, F.lit(False))
    return flags


def zscore_flags(df: DataFrame, columns: Sequence[str], threshold: float) -> dict[str, Column]:
    """Per column, true beyond ``threshold`` sample standard deviations.

    An infinite value leaves a column without a deviation, and so without outliers.
    """
    aggs = [f(value_of(df, c)).alias(f"{f.__name__}{i}") for i, c in enumerate(columns) for f in (F.avg, F.stddev_samp)]
    row = df.agg(*aggs).first()
    flags = {}
    for i, c in enumerate(columns):
        z = F.abs(F.try_divide(value_of(df, c) - F.lit(row[2 * i]), F.lit(row[2 * i + 1])))
        flags[c] = F.coalesce(F.nanvl(z.cast("double"), F.lit(None).cast("double")) > threshold, F.lit(False))
    return flags


def remove_outliers(
    df: DataFrame, columns: Sequence[str], method: str = "iqr", threshold: float = 1.5
) -> DataFrame:
    """Drop rows in which any listed numeric column is an outlier.

    All bounds come from the input table.  NULL and NaN are never outliers.
    """
    require_batch(df, "remove_outliers")
    numeric = [c for c in columns if c in numeric_columns(df)]
    if not numeric:
        raise ValueError("no numeric column to look for outliers in")
    if method == "iqr":
        flags = iqr_flags(df, numeric, threshold)
    elif method == "zscore":
        flags = zscore_flags(df, numeric, threshold)
    else:
        raise ValueError(f"unknown outlier method: {method!r}")
    for flag in flags.values():
        df = df.filter(~flag)
    return df


def outlier_share(
    df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 1.5
) -> DataFrame:
    """One row per numeric column: outliers, rows and their ratio."""
    columns = numeric_columns(df) if columns is None else list(columns)
    flags = iqr_flags(df, columns, threshold)
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(flag).alias(f"_{i}") for i, flag in enumerate(flags.values())],
    )
    tidy = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("outliers"))
            for i, c in enumerate(flags)
        ]
    )
    return counted.select(F.explode(tidy).alias("r"), "rows").select(
        "r.column",
        "r.outliers",
        "rows",
        F.round(F.try_divide(F.col("r.outliers"), F.col("rows")), 6).alias("outlier_share"),
    )
