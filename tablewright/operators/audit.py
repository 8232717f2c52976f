"""What changed: counters per step and cell-level differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.columns import quoted, require_batch, require_columns

AUDIT_SCHEMA = (
    "step int, operation string, parameters string, columns string,"
    " records_affected bigint, seconds double"
)


def _paired(before: DataFrame, after: DataFrame, key: Sequence[str], columns: Sequence[str]):
    """Full outer join on the key with both versions of each column."""
    require_columns(before, [*key, *columns])
    require_columns(after, [*key, *columns])
    old = before.select(
        *[quoted(k) for k in key],
        F.lit(True).alias("_in_old"),
        *[quoted(c).alias(f"_old{i}") for i, c in enumerate(columns)],
    )
    new = after.select(
        *[quoted(k) for k in key],
        F.lit(True).alias("_in_new"),
        *[quoted(c).alias(f"_new{i}") for i, c in enumerate(columns)],
    )
    return old.join(new, list(key), "full_outer")


def changed_values(
    before: DataFrame, after: DataFrame, key: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """(column, changed): values that differ, NULL to NULL being no change."""
    require_batch(before, "changed_values")
    paired = _paired(before, after, key, columns)
    counted = paired.agg(
        *[
            F.count_if(~F.col(f"_old{i}").eqNullSafe(F.col(f"_new{i}"))).alias(f"_{i}")
            for i in range(len(columns))
        ]
    )
    tidy = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("changed"))
            for i, c in enumerate(columns)
        ]
    )
    return counted.select(F.explode(tidy).alias("r")).select("r.*")


def diff_tables(
    before: DataFrame, after: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """(key, change, column, old_value, new_value) of every cell that differs.

    One join on the key; rows on one side only are reported as removed or
    added, with their values.
    """
    require_batch(before, "diff_tables")
    if columns is None:
        columns = [c for c in before.columns if c in after.columns and c not in key]
    paired = _paired(before, after, key, columns)
    change = (
        F.when(F.col("_in_new").isNull(), "removed")
        .when(F.col("_in_old").isNull(), "added")
        .otherwise("changed")
    )
    cells = F.array(
        *[
            F.when(
                ~F.col(f"_old{i}").eqNullSafe(F.col(f"_new{i}")),
                F.struct(
                    F.lit(c).alias("column"),
                    F.col(f"_old{i}").cast("string").alias("old_value"),
                    F.col(f"_new{i}").cast("string").alias("new_value"),
                ),
            )
            for i, c in enumerate(columns)
        ]
    )
    differing = F.filter(cells, lambda cell: cell.isNotNull())
    return paired.select(
        *[quoted(k) for k in key], change.alias("change"), F.explode(differing).alias("cell")
    ).select(*[quoted(k) for k in key], "change", "cell.column", "cell.old_value", "cell.new_value")
