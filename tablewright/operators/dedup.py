"""Duplicate removal and duplicate flags.

A key may hold a large share of all rows.  Every operator here reduces each
key on the map side before anything is shuffled, so a hot key costs one row
per map task and never one huge group; the rows that stay are then found by
the digest of their key and their position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.columns import quoted, require_batch, require_columns


def _check_groupable(df: DataFrame, columns: Sequence[str]) -> None:
    maps = [f.name for f in df.schema if f.name in columns and isinstance(f.dataType, T.MapType)]
    if maps:
        raise ValueError(f"map columns cannot be compared, convert them with to_json: {maps}")


def _order_key(order_by: Sequence[str]) -> Column:
    """Comparable row position; the listed columns together must be unique."""
    if len(order_by) == 1:
        return quoted(order_by[0])
    return F.struct(*[quoted(c) for c in order_by])


def _exact(value: Column, kind: T.DataType) -> Column:
    """A value that prints in full: what grouping tells apart prints differently, what it holds equal prints alike.

    Timestamps print as microseconds, bytes as hexadecimal digits, -0.0 as 0.0 and every NaN as one, at any depth; NULL
    fields and NULL structs stay apart.
    """
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(value == 0, F.lit(0.0).cast(kind)).when(F.isnan(value), F.lit(float("nan")).cast(kind)).otherwise(value)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(kind, T.TimestampNTZType):
        # text like 2024-01-01 00:00:00.000001, in full and without a zone
        return value.cast("string")
    if isinstance(kind, T.BinaryType):
        return F.hex(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _exact(x, kind.elementType))
    if isinstance(kind, T.StructType):
        fields = [_exact(value.getField(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(kind)]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else value
    if isinstance(kind, (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return value
    return value.cast("string")


def _digest(df: DataFrame, columns: Sequence[str]) -> Column:
    """256 bits that stand for the values of a row: what a count of keys has to move."""
    kinds = {f.name: f.dataType for f in df.schema}
    row = F.struct(*[_exact(quoted(c), kinds[c]).alias(f"c{i}") for i, c in enumerate(columns)])
    return F.unhex(F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256))


def drop_duplicates(
    df: DataFrame,
    subset: Sequence[str] | None = None,
    keep: str = "first",
    order_by: Sequence[str] | None = None,
    copies: str | None = None,
) -> DataFrame:
    """Keep the first or last row of each key, or with ``all`` drop repeated keys.

    NULL equals NULL.  ``order_by`` names the row position and is required
    for first/last on a subset; whole-row duplicates are interchangeable and
    need none.  ``copies`` adds a column with the number of rows of the key.
    """
    require_batch(df, "drop_duplicates")
    if keep not in ("first", "last", "all"):
        raise ValueError(f"keep must be first, last or all, not {keep!r}")
    keys = require_columns(df, df.columns if subset is None else subset)
    _check_groupable(df, keys)
    rest = [c for c in df.columns if c not in keys]
    key_columns = [quoted(c) for c in keys]

    if keep == "all":
        picked = [F.first(quoted(c)).alias(c) for c in rest]
        grouped = df.groupBy(*key_columns).agg(F.count(F.lit(1)).alias("_copies"), *picked)
        return grouped.filter("_copies = 1").select(*[quoted(c) for c in df.columns])

    counted = [F.count(F.lit(1)).alias(copies)] if copies else []
    if not rest:
        if copies:
            return df.groupBy(*key_columns).agg(*counted)
        return df.dropDuplicates()
    if not order_by:
        raise ValueError("first/last on a subset needs order_by")
    require_columns(df, order_by)
    picked = _ends(df, keys, order_by, keep == "last", counted)
    kept = _located(df, keys, order_by).join(
        picked, (F.col("_own") == F.col("_key")) & F.col("_position").eqNullSafe(F.col("_end"))
    )
    return kept.select(*[df[f"`{c}`"] for c in df.columns], *([quoted(copies)] if copies else []))


def _ends(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], last: bool, extra: Sequence[Column] = ()
) -> DataFrame:
    """(_key, _end, extra): the first or last position of each key, a NULL position being the smallest.

    Keys are grouped by their digests, so that long texts are neither sorted nor moved.
    """
    position = _order_key(order_by)
    if last:
        end = F.max(position)
    elif len(order_by) == 1:
        end = F.when(~F.bool_or(position.isNull()), F.min(position))
    else:
        end = F.min(position)
    return df.groupBy(_digest(df, keys).alias("_key")).agg(end.alias("_end"), *extra)


def _located(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Rows with the digest of their key, ``_own``, and their ``_position``: together never hot."""
    return df.withColumn("_own", _digest(df, keys)).withColumn("_position", _order_key(order_by))


def flag_duplicates(
    df: DataFrame,
    order_by: Sequence[str],
    subset: Sequence[str] | None = None,
    flag: str = "is_duplicate",
) -> DataFrame:
    """Add a boolean column, true on every occurrence of a key but the first.

    The first position of each key is found with a map-side minimum; the flag
    then joins on key and position, which are unique together, so no key is hot.
    """
    require_batch(df, "flag_duplicates")
    require_columns(df, order_by)
    keys = require_columns(
        df, [c for c in df.columns if c not in order_by] if subset is None else subset
    )
    _check_groupable(df, keys)
    firsts = _ends(df, keys, order_by, last=False)
    marked = _located(df, keys, order_by).join(
        firsts.withColumn("_is_first", F.lit(True)),
        (F.col("_own") == F.col("_key")) & F.col("_position").eqNullSafe(F.col("_end")),
        "left",
    )
    return marked.select(
        *[df[f"`{c}`"] for c in df.columns], F.col("_is_first").isNull().alias(flag)
    )


def duplicate_count(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """One row: rows, duplicates (2nd and later occurrences) and their percentage."""
    require_batch(df, "duplicate_count")
    keys = require_columns(df, df.columns if subset is None else subset)
    _check_groupable(df, keys)
    copies = df.groupBy(_digest(df, keys).alias("_key")).agg(F.count(F.lit(1)).alias("_copies"))
    rows = F.coalesce(F.sum("_copies"), F.lit(0))
    duplicates = F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0))
    return copies.agg(
        rows.alias("row_count"),
        duplicates.alias("duplicate_count"),
        F.round(F.try_divide(duplicates, rows) * 100, 2).alias("duplicate_percent"),
    )
