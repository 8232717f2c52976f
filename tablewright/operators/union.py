"""Unions of tables whose schemas differ."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablewright.operators.columns import quoted


def schema_fingerprint(df: DataFrame) -> tuple[str, ...]:
    return tuple(sorted(df.columns))


def _widen_clashes(frames: Sequence[DataFrame]) -> list[DataFrame]:
    """A column with types that have no common number becomes text everywhere."""
    kinds: dict[str, list[T.DataType]] = {}
    for df in frames:
        for field in df.schema:
            kinds.setdefault(field.name, []).append(field.dataType)
    clashing = {
        name
        for name, found in kinds.items()
        if len({k.simpleString() for k in found}) > 1
        and not all(isinstance(k, T.NumericType) for k in found)
    }
    return [
        df.select(
            *[
                quoted(c).cast("string").alias(c) if c in clashing else quoted(c)
                for c in df.columns
            ]
        )
        for df in frames
    ]


def combine_pages(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of all rows; columns in order of first appearance, absent ones NULL."""
    if not frames:
        raise ValueError("nothing to combine")
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), _widen_clashes(frames)
    )


def unify(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of all rows, tables of equal column sets first brought together.

    Different column sets give the union of columns sorted by name; equal
    sets keep the order of the first table.
    """
    frames = list(frames)
    if not frames:
        raise ValueError("nothing to combine")
    groups: dict[tuple[str, ...], list[DataFrame]] = {}
    for df in frames:
        groups.setdefault(schema_fingerprint(df), []).append(df)
    together = combine_pages([df for group in groups.values() for df in group])
    if len(groups) == 1:
        return together.select(*[quoted(c) for c in frames[0].columns])
    return together.select(*[quoted(c) for c in sorted(together.columns)])
