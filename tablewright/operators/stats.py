"""Exact statistics that stay distributed: percentiles, modes, value counts."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.columns import quoted, require_batch, require_columns

# Distinct values one task may hold for an exact answer.
MAX_DISTINCT = 1_000_000
_SKETCH_SIZE = 2000  # size parameter of a quantile sketch, rank error well below 1 %
_MAX_SKETCH_SIZE = 65_535
_MERGE_GROUPS = 256  # sketches are merged in two levels
_SLACK = 0.01


def quantile_sketches(
    df: DataFrame, wanted: Sequence[tuple[Column, Sequence[float]]], size: int = _SKETCH_SIZE
) -> list[list[float]]:
    """Approximate quantiles of several double expressions in one pass.

    Each entry is an expression with the shares asked of it; one without any
    value gives an empty list.  Sketches of all tasks are merged in groups
    before the last merge, so no task receives one sketch per task of a large
    job.
    """
    size = min(max(size, _SKETCH_SIZE), _MAX_SKETCH_SIZE)
    group = F.pmod(F.spark_partition_id(), F.lit(_MERGE_GROUPS)).alias("_group")
    first, last, quantiles = [], [], []
    for i, (x, shares) in enumerate(wanted):
        n, sketch = f"_n{i}", f"_s{i}"
        first += [F.count(x).alias(n), F.kll_sketch_agg_double(x, size).alias(sketch)]
        last += [F.sum(n).alias(n), F.kll_merge_agg_double(sketch, size).alias(sketch)]
        asked = F.array(*[F.lit(float(p)) for p in shares])
        quantiles.append(
            F.when(F.col(n) > 0, F.kll_sketch_get_quantile_double(sketch, asked)).alias(n)
        )
    merged = df.groupBy(group).agg(*first).agg(*last)
    return [list(q or []) for q in merged.select(*quantiles).first()]


def _number(column: str, kind: T.DataType) -> Column:
    c = quoted(column).cast("double")
    return F.nanvl(c, F.lit(None).cast("double")) if isinstance(kind, (T.DoubleType, T.FloatType)) else c


@dataclass
class _Search:
    """A rank of a column, known to lie strictly between ``low`` and ``high``."""

    column: str
    rank: int
    inside: int  # values between the bounds
    below: int = 0  # values up to the lower bound
    low: float | None = None  # None: no bound
    high: float | None = None

    def shares(self) -> list[float]:
        share = (self.rank - self.below + 0.5) / self.inside
        return [max(share - _SLACK, 0.0), share, min(share + _SLACK, 1.0)]

    def interval(self) -> tuple[str, float | None, float | None]:
        return self.column, self.low, self.high


def _between(column: str, low: float | None, high: float | None) -> Column:
    x = F.col(column)
    inside = x.isNotNull()
    if low is not None:
        inside &= x > low
    if high is not None:
        inside &= x < high
    return inside


def _narrow(df: DataFrame, searches: list[_Search]) -> dict[tuple[str, int], float]:
    """One round for all searches: propose marks by sketch, count exactly, cut.

    Returns the ranks that fell on a mark; the others have smaller intervals.
    """
    shares: dict[tuple, set[float]] = {}
    for s in searches:
        shares.setdefault(s.interval(), set()).update(s.shares())
    asked = {at: sorted(values) for at, values in shares.items()}
    sketches = quantile_sketches(
        df, [(F.when(_between(*at), F.col(at[0])), values) for at, values in asked.items()]
    )
    proposals = {at: dict(zip(asked[at], values)) for at, values in zip(asked, sketches)}

    edges = {}
    for s in searches:
        marks = sorted({proposals[s.interval()][share] for share in s.shares()})
        edges[s.column, s.rank] = [s.low, *marks, s.high]
    gaps = dict.fromkeys(
        (c, a, b) for (c, _), points in edges.items() for a, b in zip(points, points[1:])
    )
    hits = dict.fromkeys((c, m) for (c, _), points in edges.items() for m in points[1:-1])
    counts = df.agg(
        *[F.count_if(_between(*gap)) for gap in gaps],
        *[F.count_if(F.col(c) == m) for c, m in hits],
    ).first()
    hits = dict(zip(hits, counts[len(gaps) :]))
    gaps = dict(zip(gaps, counts))

    found = {}
    for s in searches:
        points = edges[s.column, s.rank]
        for a, b in zip(points, points[1:]):
            inside = gaps[s.column, a, b]
            if s.rank < s.below + inside:
                s.low, s.high, s.inside = a, b, inside
                break
            s.below += inside
            at_mark = hits.get((s.column, b), 0)
            if s.rank < s.below + at_mark:
                found[s.column, s.rank] = b
                break
            s.below += at_mark
    return found


def _select_ranks(
    df: DataFrame, rows: dict[str, int], ranks: dict[str, set[int]], max_distinct: int
) -> dict[tuple[str, int], float]:
    """Values at zero-based ranks of the sorted columns, all columns together.

    Sketches decide how fast the answer is found but not what it is.  Once an
    interval holds few values they are ranked; all such intervals together in
    one job.
    """
    open_ = [_Search(c, r, rows[c]) for c, wanted in ranks.items() for r in sorted(wanted)]
    found: dict[tuple[str, int], float] = {}
    ready: list[_Search] = []
    while open_:
        found |= _narrow(df, open_)
        open_ = [s for s in open_ if (s.column, s.rank) not in found]
        ready += [s for s in open_ if s.inside <= max_distinct]
        open_ = [s for s in open_ if s not in ready]
    if not ready:
        return found
    spots = F.array(
        *[
            F.when(
                _between(*s.interval()), F.struct(F.lit(i).alias("i"), F.col(s.column).alias("x"))
            )
            for i, s in enumerate(ready)
        ]
    )
    hit = df.select(F.explode(F.filter(spots, lambda spot: spot.isNotNull())).alias("s"))
    counts = hit.groupBy("s.i", "s.x").count()
    # max_distinct rows per interval at most
    upto = F.sum("count").over(Window.partitionBy("i").orderBy("x"))
    offset = F.element_at(F.array(*[F.lit(s.rank - s.below) for s in ready]), F.col("i") + 1)
    beyond = counts.withColumn("upto", upto).filter(F.col("upto") > offset)
    for row in beyond.groupBy("i").agg(F.min("x").alias("x")).collect():
        found[ready[row["i"]].column, ready[row["i"]].rank] = row["x"]
    return found


def exact_percentiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    max_distinct: int = MAX_DISTINCT,
) -> dict[str, list[float | None]]:
    """Linearly interpolated percentiles of each column, NULL and NaN skipped.

    Columns with up to ``max_distinct`` different values are counted per
    value, all of them in one shuffle of partial counts, and the percentiles
    come from the counts.  Other columns are narrowed down rank by rank.
    """
    require_batch(df, "exact_percentiles")
    columns = require_columns(df, columns)
    if not columns:
        return {}
    kinds = {f.name: f.dataType for f in df.schema}
    numbers = df.select(*[_number(c, kinds[c]).alias(f"x{i}") for i, c in enumerate(columns)])
    names = numbers.columns
    probe = numbers.agg(
        *[F.count(x).alias(f"n_{x}") for x in names],
        *[F.approx_count_distinct(x).alias(f"d_{x}") for x in names],
    ).first()
    small = [x for x in names if probe[f"d_{x}"] <= max_distinct]
    found: dict[str, list[float | None]] = {x: [None] * len(probabilities) for x in names}
    if small:
        exact = F.percentile("value", list(probabilities), F.col("count")).alias("p")
        for row in value_counts(numbers, small).groupBy("column").agg(exact).collect():
            found[row["column"]] = list(row["p"])
    large = [x for x in names if x not in small]
    if large:
        rows = {x: probe[f"n_{x}"] for x in large}
        spots = {x: [p * (rows[x] - 1) for p in probabilities] for x in large}
        ranks = {x: {r for s in spots[x] for r in (math.floor(s), math.ceil(s))} for x in large}
        at = _select_ranks(numbers.select(*large), rows, ranks, max_distinct)
        for x in large:
            ends = [(s, at[x, math.floor(s)], at[x, math.ceil(s)]) for s in spots[x]]
            found[x] = [
                low if low == high else low + (high - low) * (s - math.floor(s))
                for s, low, high in ends
            ]
    return {c: found[x] for c, x in zip(columns, names)}


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per (column, value) for columns of one type; NULLs left out.

    The columns are stacked and counted together: one shuffle of partial
    counts however many columns there are.
    """
    require_batch(df, "value_counts")
    columns = require_columns(df, columns)
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), quoted(c).alias("value")) for c in columns]
    )
    stacked = df.select(F.explode(cells).alias("cell")).select("cell.column", "cell.value")
    return stacked.filter(F.col("value").isNotNull()).groupBy("column", "value").count()


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, Any]:
    """Most frequent value of each column, the smallest on a tie, None if all NULL."""
    columns = require_columns(df, columns)
    by_type: dict[str, list[str]] = {}
    for c in columns:
        by_type.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    out: dict[str, Any] = dict.fromkeys(columns)
    for group in by_type.values():
        best = F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("value")
        for row in value_counts(df, group).groupBy("column").agg(best).collect():
            out[row["column"]] = row["value"]
    return out


def top_values(df: DataFrame, columns: Sequence[str], n: int = 3) -> DataFrame:
    """The n most frequent values per column, ties by value.

    The rank filter is applied before the shuffle as well (window group
    limit), so a column with many values sends n rows per task.
    """
    ranked = value_counts(df, columns).withColumn(
        "rank",
        F.row_number().over(
            Window.partitionBy("column").orderBy(F.col("count").desc(), F.col("value"))
        ),
    )
    return ranked.filter(F.col("rank") <= n).select("column", "rank", "value", "count")
