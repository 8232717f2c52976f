"""Operators that depend on the order of the whole table.

A window without a partition key would pull the table into one task.  Here
the table is cut into blocks that follow the order; each block is handled on
its own and a table with one row per block carries values across the seams.  The
windows leave the table partitioned by block, so joining the block table moves
only the latter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.columns import quoted, require_batch, require_columns
from tablewright.operators.stats import quantile_sketches
from tablewright.session import materialize

BLOCK = "_block"
MAX_BLOCKS = 16_384  # bounds the table with one row per block
HOT_CUTS = 6  # a value that fills this many cuts needs more than the leading column


def _as_double(df: DataFrame, column: str) -> Column | None:
    """Monotone double for a numeric or temporal column; None for other types."""
    kind = df.schema[column].dataType
    c = quoted(column)
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        # whole seconds of the wall clock; no time zone can reorder them
        clock = F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
        return (F.unix_date(c.cast("date")).cast("double") * 86400) + clock
    return None


def block_count(df: DataFrame) -> int:
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(8, min(4 * shuffle, MAX_BLOCKS))


def add_blocks(df: DataFrame, order_by: Sequence[str], blocks: int | None = None) -> DataFrame:
    """Number the rows' blocks so that a smaller block always sorts first.

    Normally the block is looked up from quantiles of the leading order
    column, found with one aggregate over that column: a projection, stable
    however often it is evaluated.  A leading column that is text, or that
    repeats one value over several quantiles, cannot be cut that way; then
    the rows are range-partitioned on the full order and written once.
    """
    require_batch(df, "ordered operators")
    require_columns(df, order_by)
    blocks = blocks or block_count(df)
    lead = _as_double(df, order_by[0])
    if lead is not None:
        shares = [i / blocks for i in range(1, blocks)]
        (cuts,) = quantile_sketches(df, [(lead, shares)], 4 * blocks)
        if cuts and max(Counter(cuts).values()) < HOT_CUTS:
            splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
            keyed = df.withColumn("_lead", lead)
            cutter = Bucketizer(
                splits=splits, inputCol="_lead", outputCol=BLOCK, handleInvalid="keep"
            )
            cut = cutter.transform(keyed).drop("_lead")
            # rows without a position come first, as they do when sorting
            return cut.withColumn(BLOCK, F.coalesce(F.col(BLOCK).cast("int"), F.lit(-1)))
    ranged = df.repartitionByRange(blocks, *[quoted(c) for c in order_by])
    return materialize(ranged.withColumn(BLOCK, F.spark_partition_id()), "ordered")


def _forward(order_by: Sequence[str]):
    return (
        Window.partitionBy(BLOCK)
        .orderBy(*[quoted(c).asc() for c in order_by])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def _backward(order_by: Sequence[str]):
    """Reading backwards keeps the frame a running one; a frame that ends at
    the last row is recomputed for every row."""
    return (
        Window.partitionBy(BLOCK)
        .orderBy(*[quoted(c).desc() for c in order_by])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def _earlier_blocks():
    """Frame over the table with one row per block, at most MAX_BLOCKS rows."""
    return Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)


def _later_blocks():
    return Window.orderBy(F.col(BLOCK).desc()).rowsBetween(Window.unboundedPreceding, -1)


def global_row_number(
    df: DataFrame, order_by: Sequence[str], name: str, start: int = 1, blocks: int | None = None
) -> DataFrame:
    """Consecutive row numbers over the whole table in the given order."""
    blocked = add_blocks(df, order_by, blocks)
    offsets = (
        blocked.groupBy(BLOCK)
        .count()
        .select(BLOCK, F.coalesce(F.sum("count").over(_earlier_blocks()), F.lit(0)).alias("_offset"))
    )
    numbered = blocked.withColumn("_n", F.row_number().over(_forward(order_by)))
    return numbered.join(offsets, BLOCK).select(
        *[quoted(c) for c in df.columns],
        (F.col("_n") + F.col("_offset") + (start - 1)).cast("bigint").alias(name),
    )


def fill_ordered(
    df: DataFrame,
    columns: Sequence[str],
    order_by: Sequence[str],
    direction: str = "forward",
    blocks: int | None = None,
) -> DataFrame:
    """Replace NULL by the nearest earlier (forward) or later (backward) value."""
    if direction not in ("forward", "backward"):
        raise ValueError(f"direction must be forward or backward, not {direction!r}")
    require_columns(df, columns)
    forward = direction == "forward"
    blocked = add_blocks(df, order_by, blocks)

    position = F.struct(*[quoted(c) for c in order_by])
    edge = F.max_by if forward else F.min_by
    edges = blocked.groupBy(BLOCK).agg(
        *[
            edge(quoted(c), F.when(quoted(c).isNotNull(), position)).alias(f"_edge{i}")
            for i, c in enumerate(columns)
        ]
    )
    seam = _earlier_blocks() if forward else _later_blocks()
    carries = edges.select(
        BLOCK,
        *[
            F.last(f"_edge{i}", ignorenulls=True).over(seam).alias(f"_carry{i}")
            for i in range(len(columns))
        ],
    )
    frame = _forward(order_by) if forward else _backward(order_by)
    local = blocked.withColumns(
        {
            f"_local{i}": F.last(quoted(c), ignorenulls=True).over(frame)
            for i, c in enumerate(columns)
        }
    )
    filled = {
        c: F.coalesce(F.col(f"_local{i}"), F.col(f"_carry{i}")).alias(c)
        for i, c in enumerate(columns)
    }
    return local.join(carries, BLOCK).select(
        *[filled.get(c, quoted(c)) for c in df.columns]
    )


def interpolate_ordered(
    df: DataFrame, columns: Sequence[str], order_by: Sequence[str], blocks: int | None = None
) -> DataFrame:
    """Linear interpolation by row position.

    Leading NULLs stay, trailing NULLs take the last value.
    """
    require_columns(df, columns)
    blocked = add_blocks(df, order_by, blocks)
    forward, backward = _forward(order_by), _backward(order_by)

    def point(c: str) -> Column:
        """Position and value of a row that has a value."""
        value = quoted(c).cast("double")
        return F.when(value.isNotNull(), F.struct(F.col("_n").alias("n"), value.alias("v")))

    narrow = blocked.select(BLOCK, *{c: quoted(c) for c in [*order_by, *columns]}.values())
    numbered = narrow.withColumn("_n", F.row_number().over(forward))
    edges = numbered.groupBy(BLOCK).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.max(point(c)).alias(f"_last{i}") for i, c in enumerate(columns)],
        *[F.min(point(c)).alias(f"_first{i}") for i, c in enumerate(columns)],
    )
    offsets = edges.withColumn("_offset", F.coalesce(F.sum("_rows").over(_earlier_blocks()), F.lit(0)))

    def shifted(name: str) -> Column:
        p = F.col(name)
        return F.when(
            p.isNotNull(), F.struct((p["n"] + F.col("_offset")).alias("n"), p["v"].alias("v"))
        )

    carries = offsets.select(
        BLOCK,
        "_offset",
        *[
            F.last(shifted(f"_last{i}"), ignorenulls=True).over(_earlier_blocks()).alias(f"_before{i}")
            for i in range(len(columns))
        ],
        *[
            F.last(shifted(f"_first{i}"), ignorenulls=True).over(_later_blocks()).alias(f"_after{i}")
            for i in range(len(columns))
        ],
    )

    local = blocked.withColumn("_n", F.row_number().over(forward))
    local = local.withColumns(
        {f"_prev{i}": F.last(point(c), ignorenulls=True).over(forward) for i, c in enumerate(columns)}
        | {f"_next{i}": F.last(point(c), ignorenulls=True).over(backward) for i, c in enumerate(columns)}
    )
    joined = local.join(carries, BLOCK)

    def value(i: int, c: str) -> Column:
        here = F.col("_n") + F.col("_offset")
        before = F.coalesce(shifted(f"_prev{i}"), F.col(f"_before{i}"))
        after = F.coalesce(shifted(f"_next{i}"), F.col(f"_after{i}"))
        slope = F.try_divide(after["v"] - before["v"], after["n"] - before["n"])
        between = before["v"] + slope * (here - before["n"])
        return F.coalesce(quoted(c).cast("double"), between, before["v"])

    new = {c: value(i, c).alias(c) for i, c in enumerate(columns)}
    return joined.select(*[new.get(c, quoted(c)) for c in df.columns])
