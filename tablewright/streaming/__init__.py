"""Operators on streaming DataFrames.

Row-local steps, page parsing and extraction run on a stream as they are.
Duplicates are removed with state that a watermark bounds.  Operators that need
statistics or an order of the whole table refuse a stream; on each micro-batch
they run in ``write_batches``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tablewright.operators.columns import require_columns
from tablewright.plans.recipe import Recipe

BATCH = "_batch"  # partition column of the files that ``write_batches`` makes


def read_stream(
    spark: SparkSession, path: str, schema: str | T.StructType, fmt: str = "parquet", files_a_batch: int | None = None
) -> DataFrame:
    """Files that arrive below ``path``, in micro-batches of ``files_a_batch`` files at most."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.load(path)


def run_on_stream(stream: DataFrame, recipe: Recipe) -> DataFrame:
    """Apply a recipe of row-local steps to a streaming DataFrame."""
    other = [s.operation for s in recipe.steps if not s.is_row_local()]
    if other:
        raise ValueError(f"steps that need the whole table: {other}")
    return recipe.run(stream)


def drop_stream_duplicates(stream: DataFrame, subset: Sequence[str], event_time: str, delay: str) -> DataFrame:
    """The first row of each key to arrive; repeats within ``delay`` of its event time are dropped.

    State holds one entry per key and is cleared once the watermark, the
    latest event time less ``delay``, passes the key's expiry; rows older than
    the watermark are late and dropped too.  NULL is a key like others.
    """
    require_columns(stream, [*subset, event_time])
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(subset))


def write_batches(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write the stream as Parquet, each micro-batch, after ``transform``, into a folder of its own.

    A micro-batch is an ordinary table, so that ``transform`` may use any
    operator.  One that is repeated after a failure replaces its folder: every
    row is written once.  By default what is there is processed, then it ends.
    """

    def write(batch: DataFrame, number: int) -> None:
        out = transform(batch) if transform else batch
        out.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All rows that ``write_batches`` has written."""
    return spark.read.parquet(path).drop(BATCH)
