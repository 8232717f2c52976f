"""Nearest-neighbour imputation.

Rows with a value are donors, different rows with a gap are queries.  Donors
are dealt to cells of a tree over the coordinates.  A query first visits the
cell that can hold its nearest donors, which gives it a distance bound, and then
only the cells whose bounds come nearer than that.  Queries and donors meet in
equi-joins on the cell; what leaves a task is the k best donors of a query.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.operators import nearest
from tablewright.operators.columns import quoted, require_batch, require_columns
from tablewright.operators.missing import fill_values
from tablewright.session import materialize

cloudpickle.register_pickle_by_value(nearest)

NEIGHBOURS = 5  # fixed value
CELL_ROWS = 4_096  # donors of a cell, while there are fewer than MAX_CELLS cells
MAX_CELLS = 4_096  # bounds the table of cells
MAX_BOUNDS = 1 << 20  # numbers in that table
SAMPLE_A_CELL = 16  # sampled donors that shape the tree, a cell; results do not depend on them
TILE_ROWS = 1 << 16  # donors, and queries, that meet in one task


def _with_cells(df: DataFrame, tree: nearest.CellTree, numbers: list[str]) -> DataFrame:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = pa.array(tree.cells_of(nearest.matrix(batch, numbers)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, cell], names=[*batch.schema.names, "cell"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(assign, f"{kinds}, cell int")


class NeighbourSearch:
    """The search for the k nearest donors of every query.

    ``plain`` has order columns o0.. and coordinates x0.. ; rows with equal coordinates are equally far from everything,
    so that only the k first of them can be needed and all of them are one query: a point that a third of all rows
    share costs no more than others.
    """

    def __init__(self, plain: DataFrame, numbers: list[str], orders: list[str], k: int, size: int | None = None):
        self.numbers, self.orders, self.k = numbers, orders, k
        self.gap = reduce(lambda a, b: a | b, [F.col(x).isNull() for x in numbers])
        self.known = reduce(lambda a, b: a | b, [F.col(x).isNotNull() for x in numbers])
        giving = plain.filter(self.known)
        first = Window.partitionBy(*numbers).orderBy(*orders)
        kept = giving.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k).drop("_n")
        asking = plain.filter(self.known & self.gap).select(*numbers).distinct()
        self.queries = materialize(asking.withColumn("query", F.monotonically_increasing_id()), "queries")
        size = giving.count() if size is None else size
        cells = max(1, min(-(-size // CELL_ROWS), MAX_CELLS, MAX_BOUNDS // (3 * len(numbers))))
        self.tree = self._tree(giving.select(*numbers), size, cells)
        dealt = _with_cells(kept, self.tree, numbers) if cells > 1 else kept.withColumn("cell", F.lit(0))
        self.donors = materialize(dealt, "donors")
        self.cells = self._cells() if cells > 1 else None

    def _tree(self, giving: DataFrame, size: int, cells: int) -> nearest.CellTree:
        """A tree from a sample of bounded size."""
        if cells == 1:
            return nearest.grow_tree(np.zeros((0, len(self.numbers))), 1)
        most = SAMPLE_A_CELL * cells
        sample = giving.sample(min(1.0, 1.2 * most / size), seed=7).limit(2 * most).toArrow()
        return nearest.grow_tree(np.unique(nearest.matrix(sample, self.numbers), axis=0), cells)

    def _cells(self) -> nearest.Cells:
        """One row per cell, at most MAX_BOUNDS numbers."""
        found = self.donors.groupBy("cell").agg(
            F.count(F.lit(1)).alias("rows"),
            *[f(x).alias(f"{name}{i}") for i, x in enumerate(self.numbers) for name, f in (("low", F.min), ("high", F.max), ("known", F.count))],
        )
        rows = found.toArrow()
        low, high, known = (nearest.matrix(rows, [f"{name}{i}" for i in range(len(self.numbers))]) for name in ("low", "high", "known"))
        return nearest.Cells(rows.column("cell").to_numpy(), rows.column("rows").to_numpy(), low, high, known)

    def home_visits(self) -> DataFrame:
        """(query, x, cell): the cells that a query visits first."""
        cells, numbers, k = self.cells, self.numbers, self.k
        if cells is None:
            return self.queries.withColumn("cell", F.lit(0))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, points in nearest.blocks(nearest.matrix(batch, numbers), cells.low.size):
                    query, cell = np.nonzero(cells.homes(points, k))
                    rows = batch.take(pa.array(query + first))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cells.cell[cell], pa.int32())], names=[*batch.schema.names, "cell"])

        return self.queries.mapInArrow(route, self._visit_schema())

    def further_visits(self, bounds: DataFrame) -> DataFrame:
        """(query, x, cell): all other cells that come as near as a gap's k-th distance so far, ``bounds`` (query, bounds);
        a gap without one visits all that have a value for it."""
        cells, numbers, k = self.cells, self.numbers, self.k
        asked = self.queries.join(bounds, "query", "left").select(*self.queries.columns, "bounds")

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                every = nearest.matrix(batch, numbers)
                limits = np.full(every.shape, np.inf)
                for i, pairs in enumerate(batch.column("bounds").to_pylist()):
                    for pair in pairs or []:
                        limits[i, pair["target"]] = pair["distance"]
                for first, points in nearest.blocks(every, cells.low.size):
                    near = cells.within(points, limits[first : first + len(points)]) & ~cells.homes(points, k)
                    query, cell = np.nonzero(near)
                    columns = batch.take(pa.array(query + first)).columns[:-1]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(cells.cell[cell], pa.int32())], names=[*batch.schema.names[:-1], "cell"])

        return asked.mapInArrow(route, self._visit_schema())

    def _visit_schema(self) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.queries.schema) + ", cell int"

    def best_of(self, visits: DataFrame) -> DataFrame:
        """(query, target, distance, value, order columns) of the k best donors in the visited cells of each task.

        A cell with more donors or visits than a tile holds is cut: part i of its donors meets part j of its visits.
        """
        numbers, orders, k = self.numbers, self.orders, self.k
        counted = visits.groupBy("cell").agg(F.count(F.lit(1)).alias("asked"))
        sizes = self.donors.groupBy("cell").agg(F.count(F.lit(1)).alias("given"))
        parts = lambda c: F.ceil(F.col(c) / TILE_ROWS).cast("int")
        plan = F.broadcast(counted.join(sizes, "cell").select("cell", parts("given").alias("p"), parts("asked").alias("q")))
        of = lambda key, n: F.pmod(F.xxhash64(*key), F.col(n)).cast("int")
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        given = self.donors.join(plan, "cell").withColumn("i", of(orders, "p")).withColumn("j", upto("q"))
        asked = visits.join(plan, "cell").withColumn("j", of(["query"], "q")).withColumn("i", upto("p"))
        kinds = {f.name: f.dataType.simpleString() for f in self.donors.schema}
        given = given.select("cell", "i", "j", F.lit(None).cast("long").alias("query"), *numbers, *orders)
        asked = asked.select("cell", "i", "j", "query", *numbers, *[F.lit(None).cast(kinds[o]).alias(o) for o in orders])

        def search(tile: pa.Table) -> pa.Table:
            ids = tile.column("query").combine_chunks()
            donors, queries = tile.filter(ids.is_null()), tile.filter(ids.is_valid())
            donors = donors.take(pc.sort_indices(donors, [(o, "ascending") for o in orders], null_placement="at_start"))
            points, rows = nearest.matrix(queries, numbers), nearest.matrix(donors, numbers)
            out = []
            for t in range(len(numbers)):
                open_ = np.flatnonzero(np.isnan(points[:, t]))
                point, donor, distance = nearest.k_best(points[open_], rows, rows[:, t], k)
                chosen = donors.take(pa.array(donor))
                columns = {
                    "query": queries.column("query").take(pa.array(open_[point])),
                    "target": pa.array(np.full(len(point), t, dtype=np.int32)),
                    "distance": pa.array(distance),
                    "value": chosen.column(numbers[t]),
                }
                out.append(pa.table(columns | {o: chosen.column(o) for o in orders}))
            return pa.concat_tables(out)

        schema = "query long, target int, distance double, value double, " + ", ".join(f"`{o}` {kinds[o]}" for o in orders)
        return given.unionByName(asked).groupBy("cell", "i", "j").applyInArrow(search, schema)

    def k_best(self, found: DataFrame) -> DataFrame:
        """The k best of what different tasks found."""
        order = Window.partitionBy("query", "target").orderBy("distance", *self.orders)
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= self.k)

    def means(self) -> DataFrame:
        """(x, m): each query with the mean of its k nearest values for each gap, NULL where no donor is usable."""
        visits = self.home_visits()
        best = self.k_best(self.best_of(visits if self.cells is None else materialize(visits, "visits")))
        if self.cells is not None:
            best = materialize(best, "nearest")
            full = best.filter(F.col("rank") == self.k).groupBy("query").agg(F.collect_list(F.struct("target", "distance")).alias("bounds"))
            visits = materialize(self.further_visits(full), "visits")
            best = self.k_best(best.drop("rank").unionByName(self.best_of(visits)))
        targets = range(len(self.numbers))
        means = best.groupBy("query").agg(*[F.avg(F.when(F.col("target") == t, F.col("value"))).alias(f"m{t}") for t in targets])
        return self.queries.join(means, "query").drop("query")


def knn_impute(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], k: int = NEIGHBOURS) -> DataFrame:
    """Mean of the k nearest rows that have the value, into each NULL.

    Distances use the coordinates two rows share, scaled up to all of them; a
    tie goes to the earlier row; without any usable donor the column mean is
    taken.  ``order_by`` identifies the rows.  The search is exact.  Only a
    sample that shapes the tree and the bounds of its cells, both of bounded
    size, reach the driver.  Rows without a gap are not moved.
    """
    require_batch(df, "knn_impute")
    columns = list(require_columns(df, columns))
    require_columns(df, order_by)
    if not columns:
        return df
    # -0.0 and 0.0 are one coordinate
    number = {c: F.nanvl(quoted(c).cast("double"), F.lit(None).cast("double")) + F.lit(0.0) for c in columns}
    numbers = [f"x{i}" for i in range(len(columns))]
    orders = [f"o{i}" for i in range(len(order_by))]
    gap = reduce(lambda a, b: a | b, [number[c].isNull() for c in columns])
    known = reduce(lambda a, b: a | b, [number[c].isNotNull() for c in columns])
    stats = df.agg(F.count_if(gap & known), F.count_if(known), *[F.avg(number[c]) for c in columns]).first()
    means = dict(zip(columns, stats[2:]))
    if not stats[0]:
        return fill_values(df, means, widen=True)

    plain = df.select(
        *[quoted(c).alias(o) for c, o in zip(order_by, orders)],
        *[number[c].alias(x) for c, x in zip(columns, numbers)],
    )
    answers = NeighbourSearch(materialize(plain, "plain"), numbers, orders, k, stats[1]).means()
    open_ = df.filter(gap)
    on = [number[c].eqNullSafe(F.col(x)) for c, x in zip(columns, numbers)]
    joined = open_.join(answers, reduce(lambda a, b: a & b, on), "left")
    new = {c: F.coalesce(number[c], F.col(f"m{i}"), F.lit(means[c]).cast("double")).alias(c) for i, c in enumerate(columns)}
    filled = joined.select(*[new.get(c, df[f"`{c}`"]) for c in df.columns])
    whole = df.filter(~gap).select(*[quoted(c).cast("double").alias(c) if c in new else quoted(c) for c in df.columns])
    return whole.unionAll(filled)
