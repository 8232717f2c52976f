"""Undo, redo and reset over immutable versions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.columns import quoted, require_columns
from tablewright.plans.recipe import Recipe, Step
from tablewright.session import materialize, scratch_path

RECENT_OPERATIONS = 5  # fixed value: operations listed
WRITE_EVERY = 8  # steps after which a version without a key is written
REBASE_SHARE = 0.5  # changed rows, as a share of the base, from which a version becomes a base of its own


@dataclass(frozen=True)
class Version:
    """A written table and the change sets, by number, that lie over it."""

    base: DataFrame
    rows: int
    sets: tuple[int, ...] = ()
    changed: int = 0


class ChangeSets:
    """Versions of a keyed table as rows that differ from a base.

    A change set holds the keys that a step changed, added or removed, with
    their new values.  Any version is one base, one read of the sets over it,
    reduced to the last one of each key, and one join, however many steps led
    to it; an older version is the same base with fewer sets.  A step that changes
    columns, or much of the table, starts a new base.
    """

    def __init__(self, df: DataFrame, key: Sequence[str]):
        self.key = list(require_columns(df, key))
        self.folder = scratch_path(df.sparkSession, "changes")
        self.made = 0

    def based(self, df: DataFrame) -> Version:
        base = materialize(df, "base")
        return Version(base, base.count())

    def _values(self, df: DataFrame) -> list[str]:
        return [c for c in df.columns if c not in self.key]

    def table(self, version: Version) -> DataFrame:
        if not version.sets:
            return version.base
        base, values = version.base, self._values(version.base)
        keys = [f"k{i}" for i in range(len(self.key))]
        row = T.StructType([T.StructField(f"v{i}", base.schema[c].dataType) for i, c in enumerate(values)])
        kinds = [T.StructField(k, base.schema[c].dataType) for k, c in zip(keys, self.key)]
        schema = T.StructType([*kinds, T.StructField("gone", T.BooleanType()), T.StructField("row", row), T.StructField("step", T.IntegerType())])
        sets = base.sparkSession.read.schema(schema).parquet(self.folder).filter(F.col("step").isin(*version.sets))
        last = sets.groupBy(*keys).agg(F.max_by(F.struct("gone", "row"), "step").alias("last"))
        on = [quoted(c).eqNullSafe(F.col(k)) for c, k in zip(self.key, keys)]
        both = base.withColumn("_here", F.lit(True)).join(last, on, "full_outer").filter(~F.coalesce(F.col("last.gone"), F.lit(False)))
        new = F.col("last").isNotNull()
        picked = {c: F.when(F.col("_here"), quoted(c)).otherwise(F.col(k)) for c, k in zip(self.key, keys)}
        picked |= {c: F.when(new, F.col(f"last.row.v{i}")).otherwise(quoted(c)) for i, c in enumerate(values)}
        return both.select(*[picked[c].alias(c) for c in base.columns])

    def after(self, version: Version, step: Step) -> Version:
        """The version that a step leads to; its change set is found by one join on the key and written."""
        old = self.table(version)
        new = step.apply(old)
        if [(f.name, f.dataType) for f in new.schema] != [(f.name, f.dataType) for f in old.schema]:
            return self.based(new)
        values = self._values(old)
        row = F.struct(*[quoted(c).alias(f"v{i}") for i, c in enumerate(values)])
        keys = [quoted(c).alias(f"k{i}") for i, c in enumerate(self.key)]
        before = old.select(*[k.alias(f"o{i}") for i, k in enumerate(keys)], row.alias("was"))
        now = new.select(*keys, row.alias("row"))
        on = [F.col(f"o{i}").eqNullSafe(F.col(f"k{i}")) for i in range(len(keys))]
        paired = before.join(now, on, "full_outer").filter(~F.col("was").eqNullSafe(F.col("row")))
        gone = F.col("row").isNull()
        names = [F.when(gone, F.col(f"o{i}")).otherwise(F.col(f"k{i}")).alias(f"k{i}") for i in range(len(keys))]
        self.made += 1
        at = f"{self.folder}/step={self.made}"
        paired.select(*names, gone.alias("gone"), "row").write.parquet(at)
        changed = version.changed + old.sparkSession.read.parquet(at).count()
        found = Version(version.base, version.rows, (*version.sets, self.made), changed)
        return self.based(self.table(found)) if changed > REBASE_SHARE * version.rows else found


class CleaningSession:
    """A table with its versions.

    With ``key``, columns that identify the rows, versions are change sets over
    a written base, see ``ChangeSets``; the key and every column must be comparable.
    Without one a version is a plan, and after every ``materialize_every`` steps
    the current version is written to the scratch folder to keep plans short.
    """

    def __init__(self, df: DataFrame, materialize_every: int | None = WRITE_EVERY, key: Sequence[str] | None = None):
        self._sets = ChangeSets(df, key) if key else None
        self._original: DataFrame | Version = self._sets.based(df) if self._sets else df
        self._versions = [self._original]
        self._steps: list[Step] = []
        self._cursor = 0
        self._every = materialize_every
        self._applied = 0

    @property
    def data(self) -> DataFrame:
        version = self._versions[self._cursor]
        return self._sets.table(version) if self._sets else version

    def apply(self, operation: str, **parameters: Any) -> DataFrame:
        """Run a step on the current version; undone versions are forgotten."""
        step = Step(operation, parameters)
        if self._sets:
            after = self._sets.after(self._versions[self._cursor], step)
        else:
            after = step.apply(self.data)
            self._applied += 1
            if self._every and self._applied % self._every == 0:
                after = materialize(after, "version")
        self._versions = [*self._versions[: self._cursor + 1], after]
        self._steps = [*self._steps[: self._cursor], step]
        self._cursor = len(self._versions) - 1
        return self.data

    def can_undo(self) -> bool:
        return self._cursor > 0

    def can_redo(self) -> bool:
        return self._cursor < len(self._versions) - 1

    def undo(self) -> DataFrame:
        if not self.can_undo():
            raise ValueError("no operation to undo")
        self._cursor -= 1
        return self.data

    def redo(self) -> DataFrame:
        if not self.can_redo():
            raise ValueError("no operation to redo")
        self._cursor += 1
        return self.data

    def reset(self) -> DataFrame:
        """Back to the original table, history cleared."""
        self._versions, self._steps, self._cursor = [self._original], [], 0
        self._applied = 0
        return self.data

    def recent_operations(self) -> list[Step]:
        return self._steps[: self._cursor][-RECENT_OPERATIONS:]

    def to_recipe(self, name: str) -> Recipe:
        return Recipe(name, list(self._steps[: self._cursor]))
