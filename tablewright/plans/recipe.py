"""Saved recipes: a JSON list of named steps, replayed on any table."""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tablewright.operators import columns, dedup, missing, outliers, profile, text
from tablewright.operators.audit import AUDIT_SCHEMA
from tablewright.operators.columns import quoted
from tablewright.plans.auto_clean import auto_clean
from tablewright.session import materialize
from tablewright.sources.writers import ExportOptions, read_dataset, write_dataset

STEPS = {
    "drop_duplicates": dedup.drop_duplicates,
    "flag_duplicates": dedup.flag_duplicates,
    "handle_missing": missing.handle_missing,
    "clean_text": text.clean_text,
    "fix_encoding": text.fix_encoding,
    "cast_values": text.cast_values,
    "convert_types": lambda df, mapping: text.convert_types(df, mapping)[0],
    "apply_inferred_types": profile.apply_inferred_types,
    "standardize_formats": text.standardize_formats,
    "remove_outliers": outliers.remove_outliers,
    "rename_columns": columns.rename_columns,
    "normalize_column_names": columns.normalize_column_names,
    "reorder_columns": columns.reorder_columns,
    "drop_columns": columns.drop_columns,
    "drop_sparse_columns": columns.drop_sparse_columns,
    "drop_empty_columns": columns.drop_empty_columns,
    "drop_empty_rows": columns.drop_empty_rows,
    "add_columns": columns.add_columns,
    "filter_rows": columns.filter_rows,
    "sort_rows": columns.sort_rows,
    "auto_clean": lambda df, aggressive=False: auto_clean(df, aggressive)[0],
}

# Steps that keep every row and column name, so that values can be compared.
VALUE_STEPS = {
    "handle_missing",
    "clean_text",
    "fix_encoding",
    "standardize_formats",
}

# Steps that read nothing but the row they change: no statistics first, no shuffle.
ROW_STEPS = {
    "clean_text",
    "fix_encoding",
    "standardize_formats",
    "cast_values",
    "rename_columns",
    "normalize_column_names",
    "reorder_columns",
    "drop_columns",
    "add_columns",
    "filter_rows",
    "drop_empty_rows",
}
ROW_STRATEGIES = {"drop", "fill_custom"}  # of handle_missing
_OLD = "_before_step"  # the values that a step is about to change


@dataclass
class Step:
    operation: str
    parameters: dict[str, Any] = field(default_factory=dict)
    description: str = ""

    def apply(self, df: DataFrame) -> DataFrame:
        if self.operation not in STEPS:
            raise ValueError(f"unknown operation: {self.operation}; known: {sorted(STEPS)}")
        return STEPS[self.operation](df, **self.parameters)

    def is_row_local(self) -> bool:
        return self.operation in ROW_STEPS or (
            self.operation == "handle_missing" and self.parameters.get("strategy") in ROW_STRATEGIES
        )

    def changes_values(self) -> bool:
        return self.operation in VALUE_STEPS and self.parameters.get("strategy") != "drop"

    def observed(self, df: DataFrame, key: Sequence[str]) -> tuple[DataFrame, Observation]:
        """The step's result, and an observation of its rows and of the values that differ from before.

        Old values travel through the step beside the new ones, so that both stand in one row.
        """
        metrics = [F.count(F.lit(1)).alias("rows")]
        seen = Observation()
        if not self.changes_values():
            return self.apply(df).observe(seen, *metrics), seen
        targets = [c for c in self.target_columns() or df.columns if c not in key]
        kept = df.withColumn(_OLD, F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(targets)]))
        step = self
        if self.operation == "handle_missing":
            step = Step(self.operation, {"columns": df.columns} | self.parameters)
        after = step.apply(kept)
        changed = [(~F.col(f"{_OLD}.c{i}").eqNullSafe(quoted(c))).cast("bigint") for i, c in enumerate(targets)]
        metrics.append(F.sum(sum(changed, F.lit(0).cast("bigint"))).alias("changed"))
        return after.observe(seen, *metrics).drop(_OLD), seen

    def target_columns(self) -> list[str]:
        p = self.parameters
        named = p.get("columns") or p.get("subset") or p.get("mapping") or p.get("rules") or []
        return list(named)


@dataclass
class Recipe:
    """Name, steps and export settings of one cleaning job."""

    name: str
    steps: list[Step] = field(default_factory=list)
    export: dict[str, Any] = field(default_factory=dict)
    tags: list[str] = field(default_factory=list)

    @classmethod
    def from_json(cls, text_: str) -> Recipe:
        spec = json.loads(text_)
        steps = [Step(**step) for step in spec.get("steps", [])]
        return cls(spec["name"], steps, spec.get("export", {}), spec.get("tags", []))

    def to_json(self) -> str:
        return json.dumps(
            {
                "name": self.name,
                "steps": [vars(step) for step in self.steps],
                "export": self.export,
                "tags": self.tags,
            },
            indent=2,
            ensure_ascii=False,
        )

    def run(self, df: DataFrame) -> DataFrame:
        """Apply the steps; the result is one lazy plan wherever steps allow."""
        for step in self.steps:
            df = step.apply(df)
        return df

    def run_and_export(self, df: DataFrame, path: str) -> DataFrame:
        """Apply the steps, write the result as the export settings say and read it back."""
        options = ExportOptions(**self.export)
        return read_dataset(df.sparkSession, path, write_dataset(self.run(df), path, options))

    def run_with_audit(self, df: DataFrame, key: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
        """Result, as a written table, and audit table, one row per step.

        Every step runs once.  Row-local steps form a chain that is written in
        one go; other steps start from a written table and are written
        themselves.  Rows, and values changed in columns other than ``key``, are
        observed in the tasks that write, which count once even where a lost
        executor has them run again.  ``seconds`` is a step's share of its chain.
        """
        start = Observation()
        current = df.observe(start, F.count(F.lit(1)).alias("rows"))
        chain: list[tuple[Step, Observation]] = []
        done: list[tuple[Step, Observation, float]] = []
        written = False

        def write(df: DataFrame) -> DataFrame:
            began = time.time()
            table = materialize(df, "recipe")
            done.extend((step, seen, (time.time() - began) / len(chain)) for step, seen in chain)
            chain.clear()
            return table

        for step in self.steps:
            if not step.is_row_local() and (chain or not written):
                current = write(current)
            current, seen = step.observed(current, key)
            chain.append((step, seen))
            written = not step.is_row_local()
            if written:
                current = write(current)
        if chain or not written:
            current = write(current)

        rows, before = [], start.get.get("rows", 0)
        for number, (step, seen, seconds) in enumerate(done, 1):
            after = seen.get.get("rows", 0)
            affected = (seen.get.get("changed") or 0) if step.changes_values() else before - after
            parameters = json.dumps(step.parameters, ensure_ascii=False, sort_keys=True)
            rows.append((number, step.operation, parameters, ",".join(step.target_columns()), affected, seconds))
            before = after
        return current, df.sparkSession.createDataFrame(rows, AUDIT_SCHEMA)


# Ready-made recipes for common jobs.
PRESETS = {
    "contact_list": [
        Step("fix_encoding"),
        Step("drop_empty_rows"),
        Step("drop_duplicates"),
    ],
    "numbers_as_text": [Step("drop_empty_rows"), Step("apply_inferred_types")],
    "quick_clean": [Step("auto_clean")],
}
