"""Automatic cleaning in a fixed order of steps."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions import casts
from tablewright.operators.columns import (
    drop_empty_rows,
    null_counts,
    numeric_columns,
    prepare,
    quoted,
    replace_columns,
    require_batch,
    text_columns,
)
from tablewright.operators.missing import fill_median, fill_mode
from tablewright.operators.outliers import remove_outliers
from tablewright.operators.text import CONVERSIONS, clean_text, fix_encoding
from tablewright.session import materialize

# Share of NULLs above which a column goes, fence of the outlier
# step, share of numbers above which a text column is converted.
SPARSE = {False: 0.8, True: 0.5}
OUTLIER_FENCE = 2.0
CASTABLE_SHARE = 0.8
GENTLE = ["remove_extra_spaces", "normalize_whitespace"]
THOROUGH = ["remove_special_chars", "lowercase"]

_EMPTY = "_has_value"  # NULL on rows without any value


@dataclass
class CleanReport:
    rows_before: int = 0
    rows_after: int = 0
    columns_before: int = 0
    columns_after: int = 0
    operations: list[str] = field(default_factory=list)
    issues: list[str] = field(default_factory=list)

    def to_frame(self, like: DataFrame) -> DataFrame:
        """(measure, value) rows."""
        rows = [
            ("rows_before", str(self.rows_before)),
            ("rows_after", str(self.rows_after)),
            ("rows_removed", str(self.rows_before - self.rows_after)),
            ("columns_before", str(self.columns_before)),
            ("columns_after", str(self.columns_after)),
            ("columns_removed", str(self.columns_before - self.columns_after)),
            ("operations", "; ".join(self.operations)),
            ("issues", "; ".join(self.issues)),
        ]
        return like.sparkSession.createDataFrame(rows, "measure string, value string")


def castable_types(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Text columns that hold mostly numbers, with the type to convert to."""
    if not columns:
        return {}
    numbers = df.select(*[casts.to_number(quoted(c)).alias(f"x{i}") for i, c in enumerate(columns)])
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i in range(len(columns)):
        number = F.col(f"x{i}")
        aggs += [
            F.count(number).alias(f"n{i}"),
            F.coalesce(F.bool_and(casts.is_whole(number)), F.lit(True)).alias(f"w{i}"),
        ]
    row = numbers.agg(*aggs).first()
    return {
        c: "integer" if row[f"w{i}"] else "float"
        for i, c in enumerate(columns)
        if row[f"n{i}"] > row["rows"] * CASTABLE_SHARE
    }


def auto_clean(
    df: DataFrame, aggressive: bool = False, ascii_only: bool = True
) -> tuple[DataFrame, CleanReport]:
    """Repair, drop empties and duplicates, clean text, fill, convert.

    The only shuffle of whole rows is the duplicate removal.  Its result is
    written to the scratch folder once, because every later step needs
    statistics of it; those read single columns of the written table.
    ``ascii_only=False`` keeps letters of all languages.
    """
    require_batch(df, "auto_clean")
    report = CleanReport(columns_before=len(df.columns))

    fixed = fix_encoding(prepare(df), ascii_only=ascii_only)
    report.operations.append("fixed encoding")

    anything = reduce(lambda a, b: a | b, [quoted(c).isNotNull() for c in fixed.columns])
    rows, nulls = null_counts(fixed.withColumn(_EMPTY, F.when(anything, True)))
    filled = rows - nulls.pop(_EMPTY)
    report.rows_before = rows
    empty = [c for c, n in nulls.items() if rows and n == rows]
    if empty:
        fixed = fixed.drop(*empty)
        report.issues.append(f"removed {len(empty)} empty columns")
    if not fixed.columns:
        return fixed, report

    filled_rows = drop_empty_rows(fixed)
    if filled < rows:
        report.issues.append(f"removed {rows - filled} empty rows")

    unique = materialize(filled_rows.dropDuplicates(), "unique")
    texts = text_columns(unique)
    cleaned = clean_text(unique, texts, GENTLE + (THOROUGH if aggressive else []))
    kept, nulls = null_counts(cleaned)
    if kept < filled:
        report.operations.append("removed duplicates")
        report.issues.append(f"removed {filled - kept} duplicate rows")
    if texts:
        report.operations.append("cleaned text")

    limit = SPARSE[aggressive]
    sparse = [c for c, n in nulls.items() if kept and n / kept > limit]
    cleaned = cleaned.drop(*sparse)
    report.issues += [f"removed column {c} ({nulls[c] / kept:.1%} missing)" for c in sparse]

    gaps = [c for c in cleaned.columns if nulls[c]]
    number_gaps = [c for c in gaps if c in numeric_columns(cleaned)]
    text_gaps = [c for c in gaps if c in text_columns(cleaned)]
    if number_gaps:
        cleaned = fill_median(cleaned, number_gaps)
        report.operations.append("filled numbers with median")
    if text_gaps:
        cleaned = fill_mode(cleaned, text_gaps)
        report.operations.append("filled text with mode")

    if aggressive and numeric_columns(cleaned):
        cleaned = remove_outliers(cleaned, numeric_columns(cleaned), "iqr", OUTLIER_FENCE)
        report.operations.append("removed outliers")

    mapping = castable_types(cleaned, text_columns(cleaned))
    if mapping:
        cleaned = replace_columns(
            cleaned, {c: CONVERSIONS[kind](quoted(c)) for c, kind in mapping.items()}
        )
        report.operations.append("converted types")

    report.rows_after = cleaned.count() if aggressive else kept
    report.columns_after = len(cleaned.columns)
    return cleaned, report
