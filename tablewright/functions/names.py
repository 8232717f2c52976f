"""Column-name normalisation, for schemas (str) and for header data (Column)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions.text import SPACE_CLASS, remove_special_chars, strip_edges

UNNAMED = "unnamed_column"  # fixed value: name given to a missing or empty header


def clean_name(name: str | None) -> str:
    if name is None:
        return UNNAMED
    kept = re.sub(r"[^\w\s]", "", str(name).strip())
    return re.sub(r"\s+", "_", kept).lower() or UNNAMED


def clean_name_column(c: Column) -> Column:
    kept = remove_special_chars(strip_edges(c))
    snake = F.lower(F.regexp_replace(kept, f"[{SPACE_CLASS}]+", "_"))
    return F.when(c.isNull() | (snake == ""), F.lit(UNNAMED)).otherwise(snake)
