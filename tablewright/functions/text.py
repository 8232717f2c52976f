"""Text cleaning expressions.

Every function maps a string column to a string column with built-in
expressions only, so a chain of them stays one projection.  NULL stays NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes.  Java's \w, \s and \d are ASCII-only, the cleaning rules
# are Unicode-aware, so the classes are spelt out.
SPACE_CLASS = r"\t-\r\x1c-\x20\x{85}\p{Z}"
WORD_CLASS = r"\p{L}\p{N}_"

# What each damaged sequence stands for, applied in this order.
MOJIBAKE = {
    "â€™": "'",
    "â€œ": '"',
    "â€": '"',
    "Ã¡": "á",
    "Ã©": "é",
    "Ã\u00ad": "í",
    "Ã³": "ó",
    "Ãº": "ú",
    "Ã±": "ñ",
}


def remove_special_chars(c: Column) -> Column:
    return F.regexp_replace(c, f"[^{WORD_CLASS}{SPACE_CLASS}]", "")


def collapse_spaces(c: Column) -> Column:
    """Runs of any white space become one space; both ends are trimmed."""
    return F.trim(F.regexp_replace(c, f"[{SPACE_CLASS}]+", " "))


def title_case(c: Column) -> Column:
    """Capital after every character that is not a cased letter (``It'S``)."""
    cased = r"\p{Lu}\p{Ll}\p{Lt}"
    runs = F.regexp_extract_all(c, F.lit(f"([{cased}]+|[^{cased}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def remove_numbers(c: Column) -> Column:
    return F.regexp_replace(c, r"\p{Nd}+", "")


def remove_html_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]+>", "")


def strip_edges(c: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.regexp_replace(c, f"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$", "")


def fix_encoding(c: Column, ascii_only: bool = True) -> Column:
    """Repair double-decoded sequences, then drop unprintable characters.

    ``ascii_only`` keeps printable ASCII only; with False all of Unicode
    survives except control characters.
    """
    repaired = reduce(
        lambda acc, pair: F.replace(acc, F.lit(pair[0]), F.lit(pair[1])),
        MOJIBAKE.items(),
        c,
    )
    return F.regexp_replace(repaired, r"[^\x20-\x7E]" if ascii_only else r"\p{Cc}", "")


OPERATIONS: dict[str, Callable[[Column], Column]] = {
    "remove_special_chars": remove_special_chars,
    "remove_extra_spaces": collapse_spaces,
    "lowercase": F.lower,
    "uppercase": F.upper,
    "title_case": title_case,
    "remove_numbers": remove_numbers,
    "remove_html_tags": remove_html_tags,
    "normalize_whitespace": collapse_spaces,
}

# Operations that can leave gaps behind and are followed by a space clean-up.
REMOVALS = {"remove_special_chars", "remove_numbers", "remove_html_tags"}


def apply_operations(c: Column, operations: Iterable[str]) -> Column:
    """Apply named operations in order, then the clean-up they call for."""
    operations = list(operations)
    unknown = [op for op in operations if op not in OPERATIONS]
    if unknown:
        raise ValueError(f"unknown text operations: {unknown}; known: {sorted(OPERATIONS)}")
    out = reduce(lambda acc, op: OPERATIONS[op](acc), operations, c)
    return collapse_spaces(out) if REMOVALS & set(operations) else out
