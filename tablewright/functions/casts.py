"""Lenient casts: a value that does not fit becomes NULL, never an error."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted number syntax and boolean words.
NUMBER_PATTERN = r"^[\t-\r ]*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[\t-\r ]*$"
INFINITY_PATTERN = r"(?i)^[\t-\r ]*[+-]?inf(inity)?[\t-\r ]*$"
BOOLEAN_WORDS = {
    "true": True,
    "false": False,
    "yes": True,
    "no": False,
    "1": True,
    "0": False,
    "y": True,
    "n": False,
}

# Layouts tried for dates, first match wins (Spark datetime patterns).
DATETIME_FORMATS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "dd.MM.yyyy",
    "MMMM d, yyyy",
)

# strftime directives and the Spark pattern letters that print the same.
STRFTIME = {
    "%Y": "yyyy",
    "%y": "yy",
    "%m": "MM",
    "%d": "dd",
    "%H": "HH",
    "%I": "hh",
    "%M": "mm",
    "%S": "ss",
    "%f": "SSSSSS",
    "%p": "a",
    "%b": "MMM",
    "%B": "MMMM",
    "%a": "EEE",
    "%A": "EEEE",
    "%j": "DDD",
    "%%": "%",
}


def to_number(c: Column) -> Column:
    """Text (or number) to double.  ``1,000``, ``$7``, ``0x1A``, ``1_000`` -> NULL."""
    text = c.cast("string")
    parsed = text.try_cast("double")
    in_range = F.when(F.abs(parsed) < F.lit(float("inf")), parsed)
    return F.when(text.rlike(NUMBER_PATTERN), in_range).when(text.rlike(INFINITY_PATTERN), parsed)


def to_integer(c: Column) -> Column:
    """Whole numbers to bigint; long digit strings keep every digit."""
    text = c.cast("string")
    either = F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))
    return F.when(text.rlike(NUMBER_PATTERN), either)


def is_whole(number: Column) -> Column:
    """True when a double has no fraction and fits in a bigint."""
    return (number == F.floor(number)) & (F.abs(number) < F.lit(2.0**63))


def _may_fit(text: Column, fmt: str) -> Column:
    """A cheap test that every text of a layout passes: a digit, and the signs that stand between the layout's fields."""
    bare = re.sub(r"'[^']*'", "", fmt)
    fits = text.rlike(r"\d")
    for sign in sorted(set(re.findall(r"[-/.:,]", bare))):
        fits = fits & text.contains(sign)
    return fits


def to_datetime(c: Column, formats: Sequence[str] = DATETIME_FORMATS) -> Column:
    """Text to a timestamp without a zone, by the first layout that fits.

    The session's zone takes no part: a wall-clock time that it skips stays as written.
    """
    text = F.concat(c.cast("string"), F.lit(" +00:00"))
    tries = [F.when(_may_fit(c.cast("string"), fmt), F.try_to_timestamp(text, F.lit(f"{fmt} XXX"))) for fmt in formats]
    seconds = F.unix_micros(F.coalesce(*tries)).cast("decimal(20,0)") / F.lit(1_000_000)
    since = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + since


def to_boolean(c: Column) -> Column:
    word = F.lower(c.cast("string"))
    out = F.lit(None).cast("boolean")
    for text, value in BOOLEAN_WORDS.items():
        out = F.when(word == text, F.lit(value)).otherwise(out)
    return out


def spark_date_pattern(strftime: str) -> str:
    """Translate a strftime format into a Spark datetime pattern."""
    out, literal, i = [], "", 0

    def flush() -> None:
        nonlocal literal
        if literal:
            quoted = literal.replace("'", "''")
            out.append(f"'{quoted}'" if any(ch.isalpha() for ch in literal) else quoted)
            literal = ""

    while i < len(strftime):
        directive = strftime[i : i + 2]
        if directive == "%%":
            literal, i = literal + "%", i + 2
        elif directive in STRFTIME:
            flush()
            out.append(STRFTIME[directive])
            i += 2
        elif strftime[i] == "%":
            raise ValueError(f"unsupported date directive: {directive}")
        else:
            literal, i = literal + strftime[i], i + 1
    flush()
    return "".join(out)
