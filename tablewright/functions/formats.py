"""Format rules: phone, date, currency, e-mail and free regular expressions."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions import casts
from tablewright.functions.text import strip_edges

# Default phone layout, date layout, currency signs, e-mail shape.
PHONE_PATTERN = r"(\d{3})(\d{3})(\d{4})"
PHONE_FORMAT = r"(\1) \2-\3"
DATE_FORMAT = "%Y-%m-%d"
CURRENCY_SIGNS = "[$,€£¥]"
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"


def java_pattern(pattern: str) -> str:
    """Make ``\\w``, ``\\d``, ``\\s`` and ``\\b`` Unicode-aware, as in Python."""
    return f"(?U){pattern}"


def java_replacement(replacement: str) -> str:
    r"""``\1`` and ``\g<name>`` become ``$1`` and ``${name}``; a literal ``$`` is escaped."""
    escaped = replacement.replace("$", r"\$")
    escaped = re.sub(r"\\g<(\d+)>", r"$\1", escaped)
    escaped = re.sub(r"\\g<(\w+)>", r"${\1}", escaped)
    return re.sub(r"\\(\d)", r"$\1", escaped)


def phone(c: Column, pattern: str = PHONE_PATTERN, layout: str = PHONE_FORMAT) -> Column:
    """Keep digits only, then lay out every match; the match is not anchored."""
    digits = F.regexp_replace(c.cast("string"), r"\P{Nd}", "")
    return F.regexp_replace(digits, java_pattern(pattern), java_replacement(layout))


def date(c: Column, layout: str = DATE_FORMAT, formats=casts.DATETIME_FORMATS) -> Column:
    parsed = casts.to_datetime(c, formats)
    return F.date_format(parsed, casts.spark_date_pattern(layout))


def currency(c: Column, symbol: str | None = None) -> Column:
    """Number without its currency signs; with ``symbol``, text like ``$1,234.50``."""
    amount = casts.to_number(F.regexp_replace(c.cast("string"), CURRENCY_SIGNS, ""))
    if symbol is None:
        return amount
    return F.concat(F.lit(symbol), F.format_number(amount, 2))


def email(c: Column) -> Column:
    return strip_edges(F.lower(c.cast("string")))


def is_valid_email(c: Column) -> Column:
    """Shape test on the normalised address; NULL is not valid."""
    return F.coalesce(email(c).rlike(EMAIL_PATTERN), F.lit(False))


def regex(c: Column, pattern: str | None, replacement: str = "") -> Column:
    if not pattern:
        return c
    return F.regexp_replace(c.cast("string"), java_pattern(pattern), java_replacement(replacement))


def apply_rule(c: Column, rule: dict[str, Any]) -> Column:
    """Apply one rule given as a dict with a ``type`` and that type's options."""
    kind = rule.get("type")
    if kind == "phone":
        return phone(c, rule.get("pattern", PHONE_PATTERN), rule.get("format", PHONE_FORMAT))
    if kind == "date":
        return date(c, rule.get("format", DATE_FORMAT), rule.get("formats", casts.DATETIME_FORMATS))
    if kind == "currency":
        return currency(c, rule.get("symbol", "$") if rule.get("format") else None)
    if kind == "email":
        return email(c)
    if kind == "regex":
        return regex(c, rule.get("pattern"), rule.get("replacement", ""))
    raise ValueError(f"unknown format rule: {kind!r}")
