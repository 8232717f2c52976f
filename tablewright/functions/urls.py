"""URL validation and relative-reference resolution as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def with_scheme(c: Column, default: str = "https") -> Column:
    """Prefix addresses that do not start with http:// or https://."""
    return F.when(c.rlike(r"^https?://"), c).otherwise(F.concat(F.lit(f"{default}://"), c))


def scheme_of(c: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lit(""))


def host_of(c: Column) -> Column:
    """Authority part without user info and port, lower-cased."""
    authority = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.nullif(F.lower(F.regexp_replace(authority, r"^.*@|:\d*$", "")), F.lit(""))


def path_of(c: Column) -> Column:
    """Path with query, ``/`` when empty; what robots rules are matched against."""
    rest = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def is_valid_url(c: Column) -> Column:
    """A scheme and a host are both required."""
    return F.coalesce(c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), F.lit(False))


def _remove_dot_segments(path: Column) -> Column:
    """Fold ``.`` and ``..`` segments of an absolute path."""
    segments = F.split(F.substring(path, 2, 2**31 - 1), "/", -1)

    def fold(acc: Column, segment: Column) -> Column:
        up = F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(
            F.array().cast("array<string>")
        )
        return (
            F.when(segment == "..", up)
            .when(segment == ".", acc)
            .otherwise(F.array_append(acc, segment))
        )

    kept = F.aggregate(segments, F.array().cast("array<string>"), fold)
    last = F.element_at(segments, -1)
    closing = F.when(last.isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.lit("/"), F.array_join(kept, "/"), closing)


def resolve(base: Column, href: Column) -> Column:
    """Absolute URL of ``href`` as found on the page at ``base``."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, SCHEME, 0)
    no_fragment = F.regexp_replace(base, r"#.*$", "")
    no_query = F.regexp_replace(base, r"[?#].*$", "")
    base_path = F.regexp_replace(no_query, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    folder = F.regexp_extract(base_path, r"^(.*/)[^/]*$", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)

    href_path = F.regexp_extract(href, r"^([^?#]*)", 1)
    href_tail = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    absolute = F.when(href.startswith("/"), href_path).otherwise(F.concat(folder, href_path))
    has_dots = absolute.rlike(r"/\.\.?(/|$)")
    folded = F.when(has_dots, _remove_dot_segments(absolute)).otherwise(absolute)
    return (
        F.when(href == "", base)
        .when(href.rlike(SCHEME), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("#"), F.concat(no_fragment, href))
        .when(href.startswith("?"), F.concat(no_query, href))
        .otherwise(F.concat(origin, folded, href_tail))
    )
