"""Text, casts, formats and names against Python and pandas."""

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.functions import casts, formats, names, text, urls
from tablewright.operators import text as table_text

TEXT8 = [
    "  Extra   Spaces  ",
    "UPPERCASE TEXT",
    "Mixed Case Text",
    "Text with <html>tags</html>",
    "Text\nwith\ttabs\rand\nnewlines",
    "Text with 123 numbers",
    "Text with !@#$%^&*() special chars",
    "Normal text",
]
STRANGE = [
    *TEXT8,
    "it's x2y öl-straße ÉTÉ",
    "non breaking space",
    "日本abc ٣٤ arabic",
    "_under score_",
    "",
    None,
    "a\x1cb\x85c",
    "<b>x</b>  <i>",
    "naïve CAFÉ—dash",
]


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in df.select("i", fn(F.col("v"))).orderBy("i").collect()]


PYTHON = {
    "remove_special_chars": lambda s: tidy(re.sub(r"[^\w\s]", "", s)),
    "remove_extra_spaces": lambda s: tidy(s),
    "lowercase": str.lower,
    "uppercase": str.upper,
    "title_case": str.title,
    "remove_numbers": lambda s: tidy(re.sub(r"\d+", "", s)),
    "remove_html_tags": lambda s: tidy(re.sub(r"<[^>]+>", "", s)),
    "normalize_whitespace": lambda s: tidy(s),
}


def tidy(s):
    return re.sub(r"\s+", " ", s).strip()


@pytest.mark.parametrize("operation", sorted(PYTHON))
def test_operation_like_python(spark, operation):
    got = column(spark, STRANGE, lambda c: text.apply_operations(c, [operation]))
    assert got == [None if s is None else PYTHON[operation](s) for s in STRANGE]


def test_chain(spark):
    operations = [
        "remove_extra_spaces",
        "normalize_whitespace",
        "lowercase",
        "remove_html_tags",
        "remove_numbers",
        "remove_special_chars",
    ]
    got = column(spark, TEXT8, lambda c: text.apply_operations(c, operations))
    assert got == [
        "extra spaces",
        "uppercase text",
        "mixed case text",
        "text with tags",
        "text with tabs and newlines",
        "text with numbers",
        "text with special chars",
        "normal text",
    ]


def test_unknown_operation(spark):
    with pytest.raises(ValueError, match="shout"):
        text.apply_operations(F.col("v"), ["shout"])


def test_fix_encoding(spark):
    damaged = ["Donâ€™t", "â€œqâ€", "cafÃ© Ã­", "tab\tnew\nline", None]
    assert column(spark, damaged, text.fix_encoding) == ["Don't", '"q"', "caf ", "tabnewline", None]
    kept = column(spark, damaged, lambda c: text.fix_encoding(c, ascii_only=False))
    assert kept == ["Don't", '"q"', "café í", "tabnewline", None]


NUMBERS = [
    "1e5", " 12 ", "$7", "1,000", "0x1A", ".5", "5.", "1_000", "", "1d", "7f", None,
    "-3.0", "+4", "inf", "-Infinity", "abc", "1 2", "\t8\n", "9223372036854775807", "1e400",
]


def test_to_number_like_pandas(spark):
    got = column(spark, NUMBERS, casts.to_number)
    expected = pd.to_numeric(pd.Series(NUMBERS, dtype=object), errors="coerce")
    for value, a, b in zip(NUMBERS, got, expected):
        assert (a is None and pd.isna(b)) or a == pytest.approx(b, rel=1e-12), value


def test_to_integer_keeps_digits(spark):
    got = column(spark, ["9007199254740993", "12.0", "1e3", "x"], casts.to_integer)
    assert got == [9007199254740993, 12, 1000, None]


def test_integer_with_fraction_stays_float(spark):
    df = spark.createDataFrame([("1",), ("2.5",)], "v string")
    out, problems = table_text.convert_types(df, {"v": "integer", "w": "float"})
    assert out.schema["v"].dataType.simpleString() == "double"
    assert set(problems) == {"v", "w"}


def test_to_boolean(spark):
    words = ["TRUE", "no", "1", "N", "y", "maybe", None]
    assert column(spark, words, casts.to_boolean) == [True, False, True, False, True, None, None]


def test_datetime_layouts(spark):
    days = ["2020-01-15", "2021/02/20", "March 15, 2022", "2023-04-10", "x", None]
    got = column(spark, days, lambda c: casts.to_datetime(c).cast("string"))
    assert got[:4] == [f"{d} 00:00:00" for d in ("2020-01-15", "2021-02-20", "2022-03-15", "2023-04-10")]
    assert got[4:] == [None, None]


def test_first_layout_decides(spark):
    df = spark.createDataFrame([(1, "2020-01-15"), (2, "2021/02/20"), (3, None)], "i int, d string")
    out = table_text.convert_datetime(df, "d", ["i"]).orderBy("i").collect()
    assert [r["d"] is not None for r in out] == [True, False, False]


def test_formats4(spark):
    phones = ["123-456-7890", "(555) 123-4567", "5551234567", "1-555-123-4567", None, "12"]
    assert column(spark, phones, formats.phone) == [
        "(123) 456-7890", "(555) 123-4567", "(555) 123-4567", "(155) 512-34567", None, "12",
    ]
    money = ["$50,000", "60000.50", "€70", "n/a", None, "-1234.5"]
    assert column(spark, money, formats.currency) == [50000.0, 60000.5, 70.0, None, None, -1234.5]
    shown = column(spark, money, lambda c: formats.currency(c, "$"))
    assert shown == ["$50,000.00", "$60,000.50", "$70.00", None, None, "$-1,234.50"]
    mails = ["JOHN@EMAIL.COM", " jane@email.com ", "BOB@INVALID", None]
    assert column(spark, mails, formats.email) == ["john@email.com", "jane@email.com", "bob@invalid", None]
    assert column(spark, mails, formats.is_valid_email) == [True, True, False, False]
    dates = column(spark, ["2020-01-15", "March 15, 2022", "x"], lambda c: formats.date(c, "%d/%m/%y"))
    assert dates == ["15/01/20", "15/03/22", None]


@pytest.mark.parametrize(
    "pattern,replacement",
    [(r"(\w+)@(\w+)", r"\2 at \1"), (r"\d+", "$"), (r"(?P<a>\w)\s", r"\g<a>-"), ("é", r"\\")],
)
def test_regex_rule_like_python(spark, pattern, replacement):
    values = ["joe@site 12", "été 5$", "a b c"]
    got = column(spark, values, lambda c: formats.regex(c, pattern.replace("?P<", "?<"), replacement))
    assert got == [re.sub(pattern, replacement, v) for v in values]


def test_strftime_patterns():
    assert casts.spark_date_pattern("%Y-%m-%d at %H:%M") == "yyyy-MM-dd' at 'HH:mm"
    with pytest.raises(ValueError):
        casts.spark_date_pattern("%Q")


HEADERS = ["Nation Key!", " N  Name ", "", None, "!?", "Ünï cödé", "a-b", "x_y"]


def test_names_agree(spark):
    expected = [names.clean_name(h) for h in HEADERS]
    assert column(spark, HEADERS, names.clean_name_column) == expected
    assert expected[:5] == ["nation_key", "n_name", "unnamed_column", "unnamed_column", "unnamed_column"]


def test_resolve_like_urljoin(spark):
    from urllib.parse import urljoin

    bases = ["http://h.org/a/b/c.html?x=1#top", "https://h.org", "http://h.org:80/a/"]
    hrefs = [
        "d.html", "/x/y", "//cdn.org/z", "?page=2", "#frag", "../up", "../../../far", "./here", "x/./y/../z",
        "http://other.org/q", "mailto:a@b.c", "", "..", ".", "x/..", "a?b=/../c",
    ]
    pairs = [(b, h) for b in bases for h in hrefs]
    df = spark.createDataFrame(pairs, "b string, h string")
    got = df.select("b", "h", urls.resolve(F.col("b"), F.col("h")).alias("u")).collect()
    for row in got:
        assert row["u"] == urljoin(row["b"], row["h"]), (row["b"], row["h"])


def test_url_parts(spark):
    values = ["https://user@Host.org:8080/p?q#f", "host.org/x", "http://", None]
    assert column(spark, values, urls.host_of)[:2] == ["host.org", None]
    assert column(spark, values, urls.is_valid_url) == [True, False, False, False]
    assert column(spark, values, urls.path_of)[0] == "/p?q"
    assert column(spark, values, urls.with_scheme)[1] == "https://host.org/x"
