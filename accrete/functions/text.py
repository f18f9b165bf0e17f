"""Text, path and time functions of the data preparation steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " "))


def first_token(text: Column) -> Column:
    return F.get(F.split(one_line(text), " "), F.lit(0))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def padded(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def year_as_day(ts: Column) -> Column:
    """A year shown as so many days since 1970: epoch seconds of that day, plus one second."""
    return (F.year(ts) - 1970).cast("long") * 86_400 + 1


def unsigned(data: Column, size: int, little: bool) -> Column:
    """An unsigned integer from the first `size` bytes of a binary column (up to 7)."""
    digits = F.hex(F.substring(data, 1, size))
    if little:
        digits = F.array_join(F.reverse(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.substr(digits, i * 2 + 1, F.lit(2)))), "")
    return F.conv(digits, 16, 10).cast("long")
