"""Words and rates as built-in expressions, shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The six characters that separate words.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """The maximal runs of characters other than SPACE; null and blank texts have none."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE_CLASS + "+")).otherwise(F.array().cast("array<string>"))


def count_of(text: Column, characters: str) -> Column:
    """How many of the characters a text has."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def upto(n: Column) -> Column:
    """0, 1 .. n - 1; none if n is 0 or less."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
