"""The model store as tables: weight deltas, their byte encoding, and chains of parents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType


def subtract(new: DataFrame, base: DataFrame, key: str, weights: str) -> DataFrame:
    """key and delta: elementwise new - base."""
    old = base.select(key, F.col(weights).alias("_base"))
    return new.join(old, key).select(key, F.zip_with(weights, "_base", lambda a, b: a - b).alias("delta"))


def add(delta: DataFrame, base: DataFrame, key: str, weights: str) -> DataFrame:
    """key and weights, from deltas and their base."""
    return delta.join(base.select(key, F.col(weights).alias("_base")), key).select(key, F.zip_with("_base", "delta", lambda a, b: a + b).alias(weights))


def rle_encode(data: bytes) -> bytes:
    """Pairs of count (1 to 255) and byte."""
    out, at = bytearray(), 0
    while at < len(data):
        end = at
        while end < len(data) and end - at < 255 and data[end] == data[at]:
            end += 1
        out += bytes((end - at, data[at]))
        at = end
    return bytes(out)


def rle_decode(data: bytes) -> bytes:
    return b"".join(bytes((data[i + 1],)) * data[i] for i in range(0, len(data), 2))


def xor(a: bytes, b: bytes) -> bytes:
    return (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).to_bytes(len(a), "big")


@F.pandas_udf(BinaryType())
def xor_delta(new: pd.Series, base: pd.Series) -> pd.Series:
    """Run-length coded XOR of two equally long byte strings."""
    return pd.Series([rle_encode(xor(a, b)) for a, b in zip(new, base, strict=True)])


@F.pandas_udf(BinaryType())
def xor_restore(delta: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([xor(rle_decode(d), b) for d, b in zip(delta, base, strict=True)])


def parents(models: DataFrame, every: int) -> DataFrame:
    """models (id_model, pipeline) with parent: every n-th of a pipeline is stored whole, others hang on the last whole one."""
    from pyspark.sql import Window

    w = Window.partitionBy("pipeline").orderBy("id_model")
    place = F.row_number().over(w) - 1
    whole = F.last(F.when(place % every == 0, F.col("id_model")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return models.withColumn("_whole", whole).withColumn("parent", F.when(F.col("_whole") != F.col("id_model"), F.col("_whole"))).drop("_whole")


def deletable(models: DataFrame) -> DataFrame:
    """Models on which no other hangs."""
    used = models.where("parent is not null").select(F.col("parent").alias("id_model")).distinct()
    return models.join(used, "id_model", "left_anti")
