"""Total orders and portable pseudo-random ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from accrete.session import cut


def global_row_number(df: DataFrame, *order: str, name: str = "idx") -> DataFrame:
    """df with its place (from 0) in a total order, without one task that sorts everything.

    Rows are range-partitioned and sorted inside partitions, written to the checkpoint folder so that places don't move
    when a task is repeated, counted per partition, and shifted by the counts of the partitions before: one row a partition.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mono", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_mono", 33)).withColumn("_local", F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # one row a partition of the shuffle above
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_local")).drop("_mono", "_part", "_local", "_start")


def hash_rank(seed: object, *keys: str) -> Column:
    """Sort by this for a shuffle that any engine with md5 reproduces."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def hash_uniform(seed: object, *keys: str) -> Column:
    """A number in (0, 1) from the first 32 bits of the same digest."""
    return (F.conv(F.substring(hash_rank(seed, *keys), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)


def sample_n(df: DataFrame, n: int, seed: object, key: str = "key") -> DataFrame:
    """n rows without replacement, uniform by hash; a top-k, so only n rows a task are gathered."""
    return df.orderBy(hash_rank(seed, key), key).limit(n)


def weighted_sample_n(df: DataFrame, n: int, weight: str, seed: object, key: str = "key") -> DataFrame:
    """n rows without replacement with probability in proportion to weight: the n least exponential keys -ln(u) / w."""
    return df.where(F.col(weight) > 0).withColumn("_k", -F.log(hash_uniform(seed, key)) / F.col(weight)).orderBy("_k", key).limit(n).drop("_k")


def first_per_group(df: DataFrame, group: str, n: Column | int, *order) -> DataFrame:
    """The first n rows of each group in an order."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def worker_split(df: DataFrame, workers: int, key: str = "key") -> DataFrame:
    """df with worker_id: contiguous ranges of the key order, the first n % workers of them one longer."""
    n = df.count()
    size, longer = divmod(n, workers)
    placed = global_row_number(df, key, name="_i")
    edge = longer * (size + 1)
    worker = F.when(F.col("_i") < edge, F.floor(F.col("_i") / (size + 1))).otherwise(longer + F.floor((F.col("_i") - edge) / max(size, 1)))
    return placed.withColumn("worker_id", worker.cast("long")).drop("_i")
