"""The test tables in the roles of a sample stream, a catalog and a run log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accrete.operators.ordering import global_row_number

#: The stream in SQL; idx is its place by (timestamp, key), from 0.
STREAM = """
WITH s0 AS (
  SELECT event_id AS key, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp,
         CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS BIGINT) AS label, value, user_id, props
  FROM events),
s AS (SELECT *, row_number() OVER (ORDER BY timestamp, key) - 1 AS idx FROM s0)
"""
#: Samples of a trigger.
EVERY = 500
STATE = STREAM + f", st AS (SELECT *, idx // {EVERY} AS trigger_id FROM s)\n"


def load(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def epoch(column: str):
    return F.unix_seconds(F.col(column).cast("timestamp"))


def events(spark, sf_dir: str) -> DataFrame:
    """key, timestamp, label (the place of the event's type among all types), value, user_id and props."""
    e = load(spark, sf_dir, "events")
    types = e.select("event_type").distinct()
    ranked = types.join(types.withColumnRenamed("event_type", "_t"), F.col("_t") < F.col("event_type"), "left").groupBy("event_type").agg(F.count("_t").alias("label"))
    got = e.join(F.broadcast(ranked), "event_type")  # one row a type of event
    return got.select(F.col("event_id").alias("key"), epoch("ts").alias("timestamp"), "label", "value", "user_id", "props")


def stream(spark, sf_dir: str) -> DataFrame:
    """events with idx, their place by (timestamp, key)."""
    return global_row_number(events(spark, sf_dir), "timestamp", "key")


def state(spark, sf_dir: str) -> DataFrame:
    """The stream with trigger_id, EVERY samples each."""
    return stream(spark, sf_dir).withColumn("trigger_id", F.floor(F.col("idx") / EVERY))


def files(spark, sf_dir: str) -> DataFrame:
    o, li = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    counts = li.groupBy(F.col("l_orderkey").alias("file_id")).agg(F.count("*").alias("number_of_samples"))
    return o.select(F.col("o_orderkey").alias("file_id"), epoch("o_orderdate").alias("updated_at")).join(counts, "file_id")


def samples(spark, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").cast("long").alias("sample_index"), F.ascii("l_returnflag").cast("long").alias("label"))
