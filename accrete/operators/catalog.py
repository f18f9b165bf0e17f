"""The sample catalog: scans, point reads, counts, ingest and deletes over files and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def time_predicate(ts: Column, start: int | None, end: int | None, closed: bool) -> Column:
    """start <= ts and ts <= end (closed) or ts < end; None and a start of -1 are no bound."""
    got = F.lit(True)
    if start is not None and start != -1:
        got = got & (ts >= start)
    if end is not None:
        got = got & ((ts <= end) if closed else (ts < end))
    return got


def scan_since(samples: DataFrame, files: DataFrame, since: int) -> DataFrame:
    """key, label and timestamp of samples of files updated at `since` or later; filtered before the join."""
    recent = files.where(time_predicate(F.col("updated_at"), since, None, True)).select("file_id", F.col("updated_at").alias("timestamp"))
    return samples.join(recent, "file_id").select("key", "label", "timestamp")


def scan_interval(samples: DataFrame, files: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """As scan_since, with both bounds inclusive."""
    recent = files.where(time_predicate(F.col("updated_at"), start, end, True)).select("file_id", F.col("updated_at").alias("timestamp"))
    return samples.join(recent, "file_id").select("key", "label", "timestamp")


def dataset_size(files: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """The number of samples of files in [start, end)."""
    return files.where(time_predicate(F.col("updated_at"), start, end, False)).agg(F.coalesce(F.sum("number_of_samples"), F.lit(0)).alias("n"))


def get(samples: DataFrame, keys: DataFrame) -> DataFrame:
    """The samples of a key list; repeated keys are an error."""
    if keys.groupBy("key").count().where("count > 1").limit(1).count():
        raise ValueError("repeated keys")
    return samples.join(keys, "key", "left_semi")


def new_files(listed: DataFrame, known: DataFrame, since: int | None) -> DataFrame:
    """Listed files that aren't known, updated at `since` or later."""
    return listed.join(known, "path", "left_anti").where(time_predicate(F.col("updated_at"), since, None, True))


def delete_samples(samples: DataFrame, keys: DataFrame) -> DataFrame:
    return samples.join(keys, "key", "left_anti")


def recount(samples: DataFrame) -> DataFrame:
    """file_id and number_of_samples of the files that still have samples."""
    return samples.groupBy("file_id").agg(F.count("*").alias("number_of_samples"))


def upsert(catalog: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """catalog with rows added or replaced by key."""
    return catalog.join(rows, key, "left_anti").unionByName(rows)
