"""Count and time triggers over a stream, and admission of new files, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def amount_trigger(stream: DataFrame, n: int, by: str) -> DataFrame:
    """by, key, timestamp and trigger_id: each n-th sample of a group fires; the rest is carried over between batches.

    Only samples of windows that have fired are emitted, in their (timestamp, key) order within a micro-batch; the state
    of a group holds the samples of its open window, n - 1 at most.
    """

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fired, keys, times = state.get if state.exists else (0, [], [])
        new = pd.concat(list(batches)).sort_values(["timestamp", "key"])
        keys, times = list(keys) + new["key"].tolist(), list(times) + new["timestamp"].tolist()
        full = len(keys) // n * n
        state.update((fired + full // n, keys[full:], times[full:]))
        yield pd.DataFrame({by: group[0], "key": keys[:full], "timestamp": times[:full], "trigger_id": [fired + i // n for i in range(full)]})

    kind = dict(stream.dtypes)[by]
    return stream.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, key long, timestamp long, trigger_id long", "fired long, keys array<long>, times array<long>", "append", GroupStateTimeout.NoTimeout)


def time_trigger(stream: DataFrame, every: str, late: str) -> DataFrame:
    """Counts of tumbling windows of event time `at`, emitted once no later sample can change them."""
    w = F.window("at", every)
    return stream.withWatermark("at", late).groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.unix_seconds("w.start").alias("start"), F.unix_seconds("w.end").alias("end"), "n")


def first_seen(stream: DataFrame, key: str, late: str) -> DataFrame:
    """Each key once, as long as its repeats come within the watermark."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark([key])


def sessions(stream: DataFrame, by: str, gap: str, late: str) -> DataFrame:
    """Sessions of a group: samples no further apart than gap."""
    return stream.withWatermark("at", late).groupBy(by, F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n")).select(by, F.unix_seconds("w.start").alias("start"), F.unix_seconds("w.end").alias("end"), "n")


def ingest(spark, source: str, schema: str, target: str, checkpoint: str):
    """A query that appends the rows of files not met before, and ends when there are no more; the checkpoint knows the files."""
    return spark.readStream.schema(schema).parquet(source).withColumn("updated_at", F.unix_seconds("_metadata.file_modification_time")).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
