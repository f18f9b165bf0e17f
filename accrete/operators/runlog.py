"""Run-log analytics: stage durations, costs, time-weighted metrics, usage intervals, class statistics, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F


def stage_durations(log: DataFrame, by: str = "id", duration: str = "duration") -> DataFrame:
    """max, min, mean, median, std, sum and count of each stage; -1 where there is no value."""
    d = F.col(duration)
    got = log.groupBy(by).agg(F.max(d).alias("max"), F.min(d).alias("min"), F.avg(d).alias("mean"), F.median(d).alias("median"), F.stddev_samp(d).alias("std"), F.sum(d).alias("sum"), F.count(d).alias("count"))
    return got.fillna(-1)


def leaf_stages(log: DataFrame, stage: str = "id", parent: str = "parent_id") -> DataFrame:
    return log.join(log.where(F.col(parent).isNotNull()).select(F.col(parent).alias(stage)).distinct(), stage, "left_anti")


def cumulative(costs: DataFrame, group: str, time: str, cost: str) -> DataFrame:
    """Running cost of each group."""
    w = Window.partitionBy(group).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return costs.withColumn("cumulative", F.sum(cost).over(w))


def densified(costs: DataFrame, group: str, time: str, cost: str) -> DataFrame:
    """A row for every group at every time, with cost 0 where there was none, and the running cost.

    Times and groups are those of a run's stages; their product is what is asked for.
    """
    spine = costs.select(group).distinct().join(costs.select(time).distinct())
    return cumulative(spine.join(costs, [group, time], "left").fillna(0, [cost]), group, time, cost)


def time_weighted(rows: DataFrame, by: list[str], value: str, start: str, end: str) -> DataFrame:
    w = F.col(end) - F.col(start)
    return rows.groupBy(*by).agg((F.sum(F.col(value) * w) / F.sum(w)).alias("value"))


def seed_average(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and number of runs a group; groups of different sizes are an error."""
    got = rows.groupBy(*by).agg(F.avg(value).alias("avg"), F.count("*").alias("n"))
    if got.select("n").distinct().count() > 1:
        raise ValueError("groups differ in size")
    return got


def usage_intervals(trainings: DataFrame, last_sample: int) -> DataFrame:
    """real_end (until the next training's first sample), and when each model is in use."""
    w = Window.partitionBy(F.lit(0)).orderBy("trigger_id")  # one row a trigger
    got = trainings.withColumn("real_end", F.coalesce(F.lead("first_timestamp").over(w), F.col("last_timestamp") + 1) - 1)
    return got.withColumn("usage_start", F.col("real_end") + 1).withColumn("usage_end", F.coalesce(F.lead("real_end").over(w), F.lit(last_sample)))


def linearized(rows: DataFrame, group: str, column: str) -> DataFrame:
    """rows with new_id: 1, 2, .. in each group by the column's order."""
    return rows.withColumn("new_id", F.dense_rank().over(Window.partitionBy(group).orderBy(column)))


def frequent(rows: DataFrame, column: str, least: int) -> DataFrame:
    """Rows whose value occurs at least so often."""
    return rows.join(rows.groupBy(column).count().where(F.col("count") >= least).select(column), column, "left_semi")


def class_stats(rows: DataFrame, year: Column, label: Column) -> DataFrame:
    """Counts by year, by class, by both and in all, by grouping sets."""
    rows = rows.select(year.alias("year"), label.alias("class"))
    got = rows.cube("year", "class").agg(F.grouping_id().alias("gid"), F.count("*").alias("n"))
    return got


def top_with_other(rows: DataFrame, label: str, k: int) -> DataFrame:
    """Counts of the k most frequent classes and of all others together."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    best = counts.orderBy(F.desc("n"), label).limit(k).select(label, F.lit(True).alias("_top"))
    named = counts.join(best, label, "left").withColumn("class", F.when(F.col("_top"), F.col(label).cast("string")).otherwise(F.lit("Other")))
    return named.groupBy("class").agg(F.sum("n").alias("n"))


def centeredness(rows: DataFrame, year: Column, label: Column) -> DataFrame:
    """Share of each class's rows by distance in years from its most frequent year (ties: earliest)."""
    counts = rows.groupBy(label.alias("class"), year.alias("year")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("class")
    mode = F.first("year").over(w.orderBy(F.desc("n"), "year"))
    return counts.select("class", (F.col("year") - mode).cast("long").alias("off"), "n", (F.col("n") / F.sum("n").over(w)).alias("share"))


def metric_pivot(rows: DataFrame, index: str, column: str, values: list, value: str) -> DataFrame:
    return rows.groupBy(index).pivot(column, values).agg(F.first(value))


def rle(rows: DataFrame, order: str, value: str) -> DataFrame:
    """Runs of equal values in an order: run, value and n. rows must have `order` as places 0, 1, ...

    A run starts where the value at the place before differs, found by a join on the place; a row's run is then the last
    start before it. Only starts are numbered in one window.
    """
    before = rows.select((F.col(order) + 1).alias(order), F.col(value).alias("_before"))
    starts = rows.join(before, order, "left").where(F.col("_before").isNull() | (F.col("_before") != F.col(value))).select(order, value)
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    last = rows.agg(F.max(order)).first()[0]
    ends = F.coalesce(F.lead(order).over(w), F.lit(-1 if last is None else last + 1))
    return starts.select((F.row_number().over(w) - 1).cast("long").alias("run"), F.col(value), (ends - F.col(order)).alias("n"))


def one_to_one(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Inner join that fails where a key of either side occurs twice or lacks a partner."""
    n, m = left.groupBy(on).count(), right.groupBy(on).count()
    bad = n.join(m.withColumnRenamed("count", "_m"), on, "full").where("count is null or _m is null or count <> 1 or _m <> 1")
    if not bad.isEmpty():
        raise ValueError(f"{on} isn't one to one")
    return left.join(right, on)


def with_stage_mean(log: DataFrame, stage: str, value: str) -> DataFrame:
    """log with the mean of its stage."""
    return log.join(log.groupBy(stage).agg(F.avg(value).alias("mean")), stage)


def cost_by_stage(log: DataFrame, stage: str, value: str) -> DataFrame:
    """Cost of each stage with its place, dearest first."""
    got = log.groupBy(stage).agg(F.sum(value).alias("cost"))
    return got.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("cost"), stage)))  # one row a stage


def with_parents(stages: DataFrame, by: str, parent: str, value: str) -> DataFrame:
    """Sum of each stage, and its parent's beside it (null at the top)."""
    got = stages.groupBy(by, parent).agg(F.sum(value).alias("sum"))
    above = got.groupBy(by).agg(F.sum("sum").alias("parent_sum")).withColumnRenamed(by, parent)
    return got.join(above, parent, "left")


def invalid_runs(runs: DataFrame, stages: DataFrame, run: str, least: int) -> DataFrame:
    """Runs with fewer than `least` stages, and how many they have."""
    counts = stages.groupBy(run).agg(F.count("*").alias("n"))
    return runs.select(run).join(counts, run, "left").fillna(0, ["n"]).where(F.col("n") < least)
