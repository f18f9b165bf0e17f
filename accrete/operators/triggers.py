"""When to act: count, time, drift, performance and cost triggers over an indexed stream."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from accrete.functions.arrays import quantile


def amount_trigger(stream: DataFrame, n: int) -> DataFrame:
    """stream (with idx) with trigger_id; the last incomplete window hasn't fired and has null."""
    total = stream.count()
    return stream.withColumn("trigger_id", F.when(F.col("idx") < total // n * n, F.floor(F.col("idx") / n)))


def time_trigger(stream: DataFrame, every: int, start: int | None = None) -> DataFrame:
    """stream with trigger_id by data time; a boundary sample belongs to the next window, the last window hasn't fired."""
    first, last = stream.agg(F.min("timestamp"), F.max("timestamp")).first()
    if first is None:
        return stream.withColumn("trigger_id", F.lit(None).cast("long"))
    start = first if start is None else start
    return stream.withColumn("trigger_id", F.when(F.floor((F.col("timestamp") - start) / every) < (last - start) // every, F.floor((F.col("timestamp") - start) / every)))


def time_trigger_counts(stream: DataFrame, every: int) -> DataFrame:
    """trigger_id and n of every fired window, empty windows included."""
    got = time_trigger(stream, every).where("trigger_id is not null").groupBy("trigger_id").agg(F.count("*").alias("n"))
    first, last = stream.agg(F.min("timestamp"), F.max("timestamp")).first()
    spine = stream.sparkSession.range(0 if first is None else (last - first) // every).withColumnRenamed("id", "trigger_id")
    return spine.join(got, "trigger_id", "left").select("trigger_id", F.coalesce("n", F.lit(0)).alias("n"))


def chunks(stream: DataFrame, k: int) -> DataFrame:
    """stream with chunk: fixed counts by idx, the last incomplete one left out."""
    return amount_trigger(stream, k).where("trigger_id is not null").withColumnRenamed("trigger_id", "chunk")


def dynamic_quantile(scores: DataFrame, k: int, q: float, higher: bool = True) -> DataFrame:
    """scores (chunk, score) with fired: beyond the interpolated quantile of the k scores before; the first one fires."""
    past = Window.partitionBy(F.lit(0)).orderBy("chunk").rowsBetween(-k, -1)  # one row a chunk
    seen = scores.withColumn("_past", F.collect_list("score").over(past)).withColumn("_line", quantile(F.col("_past"), q if higher else 1 - q))
    beyond = F.col("score") > F.col("_line") if higher else F.col("score") < F.col("_line")
    return seen.withColumn("fired", F.when(F.size("_past") == 0, True).otherwise(beyond)).drop("_past", "_line")


def rolling_average(scores: DataFrame, k: int, deviation: float, absolute: bool = False, higher: bool = True) -> DataFrame:
    """scores with fired: at least `deviation` above (below) the mean of the k scores before; the first one fires."""
    past = Window.partitionBy(F.lit(0)).orderBy("chunk").rowsBetween(-k, -1)
    mean = F.avg("score").over(past)
    apart = (F.col("score") - mean) * (1 if higher else -1)
    beyond = apart >= deviation if absolute else apart >= deviation * mean
    return scores.withColumn("fired", F.when(F.count("score").over(past) == 0, True).otherwise(beyond))


def static_threshold(scores: DataFrame, threshold: float, higher: bool = True) -> DataFrame:
    return scores.withColumn("fired", F.col("score") >= threshold if higher else F.col("score") <= threshold)


def majority(decisions: Column) -> Column:
    """More than half of a map of decisions are true."""
    return F.size(F.map_filter(decisions, lambda _, v: v)) * 2 > F.size(decisions)


def at_least(decisions: Column, n: int) -> Column:
    return F.size(F.map_filter(decisions, lambda _, v: v)) >= n


def avoidable_misclassifications(chunks: Iterable[tuple[int, int, int]], expected: float, limit: float, allow_reduction: bool = False) -> list[tuple[int, float, float, bool]]:
    """Folds (chunk, wrong, n): new avoidable misclassifications, their sum since the last firing, and whether it fires."""
    total, out = 0.0, []
    for chunk, wrong, n in chunks:
        new = wrong - (1 - expected) * n
        new = new if allow_reduction else max(0.0, new)
        total += new
        fired = total >= limit
        out.append((chunk, new, total, fired))
        total = 0.0 if fired else total
    return out


def incorporation_latency(chunked: DataFrame) -> DataFrame:
    """chunk, n, end and regret: the area under the curve of samples not yet trained on, up to each chunk's end.

    A sample counts from its timestamp on; chunks without a trigger in between, so regret only grows.
    """
    by = chunked.groupBy("chunk").agg(F.count("*").alias("n"), F.max("timestamp").alias("end"), F.sum("timestamp").alias("_sum"))
    w = Window.partitionBy(F.lit(0)).orderBy("chunk")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    carried = F.coalesce(F.sum("n").over(before), F.lit(0)) * (F.col("end") - F.coalesce(F.lag("end").over(w), F.col("end")))
    own = F.col("n") * F.col("end") - F.col("_sum")
    by = by.withColumn("_new", own + carried)
    return by.select("chunk", "n", "end", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("regret"))


def ridge_forecast(series: DataFrame, alpha: float = 1.0, k: int = 10) -> DataFrame:
    """series (chunk, score) with forecast: a ridge line through the k scores before, carried one step on."""
    past = Window.partitionBy(F.lit(0)).orderBy("chunk").rowsBetween(-k, -1)
    n, x, y = F.count("score").over(past), F.avg("chunk").over(past), F.avg("score").over(past)
    sxy = F.sum(F.col("chunk") * F.col("score")).over(past) - n * x * y
    sxx = F.sum(F.col("chunk") * F.col("chunk")).over(past) - n * x * x
    return series.withColumn("forecast", F.when(n > 0, y + sxy / (sxx + alpha) * (F.col("chunk") - x)))


def data_density(chunked: DataFrame) -> DataFrame:
    """chunk, n, end and per_second: samples a second since the previous chunk's end."""
    by = chunked.groupBy("chunk").agg(F.count("*").alias("n"), F.max("timestamp").alias("end"), F.min("timestamp").alias("_start"))
    since = F.coalesce(F.lag("end").over(Window.partitionBy(F.lit(0)).orderBy("chunk")), F.col("_start"))
    return by.select("chunk", "n", "end", (F.col("n") / F.greatest(F.col("end") - since, F.lit(1))).alias("per_second"))


def cost_trigger(chunks: Iterable[tuple[int, float]], seconds: Callable[[int], float], factor: float) -> list[tuple[int, float, bool]]:
    """Folds (chunk, regret): fires where regret since the last firing, times factor, reaches the predicted training time."""
    base, out = 0.0, []
    for chunk, regret in chunks:
        fired = (regret - base) * factor >= seconds(chunk)
        out.append((chunk, regret - base, fired))
        base = regret if fired else base
    return out


def ensemble(fires: dict[str, list[int]], needed: Callable[[dict[str, bool]], bool]) -> list[int]:
    """Merges subtriggers' firing places in order; decisions stay until the ensemble fires."""
    latched, out = dict.fromkeys(fires, False), []
    for at in sorted({i for places in fires.values() for i in places}):
        latched = {name: latched[name] or at in fires[name] for name in fires}
        if needed(latched):
            out.append(at)
            latched = dict.fromkeys(fires, False)
    return out


def mean_distance(current: DataFrame, reference: DataFrame, column: str) -> DataFrame:
    """distance: euclidean, between the mean vectors of two windows."""
    mean = lambda df, name: df.select(F.posexplode(column).alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias(name))
    both = mean(current, "a").join(mean(reference, "b"), "dim")
    return both.agg(F.sqrt(F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b")))).alias("distance"))


def hellinger(current: DataFrame, reference: DataFrame, column: str, bins: int = 20, low: float = -5.0, high: float = 5.0) -> DataFrame:
    """distance: the mean over dimensions of the Hellinger distance of histograms with shared bins."""

    def histogram(df, name):
        at = df.select(F.posexplode(column).alias("dim", "x")).withColumn("bin", F.least(F.greatest(F.floor((F.col("x").cast("double") - low) / ((high - low) / bins)), F.lit(0)), F.lit(bins - 1)))
        counts = at.groupBy("dim", "bin").agg(F.count("*").alias("n"))
        return counts.select("dim", "bin", (F.col("n") / F.sum("n").over(Window.partitionBy("dim"))).alias(name))

    both = histogram(current, "p").join(histogram(reference, "q"), ["dim", "bin"])
    per = both.groupBy("dim").agg(F.sqrt(F.greatest(F.lit(0.0), 1 - F.sum(F.sqrt(F.col("p") * F.col("q"))))).alias("h"))
    return per.agg(F.avg("h").alias("distance"))


def kolmogorov_smirnov(current: DataFrame, reference: DataFrame, column: str) -> DataFrame:
    """dim and distance: the greatest difference of the two empirical distributions in each dimension."""
    side = lambda df, a, b: df.select(F.posexplode(column).alias("dim", "x")).groupBy("dim", "x").agg(F.count("*").alias("n")).select("dim", "x", (F.col("n") * a).alias("a"), (F.col("n") * b).alias("b"))
    points = side(current, 1, 0).unionAll(side(reference, 0, 1)).groupBy("dim", "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    upto, whole = Window.partitionBy("dim").orderBy("x"), Window.partitionBy("dim")
    gap = F.abs(F.sum("a").over(upto) / F.sum("a").over(whole) - F.sum("b").over(upto) / F.sum("b").over(whole))
    return points.select("dim", gap.alias("g")).groupBy("dim").agg(F.max("g").alias("distance"))


def cramer_von_mises(current: DataFrame, reference: DataFrame, column: str) -> DataFrame:
    """dim and distance: n m / (n + m)^2 times the sum, over all points, of the squared difference of the two distributions."""
    side = lambda df, a, b: df.select(F.posexplode(column).alias("dim", "x")).groupBy("dim", "x").agg(F.count("*").alias("n")).select("dim", "x", (F.col("n") * a).alias("a"), (F.col("n") * b).alias("b"))
    points = side(current, 1, 0).unionAll(side(reference, 0, 1)).groupBy("dim", "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    upto, whole = Window.partitionBy("dim").orderBy("x"), Window.partitionBy("dim")
    n, m = F.sum("a").over(whole), F.sum("b").over(whole)
    gap = F.sum("a").over(upto) / n - F.sum("b").over(upto) / m
    points = points.select("dim", ((F.col("a") + F.col("b")) * gap * gap).alias("g"), (n * m / ((n + m) * (n + m))).alias("f"))
    return points.groupBy("dim").agg((F.sum("g") * F.first("f")).alias("distance"))


def drifted_share(per_dim: DataFrame, threshold: float) -> DataFrame:
    """distance: the share of dimensions whose own distance exceeds the threshold."""
    return per_dim.agg(F.avg((F.col("distance") > threshold).cast("double")).alias("distance"))


def mmd(current: DataFrame, reference: DataFrame, column: str, bandwidth: float, features: int = 512, seed: int = 7) -> DataFrame:
    """distance: squared maximum mean discrepancy under a Gaussian kernel, by random Fourier features.

    The mean kernel over all pairs would need a product of the windows; the features need one pass: each partition gives
    the sum of its vectors' features, and the means of both windows are compared.
    """

    def sums(batches):
        total, n = None, 0
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["v"].to_list()).astype("float64")
            r = np.random.default_rng(seed)
            w, b = r.normal(0, 1 / bandwidth, (x.shape[1], features)), r.uniform(0, 2 * np.pi, features)
            z = np.sqrt(2 / features) * np.cos(x @ w + b).sum(0)
            total, n = z if total is None else total + z, n + len(x)
        if n:
            yield pd.DataFrame({"i": np.arange(features), "s": total, "n": n})

    mean = lambda df, name: df.select(F.col(column).alias("v")).mapInPandas(sums, "i long, s double, n long").groupBy("i").agg((F.sum("s") / F.sum("n")).alias(name))
    both = mean(current, "a").join(mean(reference, "b"), "i")
    return both.agg(F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("distance"))
