"""Evaluation intervals, requests (models by interval) and metrics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

#: Seconds of a unit; a year has 365 days.
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 604_800, "y": 31_536_000}


def seconds(duration: str) -> int:
    """'2d' and the like."""
    m = re.fullmatch(r"(\d+)([smhdwy])", duration)
    if not m:
        raise ValueError(f"not a duration: {duration}")
    return int(m[1]) * UNITS[m[2]]


def seconds_column(duration: Column) -> Column:
    """The same for a column; null where it isn't a duration."""
    unit = F.substring(duration, -1, 1)
    factor = F.create_map(*[x for u, n in UNITS.items() for x in (F.lit(u), F.lit(n))])
    return F.when(duration.rlike(r"^\d+[smhdwy]$"), F.expr("1") * F.regexp_extract(duration, r"^(\d+)", 1).cast("long") * F.try_element_at(factor, unit))


def slices(spark, start: int, end: int, every: int) -> DataFrame:
    """start, end and active_before of consecutive intervals; the last may be short."""
    s = spark.range(start, end, every).withColumnRenamed("id", "start")
    return s.select("start", F.least(F.col("start") + every, F.lit(end)).alias("end"), F.col("start").alias("active_before"))


def interval_of(grammar: str) -> tuple[float, bool, float, bool]:
    """'[(-2d; +0y]' and the like: left, whether it is included, right, whether it is included; inf is allowed."""
    m = re.fullmatch(r"\s*([\[(])\s*([+-]?(?:inf|\d+[smhdwy]|0))\s*[;,]\s*([+-]?(?:inf|\d+[smhdwy]|0))\s*([\])])\s*", grammar.replace("[(", "(").replace(")]", ")"))
    if not m:
        raise ValueError(f"not an interval: {grammar}")
    value = lambda x: float(x.replace("+inf", "inf")) if "inf" in x else (-1 if x[0] == "-" else 1) * (0 if x.strip("+-") == "0" else seconds(x.strip("+-")))
    return value(m[2]), m[1] == "[", value(m[3]), m[4] == "]"


def periodic(spark, start: int, end: int, every: int, grammar: str) -> DataFrame:
    """Intervals around centres every `every` from start to end, bounded as the grammar says; closed bounds in seconds."""
    left, with_left, right, with_right = interval_of(grammar)
    c = spark.range(start, end + 1, every).withColumnRenamed("id", "center")
    low = F.greatest(F.lit(0), F.col("center") + int(left) + (0 if with_left else 1)) if left != float("-inf") else F.lit(0)
    high = F.greatest(low, F.col("center") + int(right) - (0 if with_right else 1)) if right != float("inf") else F.lit(None).cast("long")
    return c.select("center", low.cast("long").alias("start"), high.cast("long").alias("end"))


def offsets(training: DataFrame, offsets: list[str]) -> DataFrame:
    """For each training interval (start, end) and offset ('-inf', 'inf', '0', '-1d', ...) the half-open interval there."""
    out = None
    for o in offsets:
        if o == "-inf":
            got = training.select(F.lit(0).cast("long").alias("start"), F.col("start").alias("end"), F.col("start").alias("_s"), F.col("end").alias("_e"))
        elif o == "inf":
            got = training.select((F.col("end") + 1).alias("start"), F.lit(None).cast("long").alias("end"), F.col("start").alias("_s"), F.col("end").alias("_e"))
        else:
            shift = 0 if o == "0" else (-1 if o[0] == "-" else 1) * seconds(o.lstrip("+-"))
            low = F.col("start") if shift == 0 else F.col("end") + 1 if shift > 0 else F.greatest(F.lit(0), F.col("start") + shift)
            high = F.col("end") + 1 if shift == 0 else F.col("end") + 1 + shift if shift > 0 else F.col("start")
            got = training.select(low.alias("start"), high.alias("end"), F.col("start").alias("_s"), F.col("end").alias("_e"))
        got = got.withColumn("offset", F.lit(o))
        out = got if out is None else out.unionByName(got)
    return out.select("offset", F.col("_s").alias("train_start"), F.col("_e").alias("train_end"), "start", "end")


def between_triggers(training: DataFrame, dataset_end: int) -> DataFrame:
    """The training intervals, and what comes after the last of them."""
    after = training.agg((F.max("end") + 1).alias("start")).select("start", F.lit(dataset_end).cast("long").alias("end"))
    return training.select("start", "end").unionAll(after)


def requests(intervals: DataFrame, models: DataFrame) -> DataFrame:
    """Every model on every interval, with active and trained.

    intervals: start, end, active_before; models: id_model, last_timestamp. The active model is the newest that was
    trained up to before active_before; the trained one comes right after it (the first if none is active, the last
    follows itself). Intervals and models are counted in hundreds: both are lists of a run's configuration and outcomes.
    """
    ordered = models.select("id_model", "last_timestamp", F.lead("id_model", 1).over(Window.partitionBy(F.lit(0)).orderBy("id_model")).alias("_next"), F.min("id_model").over(Window.partitionBy(F.lit(0))).alias("_first"))
    pairs = intervals.join(ordered)
    w = Window.partitionBy("start", "end", "active_before")
    seen = F.when(F.col("last_timestamp") < F.col("active_before"), F.col("id_model"))
    pairs = pairs.withColumn("_active", F.max(seen).over(w))
    follows = F.max(F.when(F.col("id_model") == F.col("_active"), F.coalesce("_next", "id_model"))).over(w)
    pairs = pairs.withColumn("_trained", F.coalesce(follows, F.col("_first")))
    return pairs.select("start", "end", "active_before", "id_model", (F.coalesce(F.col("id_model") == F.col("_active"), F.lit(False))).alias("active"), (F.col("id_model") == F.col("_trained")).alias("trained"))


def accuracy(rows: DataFrame, by: list[str], truth: str = "y", guess: str = "p") -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("accuracy"))


def top_n_accuracy(rows: DataFrame, scores: str, truth: str, n: int) -> DataFrame:
    """How often the true class is among the n highest scores (ties: lower class first)."""
    order = F.array_sort(F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i"))))
    best = F.transform(F.slice(order, 1, n), lambda x: x["i"].cast("long"))
    return rows.agg(F.count("*").alias("n"), F.avg(F.array_contains(best, F.col(truth).cast("long")).cast("double")).alias("accuracy"))


def f1(rows: DataFrame, classes: int, truth: str = "y", guess: str = "p") -> DataFrame:
    """f1_micro, f1_macro and f1_weighted; classes without rows count as 0 in macro."""
    spark = rows.sparkSession
    true = rows.groupBy(F.col(truth).alias("c")).agg(F.count("*").alias("t"), F.sum((F.col(truth) == F.col(guess)).cast("long")).alias("tp"))
    told = rows.groupBy(F.col(guess).alias("c")).agg(F.count("*").alias("g"))
    per = spark.range(classes).withColumnRenamed("id", "c").join(true, "c", "left").join(told, "c", "left").fillna(0, ["t", "tp", "g"])
    per = per.withColumn("f1", F.when(F.col("t") + F.col("g") > 0, 2.0 * F.col("tp") / (F.col("t") + F.col("g"))).otherwise(0.0))
    return per.agg(
        (F.sum("tp") / F.sum("g")).alias("f1_micro"),
        (F.sum("f1") / classes).alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("t")) / F.sum("t")).alias("f1_weighted"),
    )


def roc_auc(rows: DataFrame, by: list[str], truth: str = "y", score: str = "score") -> DataFrame:
    """Area under the curve over distinct scores; 0 where one class is missing.

    Scores are counted first; the windows run over distinct scores of a group.
    """
    at = rows.groupBy(*by, score).agg(F.sum(truth).alias("pos"), F.sum(1 - F.col(truth)).alias("neg"))
    part = Window.partitionBy(*by)
    down = part.orderBy(F.desc(score))
    at = at.withColumn("tp", F.sum("pos").over(down)).withColumn("_p", F.sum("pos").over(part)).withColumn("_n", F.sum("neg").over(part))
    area = F.col("neg") * (F.col("tp") - F.col("pos") / 2.0) / (F.col("_p") * F.col("_n"))
    return at.withColumn("_a", F.when((F.col("_p") > 0) & (F.col("_n") > 0), area).otherwise(0.0)).groupBy(*by).agg(F.sum("_a").alias("auc"))


#: Metrics of rows with y and p, by lower-case name.
METRICS = {
    "accuracy": lambda: F.avg((F.col("y") == F.col("p")).cast("double")),
    "correct": lambda: F.sum((F.col("y") == F.col("p")).cast("long")),
    "seen": lambda: F.count("*"),
    "mean_error": lambda: F.avg(F.abs(F.col("y") - F.col("p")).cast("double")),
}


def evaluate(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """All metrics of each group in one aggregation; names are found in any case, each once."""
    names = [m.lower() for m in metrics]
    if len(set(names)) < len(names):
        raise ValueError("a metric is named twice")
    if missing := [m for m in names if m not in METRICS]:
        raise ValueError(f"unknown metrics: {', '.join(missing)}")
    return rows.groupBy(*by).agg(*[METRICS[m]().alias(m) for m in names])


def static_intervals(spark, bounds: list[tuple[int, int]]) -> DataFrame:
    return spark.createDataFrame(bounds, "start long, end long").withColumn("active_before", F.col("start"))


def requests_after_training(intervals: DataFrame, model: int, trained_until: int) -> DataFrame:
    """What a model is evaluated on right after its training: every interval, with active where it's trained before it."""
    return intervals.select("start", "end", F.lit(model).cast("long").alias("id_model"), (F.lit(trained_until) < F.col("active_before")).alias("active"))


def request_groups(requests: DataFrame, by: list[str]) -> DataFrame:
    """One row a dataset and model with its intervals in order, as one scan serves them all."""
    return requests.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("intervals"))


def results_frame(results: DataFrame) -> DataFrame:
    """A row a model, interval and metric of nested results (id_model, intervals of start, end and metrics by name)."""
    each = results.select("id_model", F.explode("intervals").alias("i")).select("id_model", "i.start", "i.end", F.explode("i.metrics").alias("metric", "value"))
    return each.withColumns({"length": F.col("end") - F.col("start"), "center": (F.col("start") + F.col("end")) / 2})
