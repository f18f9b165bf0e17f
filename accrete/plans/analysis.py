"""Run-log queries: each week of events is a stage log, orders and line items give classes over years."""

from __future__ import annotations

from pyspark.sql import functions as F

from accrete.operators import runlog
from accrete.plans.registry import query
from accrete.plans.tables import STREAM, events, load

LOG = STREAM + ", log AS (SELECT (timestamp - 1704067200) // 86400 AS day, label, value FROM s), cost AS (SELECT label, day, round(sum(value), 3) AS cost FROM log WHERE value > 40 GROUP BY 1, 2)\n"


def log(spark, sf_dir):
    return events(spark, sf_dir).select(F.floor((F.col("timestamp") - 1704067200) / 86400).alias("day"), "label", "value")


def costs(spark, sf_dir):
    return log(spark, sf_dir).where("value > 40").groupBy("label", "day").agg(F.round(F.sum("value"), 3).alias("cost"))


@query("a7_stage_durations", LOG + "SELECT label, round(max(value), 6) AS max, round(min(value), 6) AS min, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(coalesce(stddev_samp(value), -1), 6) AS std, round(sum(value), 3) AS sum, count(value) AS count FROM log GROUP BY 1")
def durations(spark, sf_dir):
    got = runlog.stage_durations(log(spark, sf_dir), "label", "value")
    return got.select("label", *[F.round(c, 3 if c == "sum" else 6).alias(c) for c in ("max", "min", "mean", "median", "std", "sum")], "count")


@query("a9_time_weighted", STREAM + "SELECT label, round(sum(value * (key % 7 + 1)) / sum(key % 7 + 1), 6) AS value FROM s GROUP BY 1")
def time_weighted(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("end", F.col("timestamp") + F.col("key") % 7 + 1)
    return runlog.time_weighted(e, ["label"], "value", "timestamp", "end").withColumn("value", F.round("value", 6))


@query("a10_seed_average", "SELECT c_nationkey, seed, round(avg(c_acctbal), 4) AS avg FROM (SELECT *, c_custkey % 2 AS seed FROM customer) GROUP BY 1, 2")
def seed_average(spark, sf_dir):
    c = load(spark, sf_dir, "customer").withColumn("seed", F.col("c_custkey") % 2)
    return c.groupBy("c_nationkey", "seed").agg(F.round(F.avg("c_acctbal"), 4).alias("avg"))


@query("a11_cumulative_cost", LOG + "SELECT label, day, round(sum(cost) OVER (PARTITION BY label ORDER BY day), 2) AS cumulative FROM cost")
def cumulative(spark, sf_dir):
    return runlog.cumulative(costs(spark, sf_dir), "label", "day", "cost").select("label", "day", F.round("cumulative", 2).alias("cumulative"))


@query("j12_densified_cost", LOG + "SELECT l.label, d.day, round(sum(coalesce(cost, 0)) OVER (PARTITION BY l.label ORDER BY d.day), 2) AS cumulative FROM (SELECT DISTINCT label FROM cost) l CROSS JOIN (SELECT DISTINCT day FROM cost) d LEFT JOIN cost c ON c.label = l.label AND c.day = d.day")
def densified(spark, sf_dir):
    return runlog.densified(costs(spark, sf_dir), "label", "day", "cost").select("label", "day", F.round("cumulative", 2).alias("cumulative"))


@query("w3_usage_intervals", STREAM + ", t AS (SELECT idx // 500 AS trigger_id, min(timestamp) AS f, max(timestamp) AS l FROM s GROUP BY 1), r AS (SELECT *, coalesce(lead(f) OVER (ORDER BY trigger_id), l + 1) - 1 AS real_end FROM t) SELECT trigger_id, real_end, real_end + 1 AS usage_start, coalesce(lead(real_end) OVER (ORDER BY trigger_id), 1800000000) AS usage_end FROM r")
def usage(spark, sf_dir):
    from accrete.plans.tables import state

    t = state(spark, sf_dir).groupBy("trigger_id").agg(F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"))
    return runlog.usage_intervals(t, 1_800_000_000).select("trigger_id", "real_end", "usage_start", F.col("usage_end").cast("long").alias("usage_end"))


@query("a15_class_stats", "SELECT CAST(year(o_orderdate) AS BIGINT) AS year, o_orderpriority AS class, CAST(grouping(year(o_orderdate)) * 2 + grouping(o_orderpriority) AS BIGINT) AS gid, count(*) AS n FROM orders GROUP BY CUBE (year(o_orderdate), o_orderpriority)")
def class_stats(spark, sf_dir):
    got = runlog.class_stats(load(spark, sf_dir, "orders"), F.year("o_orderdate"), F.col("o_orderpriority"))
    return got.select(F.col("year").cast("long").alias("year"), "class", F.col("gid").cast("long").alias("gid"), "n")


@query("a16_top_with_other", "WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), t AS (SELECT p_brand FROM c ORDER BY n DESC, p_brand LIMIT 5) SELECT CASE WHEN p_brand IN (SELECT p_brand FROM t) THEN p_brand ELSE 'Other' END AS class, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1")
def top_other(spark, sf_dir):
    return runlog.top_with_other(load(spark, sf_dir, "part"), "p_brand", 5)


@query("a17_centeredness", "WITH c AS (SELECT o_orderstatus AS class, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2), m AS (SELECT *, first_value(y) OVER (PARTITION BY class ORDER BY n DESC, y) AS mode, sum(n) OVER (PARTITION BY class) AS t FROM c) SELECT class, CAST(y - mode AS BIGINT) AS off, n, round((n / t)::DOUBLE, 9) AS share FROM m")
def centeredness(spark, sf_dir):
    return runlog.centeredness(load(spark, sf_dir, "orders"), F.year("o_orderdate"), F.col("o_orderstatus")).withColumn("share", F.round("share", 9))


@query("pf9_leaf_stages", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT c_custkey // 2 FROM customer)")
def leaves(spark, sf_dir):
    tree = load(spark, sf_dir, "customer").select("c_custkey", F.floor(F.col("c_custkey") / 2).alias("parent"))
    return runlog.leaf_stages(tree, "c_custkey", "parent").select("c_custkey")


@query("j8_models_trainings", "SELECT o.o_orderkey, c.c_mktsegment, n.n_name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey")
def left_joins(spark, sf_dir):
    o, c, n = (load(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey, "left").join(n, n.n_nationkey == c.c_nationkey, "left").select("o_orderkey", "c_mktsegment", "n_name")


@query("j16_childless", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS has_children FROM customer")
def childless(spark, sf_dir):
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    children = o.select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("_k", F.lit(True))
    return c.join(children, "c_custkey", "left").select("c_custkey", F.coalesce("_k", F.lit(False)).alias("has_children"))
