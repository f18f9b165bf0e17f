"""Trigger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from accrete.operators import triggers
from accrete.plans.registry import query
from accrete.plans.tables import STREAM, load, stream

CHUNKS = STREAM + ", c AS (SELECT idx // 100 AS chunk, * FROM s WHERE idx < (SELECT count(*) // 100 * 100 FROM s)), sc AS (SELECT chunk, avg(label) AS score FROM c GROUP BY 1)"


def chunked(spark, sf_dir):
    return triggers.chunks(stream(spark, sf_dir), 100)


def scores(spark, sf_dir):
    return chunked(spark, sf_dir).groupBy("chunk").agg(F.avg("label").alias("score"))


@query("t2_amount_trigger", STREAM + "SELECT idx // 300 AS trigger_id, count(*) AS n, min(timestamp) AS first_ts, max(timestamp) AS last_ts FROM s WHERE idx < (SELECT count(*) // 300 * 300 FROM s) GROUP BY 1")
def amount(spark, sf_dir):
    return triggers.amount_trigger(stream(spark, sf_dir), 300).where("trigger_id is not null").groupBy("trigger_id").agg(F.count("*").alias("n"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


@query("t3_time_trigger", STREAM + ", b AS (SELECT min(timestamp) AS a, max(timestamp) AS z FROM s), g AS (SELECT unnest(range((SELECT (z - a) // 43200 FROM b))) AS trigger_id) SELECT CAST(g.trigger_id AS BIGINT) AS trigger_id, count(s.key) AS n FROM g LEFT JOIN (SELECT key, (timestamp - a) // 43200 AS w FROM s, b) s ON w = g.trigger_id GROUP BY 1")
def time(spark, sf_dir):
    from accrete.plans.tables import events

    return triggers.time_trigger_counts(events(spark, sf_dir), 43_200)


@query("t4_chunks", CHUNKS + "SELECT chunk, count(*) AS n, CAST(sum(label) AS BIGINT) AS labels FROM c GROUP BY 1")
def chunk_sums(spark, sf_dir):
    return chunked(spark, sf_dir).groupBy("chunk").agg(F.count("*").alias("n"), F.sum("label").alias("labels"))


@query("t12_static_threshold", CHUNKS + "SELECT chunk, score >= 2.0 AS fired FROM sc")
def static(spark, sf_dir):
    return triggers.static_threshold(scores(spark, sf_dir), 2.0).select("chunk", "fired")


@query("t13_dynamic_quantile", CHUNKS + "SELECT chunk, CASE WHEN count(score) OVER w = 0 THEN true ELSE score > quantile_cont(score, 0.75) OVER w END AS fired FROM sc WINDOW w AS (ORDER BY chunk ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)")
def quantile(spark, sf_dir):
    return triggers.dynamic_quantile(scores(spark, sf_dir), 8, 0.75).select("chunk", "fired")


@query("t14_rolling_average", CHUNKS + "SELECT chunk, CASE WHEN count(score) OVER w = 0 THEN true ELSE score - avg(score) OVER w >= 0.0501234 END AS fired FROM sc WINDOW w AS (ORDER BY chunk ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)")
def rolling(spark, sf_dir):
    return triggers.rolling_average(scores(spark, sf_dir), 8, 0.0501234, absolute=True).select("chunk", "fired")


@query(
    "t17_avoidable_misclassifications",
    "WITH RECURSIVE " + CHUNKS.strip()[5:] + """, m AS (SELECT chunk, CAST(sum(CASE WHEN label <> key % 5 THEN 1 ELSE 0 END) AS BIGINT) AS wrong FROM c GROUP BY 1),
    r AS (SELECT chunk, greatest(0.0::DOUBLE, wrong - 75.0::DOUBLE) AS new FROM m),
    f AS (SELECT chunk, new, new AS total, new >= 20 AS fired FROM r WHERE chunk = 0
          UNION ALL SELECT r.chunk, r.new, CASE WHEN fired THEN 0 ELSE total END + r.new, CASE WHEN fired THEN 0 ELSE total END + r.new >= 20 FROM f JOIN r ON r.chunk = f.chunk + 1)
    SELECT chunk, round(new, 6) AS new, round(total, 6) AS total, fired FROM f""",
)
def avoidable(spark, sf_dir):
    """The chunks' counts are few; the fold over them is sequential by its reset at each firing."""
    by = chunked(spark, sf_dir).groupBy("chunk").agg(F.sum((F.col("label") != F.col("key") % 5).cast("long")).alias("wrong"), F.count("*").alias("n"))
    rows = [(r["chunk"], r["wrong"], r["n"]) for r in by.orderBy("chunk").collect()]
    folded = triggers.avoidable_misclassifications(rows, 0.25, 20)
    return spark.createDataFrame([(c, round(float(new), 6), round(float(total), 6), fired) for c, new, total, fired in folded], "chunk long, new double, total double, fired boolean")


@query("t19_data_density", CHUNKS + ", d AS (SELECT chunk, count(*) AS n, max(timestamp) AS e, min(timestamp) AS b FROM c GROUP BY 1) SELECT chunk, n, round(n / greatest(e - coalesce(lag(e) OVER (ORDER BY chunk), b), 1)::DOUBLE, 9) AS per_second FROM d")
def density(spark, sf_dir):
    return triggers.data_density(chunked(spark, sf_dir)).select("chunk", "n", F.round("per_second", 9).alias("per_second"))


@query("t22_incorporation_latency", CHUNKS + ", d AS (SELECT chunk, max(timestamp) AS e FROM c GROUP BY 1) SELECT d.chunk, CAST(sum(d.e - c.timestamp) AS BIGINT) AS regret FROM d JOIN c ON c.chunk <= d.chunk GROUP BY 1")
def latency(spark, sf_dir):
    return triggers.incorporation_latency(chunked(spark, sf_dir)).select("chunk", "regret")


@query("a25_ridge_forecast", CHUNKS + ", w AS (SELECT chunk, score, count(score) OVER v AS n, avg(chunk) OVER v AS x, avg(score) OVER v AS y, sum(chunk * score) OVER v AS xy, sum(chunk * chunk) OVER v AS xx FROM sc WINDOW v AS (ORDER BY chunk ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) SELECT chunk, round(CASE WHEN n > 0 THEN y + (xy - n * x * y) / (xx - n * x * x + 1.0) * (chunk - x) END, 6) AS forecast FROM w")
def forecast(spark, sf_dir):
    return triggers.ridge_forecast(scores(spark, sf_dir)).select("chunk", F.round("forecast", 6).alias("forecast"))


@query("t25_ensemble", STREAM + ", n AS (SELECT count(*) AS n FROM s), a AS (SELECT unnest(range(299, (SELECT n FROM n), 300)) AS i UNION SELECT unnest(range(449, (SELECT n FROM n), 450))) SELECT CAST(i AS BIGINT) AS fired_at FROM a WHERE (i + 1) % 900 IN (450, 0)")
def ensemble(spark, sf_dir):
    """Two count triggers, both needed: they meet at every second firing of the slower one's cycle."""
    n = stream(spark, sf_dir).count()
    fires = {"a": list(range(299, n, 300)), "b": list(range(449, n, 450))}
    got = triggers.ensemble(fires, lambda d: sum(d.values()) * 2 > len(d))
    return spark.createDataFrame([(i,) for i in got], "fired_at long")


def windows(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    return e.where("label < 5"), e.where("label >= 5")


DIMS = "WITH d AS (SELECT CASE WHEN label < 5 THEN 0 ELSE 1 END AS side, i - 1 AS dim, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"


@query("t10_mean_distance", DIMS + ", m AS (SELECT dim, avg(CASE WHEN side = 0 THEN x END) AS a, avg(CASE WHEN side = 1 THEN x END) AS b FROM d GROUP BY 1) SELECT round(sqrt(sum((a - b) * (a - b))), 6) AS distance FROM m")
def mean_distance(spark, sf_dir):
    return triggers.mean_distance(*windows(spark, sf_dir), "embedding").select(F.round("distance", 6).alias("distance"))


@query("t10_hellinger", DIMS + ", h AS (SELECT side, dim, least(greatest(floor((x + 5.0) / (10.0 / 20)), 0), 19) AS bin, count(*) AS n FROM d GROUP BY 1, 2, 3), p AS (SELECT *, n / sum(n) OVER (PARTITION BY side, dim) AS p FROM h), q AS (SELECT a.dim, sqrt(greatest(0, 1 - sum(sqrt(a.p * b.p)))) AS h FROM p a JOIN p b ON a.dim = b.dim AND a.bin = b.bin AND a.side = 0 AND b.side = 1 GROUP BY 1) SELECT round(avg(h), 6) AS distance FROM q")
def hellinger(spark, sf_dir):
    return triggers.hellinger(*windows(spark, sf_dir), "embedding").select(F.round("distance", 6).alias("distance"))


@query("t9_kolmogorov_smirnov", DIMS + ", p AS (SELECT dim, x, sum(CASE WHEN side = 0 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS b FROM d GROUP BY 1, 2), g AS (SELECT dim, abs(sum(a) OVER w / sum(a) OVER v - sum(b) OVER w / sum(b) OVER v) AS g FROM p WINDOW w AS (PARTITION BY dim ORDER BY x), v AS (PARTITION BY dim)) SELECT CAST(dim AS BIGINT) AS dim, round(max(g), 9) AS distance FROM g GROUP BY 1")
def ks(spark, sf_dir):
    return triggers.kolmogorov_smirnov(*windows(spark, sf_dir), "embedding").select(F.col("dim").cast("long").alias("dim"), F.round("distance", 9).alias("distance"))


@query("t27_maximum_triggers", STREAM + "SELECT idx // 300 AS trigger_id, count(*) AS n FROM s WHERE idx < least(900, (SELECT count(*) // 300 * 300 FROM s)) GROUP BY 1")
def at_most(spark, sf_dir):
    return triggers.amount_trigger(stream(spark, sf_dir), 300).where("trigger_id < 3").groupBy("trigger_id").agg(F.count("*").alias("n"))


PER_DIM = DIMS + ", p AS (SELECT dim, x, sum(CASE WHEN side = 0 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS b FROM d GROUP BY 1, 2), g AS (SELECT dim, a + b AS c, sum(a) OVER w / sum(a) OVER v - sum(b) OVER w / sum(b) OVER v AS g, sum(a) OVER v AS n, sum(b) OVER v AS m FROM p WINDOW w AS (PARTITION BY dim ORDER BY x), v AS (PARTITION BY dim))"


@query("t9_cramer_von_mises", PER_DIM + " SELECT CAST(dim AS BIGINT) AS dim, round((sum(c * g * g) * max(n) * max(m) / ((max(n) + max(m)) * (max(n) + max(m))))::DOUBLE, 6) AS distance FROM g GROUP BY 1")
def cvm(spark, sf_dir):
    got = triggers.cramer_von_mises(*windows(spark, sf_dir), "embedding")
    return got.select(F.col("dim").cast("long").alias("dim"), F.round("distance", 6).alias("distance"))


@query("t10_drifted_share", PER_DIM + ", k AS (SELECT dim, max(abs(g)) AS k FROM g GROUP BY 1) SELECT round(avg(CAST(k > 0.15 AS DOUBLE)), 9) AS distance FROM k")
def drifted(spark, sf_dir):
    return triggers.drifted_share(triggers.kolmogorov_smirnov(*windows(spark, sf_dir), "embedding"), 0.15).select(F.round("distance", 9).alias("distance"))


@query("t9_mmd")
def mmd(spark, sf_dir):
    return triggers.mmd(*windows(spark, sf_dir), "embedding", 8.0).select(F.round("distance", 6).alias("distance"))
