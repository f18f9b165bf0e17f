"""Evaluation queries; guesses and scores are derived from hashes of the keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from accrete.operators import evaluation as ev
from accrete.operators.ordering import hash_uniform
from accrete.plans.registry import query
from accrete.plans.tables import STREAM, events, load

START, END, DAY = 1_704_067_200, 1_706_745_600, 86_400
U = "((('0x' || substr(md5('42:' || key), 1, 8))::BIGINT) + 0.5) / 4294967296.0"
GUESSES = STREAM + f", g AS (SELECT key, (timestamp - {START}) // 604800 AS week, label AS y, CASE WHEN {U} < 0.6 THEN label ELSE key % 5 END AS p, CAST(label >= 3 AS BIGINT) AS positive, round({U}, 2) AS score FROM s)\n"
INTERVALS = "SELECT CAST(range AS BIGINT) AS start FROM range(1704067200, 1706745600, 604800)"


def guesses(spark, sf_dir):
    e = events(spark, sf_dir)
    u = hash_uniform(42, "key")
    return e.select("key", F.floor((F.col("timestamp") - START) / 604800).alias("week"), F.col("label").alias("y"), F.when(u < 0.6, F.col("label")).otherwise(F.col("key") % 5).alias("p"), (F.col("label") >= 3).cast("long").alias("positive"), F.round(u, 2).alias("score"))


@query("e1_slices", f"SELECT start, least(start + 604800, {END}) AS \"end\", start AS active_before FROM ({INTERVALS})")
def slices(spark, sf_dir):
    return ev.slices(spark, START, END, 604_800)


@query("e2_periodic", f"SELECT CAST(range AS BIGINT) AS center, CAST(range - 172800 + 1 AS BIGINT) AS start, CAST(range + 86400 AS BIGINT) AS \"end\" FROM range({START}, {END} + 1, 432000)")
def periodic(spark, sf_dir):
    return ev.periodic(spark, START, END, 432_000, "(-2d; +1d]")


TRAININGS = "SELECT unnest([0, 40, 100, 130]) AS s, unnest([0, 70, 100, 200]) AS e"


def trainings(spark):
    return spark.createDataFrame([(0, 0), (40, 70), (100, 100), (130, 200)], "start long, end long")


@query("e4_between_triggers", f"SELECT CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS \"end\" FROM ({TRAININGS}) UNION ALL SELECT 201, 500")
def between(spark, sf_dir):
    return ev.between_triggers(trainings(spark), 500)


@query(
    "e5_offsets",
    f"""WITH t AS ({TRAININGS}), o AS (
    SELECT '-inf' AS "offset", s, e, 0 AS a, s AS b FROM t UNION ALL SELECT 'inf', s, e, e + 1, NULL FROM t UNION ALL SELECT '0', s, e, s, e + 1 FROM t
    UNION ALL SELECT '10s', s, e, e + 1, e + 11 FROM t UNION ALL SELECT '-10s', s, e, greatest(0, s - 10), s FROM t)
    SELECT "offset", CAST(s AS BIGINT) AS train_start, CAST(e AS BIGINT) AS train_end, CAST(a AS BIGINT) AS start, CAST(b AS BIGINT) AS "end" FROM o""",
)
def offsets(spark, sf_dir):
    return ev.offsets(trainings(spark), ["-inf", "inf", "0", "10s", "-10s"])


@query(
    "e8_requests",
    f"""WITH i AS (SELECT start, least(start + 604800, {END}) AS "end", start AS active_before FROM ({INTERVALS})),
    m AS (SELECT CAST(unnest([21, 22, 23, 26]) AS BIGINT) AS id_model, CAST(unnest([1704067100, 1704700000, 1705300000, 1705900000]) AS BIGINT) AS last_timestamp),
    l AS (SELECT *, coalesce(lead(id_model) OVER (ORDER BY id_model), id_model) AS nxt FROM m),
    a AS (SELECT i.*, (SELECT max(id_model) FROM m WHERE last_timestamp < active_before) AS act FROM i)
    SELECT start, "end", active_before, l.id_model, l.id_model = act AS active, l.id_model = coalesce((SELECT nxt FROM l l2 WHERE l2.id_model = act), 21) AS trained FROM a, l""",
)
def requests(spark, sf_dir):
    models = spark.createDataFrame([(21, 1704067100), (22, 1704700000), (23, 1705300000), (26, 1705900000)], "id_model long, last_timestamp long")
    return ev.requests(ev.slices(spark, START, END, 604_800), models)


@query("a18_accuracy", GUESSES + "SELECT week, count(*) AS n, round(avg(CAST(y = p AS DOUBLE)), 9) AS accuracy FROM g GROUP BY 1")
def accuracy(spark, sf_dir):
    return ev.accuracy(guesses(spark, sf_dir), ["week"]).withColumn("accuracy", F.round("accuracy", 9))


@query("a18_top_n_accuracy", "WITH x AS (SELECT label, [i - 1 FOR i IN list_grade_up(list_transform(embedding[1:10], lambda v: -v))][1:3] AS best FROM embeddings) SELECT count(*) AS n, round(avg(CAST(list_contains(best, label) AS DOUBLE)), 9) AS accuracy FROM x")
def top_n(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").withColumn("logits", F.slice("embedding", 1, 10))
    return ev.top_n_accuracy(e, "logits", "label", 3).withColumn("accuracy", F.round("accuracy", 9))


@query(
    "a19_f1",
    GUESSES + """, c AS (SELECT CAST(range AS BIGINT) AS c FROM range(7)), k AS (SELECT c, (SELECT count(*) FROM g WHERE y = c) AS t, (SELECT count(*) FROM g WHERE p = c) AS told, (SELECT count(*) FROM g WHERE y = c AND p = c) AS tp FROM c),
    f AS (SELECT *, CASE WHEN t + told > 0 THEN 2.0::DOUBLE * tp / (t + told) ELSE 0 END AS f1 FROM k)
    SELECT round((sum(tp) / sum(told))::DOUBLE, 9) AS f1_micro, round(sum(f1) / 7, 9) AS f1_macro, round(sum(f1 * t) / sum(t), 9) AS f1_weighted FROM f""",
)
def f1(spark, sf_dir):
    got = ev.f1(guesses(spark, sf_dir), 7)
    return got.select(*[F.round(c, 9).alias(c) for c in got.columns])


@query(
    "a20_roc_auc",
    GUESSES + """, a AS (SELECT week, score, sum(positive) AS pos, sum(1 - positive) AS neg FROM g GROUP BY 1, 2),
    t AS (SELECT *, sum(pos) OVER (PARTITION BY week ORDER BY score DESC) AS tp, sum(pos) OVER (PARTITION BY week) AS p, sum(neg) OVER (PARTITION BY week) AS n FROM a)
    SELECT week, round(sum(CASE WHEN p > 0 AND n > 0 THEN neg * (tp - pos / 2.0::DOUBLE) / (p * n)::DOUBLE ELSE 0 END), 9) AS auc FROM t GROUP BY 1""",
)
def auc(spark, sf_dir):
    return ev.roc_auc(guesses(spark, sf_dir), ["week"], "positive").withColumn("auc", F.round("auc", 9))


@query("a23_misclassifications", GUESSES + "SELECT week, count(*) FILTER (WHERE y <> p) AS wrong FROM g GROUP BY 1")
def wrong(spark, sf_dir):
    return guesses(spark, sf_dir).groupBy("week").agg(F.sum((F.col("y") != F.col("p")).cast("long")).alias("wrong"))


@query("e10_interval_size", STREAM + f"SELECT i.start, count(s.key) AS n, CASE WHEN count(s.key) = 0 THEN 'empty' ELSE 'ok' END AS status FROM (SELECT CAST(range AS BIGINT) AS start FROM range({START} - 604800, {END}, 604800)) i LEFT JOIN s ON s.timestamp >= i.start AND s.timestamp < i.start + 604800 GROUP BY 1")
def sizes(spark, sf_dir):
    i = ev.slices(spark, START - 604_800, END, 604_800)
    counts = events(spark, sf_dir).groupBy((F.floor((F.col("timestamp") - START) / 604_800) * 604_800 + START).alias("start")).agg(F.count("*").alias("n"))
    return i.join(counts, "start", "left").select("start", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), "empty").otherwise("ok").alias("status"))


@query("e11_interval_accuracy", GUESSES + f", s2 AS (SELECT key, timestamp FROM s), i AS (SELECT CAST(range - 172800 AS BIGINT) AS a, CAST(range + 86400 AS BIGINT) AS b FROM range({START}, {END} + 1, 432000)) SELECT a AS start, count(*) AS n, round(avg(CAST(y = p AS DOUBLE)), 9) AS accuracy FROM g JOIN s2 USING (key) JOIN i ON timestamp >= a AND timestamp <= b GROUP BY 1")
def by_interval(spark, sf_dir):
    """All requests in one job: guesses meet the intervals (a configuration's list) that hold them, which may overlap."""
    at = events(spark, sf_dir).select("key", "timestamp")
    i = ev.periodic(spark, START, END, 432_000, "[-2d; +1d]").select(F.col("start").alias("a"), F.col("end").alias("b"))
    rows = guesses(spark, sf_dir).join(at, "key").join(F.broadcast(i), (F.col("timestamp") >= F.col("a")) & (F.col("timestamp") <= F.col("b")))
    return ev.accuracy(rows, ["a"]).select(F.col("a").alias("start"), "n", F.round("accuracy", 9).alias("accuracy"))


@query("e14_equivalent_runs", "SELECT md5(c_mktsegment || ':' || CAST(c_nationkey AS VARCHAR)) AS config, count(*) AS n, round(avg(c_acctbal), 4) AS value FROM customer GROUP BY 1")
def equivalent(spark, sf_dir):
    """Runs whose configurations agree but for their seed (here the customer's key) are one group."""
    c = load(spark, sf_dir, "customer")
    return c.groupBy(F.md5(F.concat_ws(":", "c_mktsegment", F.col("c_nationkey").cast("string"))).alias("config")).agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("value"))
