"""Queries of run logs, evaluation frames, selection with state, triggers that reset, and small functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from accrete.operators import drift, evaluation, runlog, selection, triggers
from accrete.operators.ordering import global_row_number, hash_rank, hash_uniform, sample_n, worker_split
from accrete.plans.choosing import H, U
from accrete.plans.registry import query
from accrete.plans.tables import STATE, STREAM, events, load, state, stream
from accrete.plans.triggering import CHUNKS, chunked

FROM, TO = 1_704_500_000, 1_705_500_000


@query("sc28_evaluation_source", STREAM + f"SELECT worker_id, count(*) AS n, min(key) AS first, CAST(sum(label) AS BIGINT) AS labels FROM (SELECT *, CAST(ntile(3) OVER (ORDER BY key) - 1 AS BIGINT) AS worker_id FROM s WHERE timestamp >= {FROM} AND timestamp < {TO}) GROUP BY 1")
def evaluation_source(spark, sf_dir):
    rows = events(spark, sf_dir).where((F.col("timestamp") >= FROM) & (F.col("timestamp") < TO))
    return worker_split(rows, 3).groupBy("worker_id").agg(F.count("*").alias("n"), F.min("key").alias("first"), F.sum("label").alias("labels"))


@query("sc29_fixed_keys", STREAM + "SELECT i // 34 AS worker_id, count(*) AS n, CAST(sum(key) AS BIGINT) AS keys FROM (SELECT key, row_number() OVER (ORDER BY key) - 1 AS i FROM s WHERE key < 100) GROUP BY 1")
def fixed_keys(spark, sf_dir):
    """100 keys over three workers, the ceiling of a third each."""
    placed = global_row_number(events(spark, sf_dir).where("key < 100").select("key"), "key")
    return placed.groupBy(F.floor(F.col("idx") / 34).alias("worker_id")).agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


@query("pf6_half_open", STREAM + f"SELECT 'from' AS bound, count(*) AS n FROM s WHERE timestamp >= {FROM} UNION ALL SELECT 'to', count(*) FROM s WHERE timestamp < {TO}")
def half_open(spark, sf_dir):
    e = events(spark, sf_dir)
    since, upto = e.where(F.col("timestamp") >= FROM), e.where(F.col("timestamp") < TO)
    return since.select(F.lit("from").alias("bound")).unionAll(upto.select(F.lit("to").alias("bound"))).groupBy("bound").agg(F.count("*").alias("n"))


@query("pf10_three_filters", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_totalprice > 100000")
def three_filters(spark, sf_dir):
    return load(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 100000)).select("o_orderkey")


@query("pf14_hash_partition", STREAM + f"SELECT key FROM s WHERE CAST(floor({U} * 16) AS BIGINT) = 3")
def hash_partition(spark, sf_dir):
    return events(spark, sf_dir).where(F.floor(hash_uniform(42, "key") * 16) == 3).select("key")


TRAININGS = STATE + ", t AS (SELECT trigger_id, min(timestamp) AS first_timestamp, count(*) AS n FROM st GROUP BY 1), m AS (SELECT trigger_id, trigger_id + 100 AS id_model FROM t WHERE trigger_id % 2 = 0)\n"


def trainings(spark, sf_dir):
    return state(spark, sf_dir).groupBy("trigger_id").agg(F.min("timestamp").alias("first_timestamp"), F.count("*").alias("n"))


@query("j7_triggers_models", TRAININGS + "SELECT trigger_id, first_timestamp, id_model FROM t JOIN m USING (trigger_id)")
def triggers_models(spark, sf_dir):
    t = trainings(spark, sf_dir)
    return t.join(t.where("trigger_id % 2 = 0").select("trigger_id", (F.col("trigger_id") + 100).alias("id_model")), "trigger_id").select("trigger_id", "first_timestamp", "id_model")


@query("j9_one_to_one", "SELECT c_custkey, c_mktsegment, a FROM customer JOIN (SELECT c_custkey, round(c_acctbal) AS a FROM customer) USING (c_custkey)")
def one_to_one(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    return runlog.one_to_one(c.select("c_custkey", "c_mktsegment"), c.select("c_custkey", F.round("c_acctbal").alias("a")), "c_custkey")


@query("j10_stage_parents", "WITH g AS (SELECT n_nationkey, n_regionkey, CAST(count(*) AS BIGINT) AS sum FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) SELECT g.n_nationkey, g.n_regionkey, g.sum, p.sum AS parent_sum FROM g LEFT JOIN g p ON p.n_nationkey = g.n_regionkey")
def stage_parents(spark, sf_dir):
    c, n = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    rows = c.join(n, c.c_nationkey == n.n_nationkey).select("n_nationkey", "n_regionkey", F.lit(1).cast("long").alias("one"))
    return runlog.with_parents(rows, "n_nationkey", "n_regionkey", "one").select("n_nationkey", "n_regionkey", "sum", "parent_sum")


@query("j11_cost_metric", STATE + "SELECT trigger_id, round(sum(value), 3) AS cost, round(avg(label), 6) AS metric FROM st GROUP BY 1")
def cost_metric(spark, sf_dir):
    st = state(spark, sf_dir)
    cost, metric = st.groupBy("trigger_id").agg(F.round(F.sum("value"), 3).alias("cost")), st.groupBy("trigger_id").agg(F.round(F.avg("label"), 6).alias("metric"))
    return runlog.one_to_one(cost, metric, "trigger_id")


@query("a12_stage_mean", STREAM + "SELECT key, label, round(avg(value) OVER (PARTITION BY label), 6) AS mean FROM s")
def stage_mean(spark, sf_dir):
    return runlog.with_stage_mean(events(spark, sf_dir), "label", "value").select("key", "label", F.round("mean", 6).alias("mean"))


@query("a13_cost_by_stage", STREAM + "SELECT label, round(sum(value), 3) AS cost, row_number() OVER (ORDER BY sum(value) DESC) AS place FROM s GROUP BY 1")
def cost_by_stage(spark, sf_dir):
    return runlog.cost_by_stage(events(spark, sf_dir), "label", "value").select("label", F.round("cost", 3).alias("cost"), F.col("place").cast("long").alias("place"))


@query("a21_metrics", STATE + "SELECT trigger_id, round(avg((label = key % 5)::INT), 9) AS accuracy, CAST(sum((label = key % 5)::INT) AS BIGINT) AS correct, count(*) AS seen, round(avg(abs(label - key % 5)), 9) AS mean_error FROM st GROUP BY 1")
def metrics(spark, sf_dir):
    rows = state(spark, sf_dir).select("trigger_id", F.col("label").alias("y"), (F.col("key") % 5).alias("p"))
    got = evaluation.evaluate(rows, ["trigger_id"], ["Accuracy", "correct", "SEEN", "mean_error"])
    return got.withColumns({c: F.round(c, 9) for c in ("accuracy", "mean_error")})


@query("k3_target_size", STATE + f"SELECT key FROM (SELECT key, row_number() OVER (ORDER BY {H}, key) AS rn FROM st WHERE trigger_id = 0) WHERE rn <= 500 * 37 // 100")
def target(spark, sf_dir):
    rows = state(spark, sf_dir).where("trigger_id = 0")
    return sample_n(rows, selection.target_size(rows.count(), 37), 42).select("key")


@query("k4_random_keys", STREAM + f"SELECT key FROM s WHERE key % 3 = 0 ORDER BY {H}, key LIMIT 64")
def random_keys(spark, sf_dir):
    return sample_n(events(spark, sf_dir).where("key % 3 = 0"), 64, 42).select("key")


@query("k5_shuffled", STATE + f"SELECT key, row_number() OVER (ORDER BY {H}, key) - 1 AS place FROM st WHERE trigger_id = 0")
def shuffled(spark, sf_dir):
    rows = state(spark, sf_dir).where("trigger_id = 0").select("key").withColumn("_h", hash_rank(42, "key"))
    return global_row_number(rows, "_h", "key", name="place").select("key", "place")


@query("k12_record_split", STREAM + f"SELECT {U} < 0.1 AS held, count(*) AS n, CAST(sum(key) AS BIGINT) AS keys FROM s GROUP BY 1")
def record_split(spark, sf_dir):
    return events(spark, sf_dir).groupBy((hash_uniform(42, "key") < 0.1).alias("held")).agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


@query("u4_interleaved", STATE + "SELECT key, used, chunk * 2 + (NOT used)::BIGINT AS place FROM (SELECT key, trigger_id = 0 AS used, (row_number() OVER (PARTITION BY trigger_id ORDER BY key) - 1) // 50 AS chunk FROM st WHERE trigger_id <= 1)")
def interleaved(spark, sf_dir):
    st = state(spark, sf_dir)
    return selection.interleaved(st.where("trigger_id = 0"), st.where("trigger_id = 1"), 50).select("key", "used", "place")


@query("u5_complement", STATE + f"SELECT key FROM st WHERE trigger_id = 1 AND {U} >= 0.3")
def complement(spark, sf_dir):
    return selection.holdout(state(spark, sf_dir).where("trigger_id = 1"), 30).where("half = 0").select("key")


@query("f4_interval_parse", "SELECT url, contains(url, '.org/') AS org, regexp_extract(url, '/([a-z]{2})/[0-9]+', 1) AS lang FROM pages")
def interval_parse(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("url", F.contains("url", F.lit(".org/")).alias("org"), F.regexp_extract("url", "/([a-z]{2})/[0-9]+", 1).alias("lang"))


@query("f8_f12_times", STREAM + "SELECT key, strftime(to_timestamp(timestamp) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS at, (timestamp // 86400) * 86400 + 1 AS day_second FROM s")
def times(spark, sf_dir):
    return events(spark, sf_dir).select("key", F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("at"), (F.floor(F.col("timestamp") / 86400) * 86400 + 1).alias("day_second"))


@query("f11_centres", STATE + "SELECT trigger_id, (min(timestamp) + max(timestamp)) / 2 AS center, max(timestamp) - min(timestamp) AS length FROM st GROUP BY 1")
def centres(spark, sf_dir):
    t = state(spark, sf_dir).groupBy("trigger_id").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    return t.select("trigger_id", ((F.col("a") + F.col("b")) / 2).alias("center"), (F.col("b") - F.col("a")).alias("length"))


@query("f17_weights", STREAM + "SELECT key, round(sum(value) OVER () / (count(*) OVER () * value), 6) AS weight FROM s WHERE value > 0")
def weights(spark, sf_dir):
    from accrete.operators import scoring

    rows = events(spark, sf_dir).where("value > 0")
    return scoring.importance_sample(rows, "value", rows.count()).select("key", F.round("weight", 6).alias("weight"))


@query("f18_arithmetic", STREAM + "SELECT key, greatest(0.0::DOUBLE, least(1.0::DOUBLE, value / 50)) AS clamped, CAST(ceil(value) AS BIGINT) AS up, CAST(floor(value / 7) AS BIGINT) AS whole, key % 7 AS rest FROM s")
def arithmetic(spark, sf_dir):
    v = F.col("value")
    return events(spark, sf_dir).select("key", F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / 50)).alias("clamped"), F.ceil(v).alias("up"), F.floor(v / 7).alias("whole"), F.pmod("key", F.lit(7)).alias("rest"))


@query("f21_checksums", "SELECT doc_id, sha256(coalesce(text, '')) AS checksum FROM documents")
def checksums(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("checksum"))


@query("f22_gather", "SELECT vec_id, CAST(embedding[3] AS DOUBLE) AS third, CAST(embedding[1] AS DOUBLE) AS first, len(list_concat(embedding, embedding)) AS n FROM embeddings")
def gather(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.transform(F.array(F.lit(3), F.lit(1)), lambda i: F.element_at("embedding", i)).alias("g"))
    return e.select("vec_id", F.col("g")[0].cast("double").alias("third"), F.col("g")[1].cast("double").alias("first"), F.size(F.flatten(F.array("embedding", "embedding"))).cast("long").alias("n"))


@query("e12_results_frame", STATE + """, r AS (SELECT trigger_id % 3 AS id_model, trigger_id * 10 AS start, trigger_id * 10 + 7 AS "end", count(*) AS seen, CAST(sum((label = key % 5)::INT) AS BIGINT) AS correct FROM st GROUP BY trigger_id)
    SELECT id_model, start, "end", m AS metric, CAST(CASE m WHEN 'seen' THEN seen ELSE correct END AS DOUBLE) AS value, 7 AS length, start + 3.5::DOUBLE AS center FROM r CROSS JOIN (SELECT unnest(['seen', 'correct']) AS m)""")
def results_frame(spark, sf_dir):
    by = state(spark, sf_dir).groupBy("trigger_id").agg(F.count("*").alias("seen"), F.sum((F.col("label") == F.col("key") % 5).cast("long")).alias("correct"))
    each = F.struct((F.col("trigger_id") * 10).alias("start"), (F.col("trigger_id") * 10 + 7).alias("end"), F.create_map(F.lit("seen"), F.col("seen").cast("double"), F.lit("correct"), F.col("correct").cast("double")).alias("metrics"))
    return evaluation.results_frame(by.groupBy((F.col("trigger_id") % 3).alias("id_model")).agg(F.collect_list(each).alias("intervals")))


@query("e3_static", "SELECT * FROM (VALUES (0::BIGINT, 10::BIGINT, 0::BIGINT), (10, 40, 10), (90, 100, 90)) t(start, \"end\", active_before)")
def static(spark, sf_dir):
    return evaluation.static_intervals(spark, [(0, 10), (10, 40), (90, 100)])


@query("e7_after_training", TRAININGS + "SELECT first_timestamp AS start, first_timestamp + 100 AS \"end\", 3::BIGINT AS id_model, 1704600000 < first_timestamp AS active FROM t")
def after_training(spark, sf_dir):
    i = trainings(spark, sf_dir).select(F.col("first_timestamp").alias("start"), (F.col("first_timestamp") + 100).alias("end"), F.col("first_timestamp").alias("active_before"))
    return evaluation.requests_after_training(i, 3, 1_704_600_000)


@query("e9_request_groups", TRAININGS + "SELECT trigger_id % 2 AS dataset, trigger_id % 3 AS id_model, count(*) AS n, min(first_timestamp) AS first FROM t GROUP BY 1, 2")
def request_groups(spark, sf_dir):
    r = trainings(spark, sf_dir).select((F.col("trigger_id") % 2).alias("dataset"), (F.col("trigger_id") % 3).alias("id_model"), F.col("first_timestamp").alias("start"), (F.col("first_timestamp") + 100).alias("end"))
    got = evaluation.request_groups(r, ["dataset", "id_model"])
    return got.select("dataset", "id_model", F.size("intervals").cast("long").alias("n"), F.col("intervals")[0]["start"].alias("first"))


@query("e16_invalid_runs", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(o_orderkey) < 5")
def invalid_runs(spark, sf_dir):
    runs, stages = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return runlog.invalid_runs(runs, stages, "c_custkey", 5)


@query("sel5_first_freshness", STATE + f"SELECT key FROM st ORDER BY {H}, key LIMIT 90")
def first_freshness(spark, sf_dir):
    return selection.freshness_first(state(spark, sf_dir), 90).select("key")


@query("sel7_marked_used", STATE + "SELECT key, CASE WHEN key % 4 = 0 THEN 1 ELSE 0 END AS last_used_in_trigger FROM st WHERE trigger_id = 0 OR (trigger_id = 1 AND key % 4 = 0)")
def marked_used(spark, sf_dir):
    st = state(spark, sf_dir)
    used = selection.mark_used(spark.createDataFrame([], "key long, last_used_in_trigger int"), st.where("trigger_id = 0"), 0)
    return selection.mark_used(used, st.where("trigger_id <= 1 and key % 4 = 0"), 1)


@query("sel8_coreset", STATE + f"SELECT key FROM st WHERE trigger_id = 0 UNION ALL SELECT key FROM (SELECT key FROM st WHERE trigger_id = 1 ORDER BY {H}, key LIMIT 40)")
def coreset(spark, sf_dir):
    st = state(spark, sf_dir)
    chosen = [selection.coreset(st, t, 1, lambda rows: sample_n(rows, 40, 42)).select("key") for t in (0, 1)]
    return chosen[0].unionAll(chosen[1])


UNEQUAL = STREAM + f""", g AS (SELECT key, CASE WHEN key % 150 < 100 THEN 0 WHEN key % 150 < 125 THEN 1 WHEN key % 150 < 145 THEN 2 ELSE 3 END AS grp FROM s WHERE key < 900),
c AS (SELECT grp, count(*) AS n FROM g GROUP BY 1), sh AS (SELECT max(x) AS share FROM range(0, 1000) r(x) WHERE (SELECT sum(least(n, x)) FROM c) <= 350)
SELECT grp, count(*) AS n, CAST(sum(key) AS BIGINT) AS keys FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {H}, key) AS rn FROM g) WHERE rn <= (SELECT share FROM sh) GROUP BY 1"""


@query("pre5_fair_share", UNEQUAL)
def fair_share(spark, sf_dir):
    """Groups in the proportions 100, 25, 20 and 5; the small ones give all they have, and the large one what is left."""
    k = F.col("key") % 150
    g = events(spark, sf_dir).where("key < 900").withColumn("grp", F.when(k < 100, 0).when(k < 125, 1).when(k < 145, 2).otherwise(3))
    return selection.balanced(g, "grp", 350).groupBy("grp").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


@query("t5_warmup", CHUNKS + "SELECT chunk, CASE WHEN chunk < 4 THEN chunk % 2 = 0 ELSE chunk % 5 = 0 END AS fired FROM (SELECT DISTINCT chunk FROM c)")
def warmup(spark, sf_dir):
    policy = drift.warmup_policy(4, lambda i: i % 2 == 0, lambda i: i % 5 == 0)
    rows = [r["chunk"] for r in chunked(spark, sf_dir).select("chunk").distinct().collect()]  # one a chunk
    return spark.createDataFrame([(c, policy(c)) for c in rows], "chunk long, fired boolean")


@query("t16_performance_trigger", "WITH RECURSIVE " + CHUNKS.strip()[5:] + """, a AS (SELECT chunk, avg((label = key % 5)::INT) AS acc FROM c GROUP BY 1),
f AS (SELECT chunk, false AS fired, acc AS total, 1 AS n FROM a WHERE chunk = 0
      UNION ALL SELECT chunk, low, CASE WHEN low THEN 0 ELSE total + acc END, CASE WHEN low THEN 0 ELSE n + 1 END
      FROM (SELECT a.chunk, acc, total, n, n > 0 AND total / greatest(n, 1) - acc >= 0.02::DOUBLE AS low FROM f JOIN a ON a.chunk = f.chunk + 1))
SELECT chunk, fired FROM f""")
def performance(spark, sf_dir):
    """Fires at 0.02 below the mean of all accuracies since the last firing; the chunks' accuracies are few."""
    by = chunked(spark, sf_dir).groupBy("chunk").agg(F.avg((F.col("label") == F.col("key") % 5).cast("double")).alias("acc")).orderBy("chunk")
    folded = drift.performance_trigger([(r["chunk"], r["acc"]) for r in by.collect()], [drift.drop_from_mean(1 << 30, 0.02)])
    return spark.createDataFrame(folded, "chunk long, fired boolean")


@query("t21_cost_trigger", "WITH RECURSIVE " + CHUNKS.strip()[5:] + """, b AS (SELECT chunk, count(*) AS n, max(timestamp) AS e, sum(timestamp) AS s FROM c GROUP BY 1),
d AS (SELECT chunk, n * e - s + coalesce(sum(n) OVER (ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * (e - coalesce(lag(e) OVER (ORDER BY chunk), e)) AS new FROM b),
r AS (SELECT chunk, CAST(sum(new) OVER (ORDER BY chunk) AS BIGINT) AS regret FROM d),
f AS (SELECT chunk, regret, regret AS since, regret >= 50000000 AS fired, CASE WHEN regret >= 50000000 THEN regret ELSE 0 END AS base FROM r WHERE chunk = 0
      UNION ALL SELECT r.chunk, r.regret, r.regret - base, r.regret - base >= 50000000, CASE WHEN r.regret - base >= 50000000 THEN r.regret ELSE base END FROM f JOIN r ON r.chunk = f.chunk + 1)
SELECT chunk, CAST(since AS DOUBLE) AS since, fired FROM f""")
def cost(spark, sf_dir):
    """Regret since the last firing against a constant training time; one number a chunk comes to the driver."""
    rows = [(r["chunk"], float(r["regret"])) for r in triggers.incorporation_latency(chunked(spark, sf_dir)).orderBy("chunk").collect()]
    return spark.createDataFrame(triggers.cost_trigger(rows, lambda _: 50_000_000.0, 1.0), "chunk long, since double, fired boolean")
