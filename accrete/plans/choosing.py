"""Selection queries over the stream with its triggers."""

from __future__ import annotations

from pyspark.sql import functions as F

from accrete.operators import selection
from accrete.operators.ordering import hash_rank, hash_uniform, sample_n
from accrete.plans.registry import query
from accrete.plans.tables import STATE, state

H = "md5('42:' || key)"
U = "((('0x' || substr(md5('42:' || key), 1, 8))::BIGINT) + 0.5) / 4294967296.0"
K = "SELECT key, timestamp, label FROM "


def shown(df):
    return df.select("key", "timestamp", "label")


@query("sel2_new_data_reset", STATE + K + "st WHERE trigger_id = 1")
def reset(spark, sf_dir):
    return shown(selection.new_data(state(spark, sf_dir), 1, tail=0))


@query("sel2_new_data_reset_limit", STATE + K + f"st WHERE trigger_id = 1 ORDER BY {H}, key LIMIT 100")
def reset_limit(spark, sf_dir):
    return shown(selection.new_data(state(spark, sf_dir), 1, tail=0, limit=100))


@query("sel3_new_data_tail", STATE + K + "st WHERE trigger_id BETWEEN 0 AND 1")
def tail(spark, sf_dir):
    return shown(selection.new_data(state(spark, sf_dir), 1, tail=1))


@query("sel4_new_data_last_x", STATE + K + "st WHERE trigger_id <= 1 ORDER BY timestamp DESC, key DESC LIMIT 120")
def last_x(spark, sf_dir):
    return shown(selection.new_data(state(spark, sf_dir), 1, tail=None, limit=120, limit_by="lastX"))


@query("sel4_new_data_sample_uar", STATE + K + f"st WHERE trigger_id <= 1 ORDER BY {H}, key LIMIT 150")
def sample_uar(spark, sf_dir):
    return shown(selection.new_data(state(spark, sf_dir), 1, tail=None, limit=150))


@query(
    "sel6_freshness_mix",
    STATE + f"""SELECT used, count(*) AS n, CAST(sum(key) AS BIGINT) AS keys FROM (
    (SELECT key, false AS used FROM st WHERE trigger_id <> 0 ORDER BY {H}, key LIMIT 60) UNION ALL
    (SELECT key, true AS used FROM st WHERE trigger_id = 0 ORDER BY {H}, key LIMIT 140)) GROUP BY 1""",
)
def fresh(spark, sf_dir):
    st = state(spark, sf_dir)
    return selection.freshness(st, st.where("trigger_id = 0"), 30, 200).groupBy("used").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


@query("sel10_rho_holdout", STATE + f"SELECT CAST({U} < 0.3 AS BIGINT) AS half, count(*) AS n, CAST(sum(key) AS BIGINT) AS keys FROM st GROUP BY 1")
def halves(spark, sf_dir):
    return selection.holdout(state(spark, sf_dir), 30).groupBy("half").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


@query("sel14_partitions", STATE + "SELECT trigger_id, (rn - 1) // 128 AS partition_id, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY trigger_id ORDER BY timestamp, key) AS rn FROM st) GROUP BY 1, 2")
def partitions(spark, sf_dir):
    return selection.partition_ids(state(spark, sf_dir), 128).groupBy("trigger_id", "partition_id").agg(F.count("*").alias("n"))


@query("pre1_in_order", STATE + "SELECT key, timestamp, label FROM st WHERE trigger_id >= 1 ORDER BY timestamp, key LIMIT 80")
def in_order(spark, sf_dir):
    return shown(selection.tail_filter(state(spark, sf_dir), 2, 1).orderBy("timestamp", "key").limit(80))


@query("pre2_random", STATE + K + f"st WHERE trigger_id = 0 ORDER BY {H}, key LIMIT 75")
def random(spark, sf_dir):
    return shown(sample_n(state(spark, sf_dir).where("trigger_id = 0"), 75, 42))


@query("pre3_random_no_replacement", STATE + K + f"st WHERE trigger_id <= 1 ORDER BY CASE WHEN trigger_id = 0 AND label <= 1 THEN 1 ELSE 0 END, {H}, key LIMIT 200")
def no_replacement(spark, sf_dir):
    st = state(spark, sf_dir).where("trigger_id <= 1")
    used = st.where("trigger_id = 0 and label <= 1").select("key", F.lit(5).alias("last_used"))
    return shown(selection.random_no_replacement(st, used, 3, 200))


def balanced_sql(by: str, share: str, more: str = "") -> str:
    return STATE + f", b AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {H}, key) AS rn FROM st WHERE trigger_id <= 1), c AS (SELECT {by}, count(*) AS c FROM b GROUP BY 1) SELECT {by}, count(*) AS n, CAST(sum(key) AS BIGINT) AS keys FROM (SELECT * FROM b WHERE rn <= {share} {more}) GROUP BY 1"


@query("pre4_label_balanced", balanced_sql("label", "20"))
def label_balanced(spark, sf_dir):
    """A target of 104 among five classes that all have more than a fifth of it."""
    return selection.balanced(state(spark, sf_dir).where("trigger_id <= 1"), "label", 104).groupBy("label").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


@query("pre4_force_column", balanced_sql("label", "(SELECT min(c) FROM c)"))
def force_column(spark, sf_dir):
    return selection.balanced(state(spark, sf_dir).where("trigger_id <= 1"), "label", 100_000, force="column").groupBy("label").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


@query("pre4_force_size", balanced_sql("label", "21", "ORDER BY timestamp, key LIMIT 104"))
def force_size(spark, sf_dir):
    return selection.balanced(state(spark, sf_dir).where("trigger_id <= 1"), "label", 104, force="size").groupBy("label").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


@query("pre6_trigger_balanced", balanced_sql("trigger_id", "60"))
def trigger_balanced(spark, sf_dir):
    return selection.balanced(state(spark, sf_dir).where("trigger_id <= 1"), "trigger_id", 120).groupBy("trigger_id").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


@query("k9_weighted_sample", STATE + f"SELECT key FROM st WHERE value > 0 ORDER BY -ln({U}) / value, key LIMIT 100")
def weighted(spark, sf_dir):
    from accrete.operators.ordering import weighted_sample_n

    return weighted_sample_n(state(spark, sf_dir), 100, "value", 42).select("key")


@query("sc31_bernoulli", STATE + f"SELECT key FROM st WHERE {U} < 0.1")
def bernoulli(spark, sf_dir):
    return state(spark, sf_dir).where(hash_uniform(42, "key") < 0.1).select("key")


@query("k11_holdout_per_year", f"SELECT y AS year, CASE WHEN rn <= ceil(n * 0.25) THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || key), key) AS rn, count(*) OVER (PARTITION BY y) AS n FROM (SELECT o_orderkey AS key, CAST(year(o_orderdate) AS BIGINT) AS y FROM orders)) GROUP BY 1, 2")
def per_year(spark, sf_dir):
    from pyspark.sql import Window

    from accrete.plans.tables import load

    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.year("o_orderdate").cast("long").alias("year"))
    w = Window.partitionBy("year")
    cut = F.ceil(F.count("*").over(w) * 0.25)
    return o.withColumn("split", F.when(F.row_number().over(w.orderBy(hash_rank(42, "key"), "key")) <= cut, "test").otherwise("train")).groupBy("year", "split").agg(F.count("*").alias("n"))


@query("a4_available_labels", STATE + "SELECT DISTINCT label FROM st WHERE trigger_id >= 0 AND trigger_id < 2")
def labels(spark, sf_dir):
    return state(spark, sf_dir).where("trigger_id >= 0 and trigger_id < 2").select("label").distinct()


@query("a5_next_trigger", STATE + "SELECT CAST(coalesce(max(trigger_id) + 1, 0) AS BIGINT) AS next FROM st")
def next_trigger(spark, sf_dir):
    return state(spark, sf_dir).agg(F.coalesce(F.max("trigger_id") + 1, F.lit(0)).alias("next"))


@query("flagship_balanced_presample", STATE + f"SELECT trigger_id, label, count(*) AS n, CAST(sum(key) AS BIGINT) AS keys FROM (SELECT *, row_number() OVER (PARTITION BY trigger_id, label ORDER BY {H}, key) AS rn FROM st) WHERE rn <= 40 AND trigger_id < (SELECT count(*) // 500 FROM st) GROUP BY 1, 2")
def flagship(spark, sf_dir):
    """Amount trigger, then the same number of samples of every label in each trigger's training set."""
    from pyspark.sql import Window

    from accrete.operators.triggers import amount_trigger
    from accrete.plans.tables import EVERY, stream

    fired = amount_trigger(stream(spark, sf_dir), EVERY).where("trigger_id is not null")
    w = Window.partitionBy("trigger_id", "label").orderBy(hash_rank(42, "key"), "key")
    return fired.withColumn("rn", F.row_number().over(w)).where("rn <= 40").groupBy("trigger_id", "label").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))
