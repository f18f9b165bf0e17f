"""Queries of set operations, models, losses, batches and labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from accrete.functions import arrays
from accrete.operators import models
from accrete.plans.registry import query
from accrete.plans.tables import STATE, STREAM, events, load, state, stream


@query("sk13_delta_roundtrip", "SELECT vec_id, 0.0::DOUBLE AS error FROM embeddings WHERE vec_id > 0")
def delta_roundtrip(spark, sf_dir):
    """Each vector is stored as the difference to the one before, and restored."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("w"))
    base = e.select((F.col("vec_id") + 1).alias("vec_id"), "w")
    back = models.add(models.subtract(e, base, "vec_id", "w"), base, "vec_id", "w").withColumnRenamed("w", "_back")
    worst = F.array_max(F.zip_with("w", "_back", lambda a, b: F.abs(a - b)))
    return e.join(back, "vec_id").select("vec_id", F.round(worst, 6).alias("error"))


@query("f20_xor_roundtrip", "SELECT doc_id, true AS same FROM documents")
def xor_roundtrip(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).cast("binary").alias("a"), F.sha2(F.reverse("text"), 256).cast("binary").alias("b"))
    return d.select("doc_id", (models.xor_restore(models.xor_delta("a", "b"), "b") == F.col("a")).alias("same"))


CHAIN = "WITH m AS (SELECT o_orderkey AS id_model, o_custkey AS pipeline, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders), w AS (SELECT *, max(CASE WHEN i % 4 = 0 THEN id_model END) OVER (PARTITION BY pipeline ORDER BY id_model) AS whole FROM m), p AS (SELECT id_model, CASE WHEN whole <> id_model THEN whole END AS parent FROM w)\n"


def chain(spark, sf_dir):
    return models.parents(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id_model"), F.col("o_custkey").alias("pipeline")), 4)


@query("sk14_parents", CHAIN + "SELECT id_model, coalesce(parent, -1) AS parent FROM p")
def parents(spark, sf_dir):
    return chain(spark, sf_dir).select("id_model", F.coalesce("parent", F.lit(-1)).alias("parent"))


@query("sk14_deletable", CHAIN + "SELECT id_model FROM p WHERE id_model NOT IN (SELECT parent FROM p WHERE parent IS NOT NULL)")
def deletable(spark, sf_dir):
    return models.deletable(chain(spark, sf_dir)).select("id_model")


@query("a26_average_loss", STATE + "SELECT trigger_id, round(avg(value), 6) AS loss FROM st GROUP BY 1")
def average_loss(spark, sf_dir):
    return state(spark, sf_dir).groupBy("trigger_id").agg(F.round(F.avg("value"), 6).alias("loss"))


@query("a27_last_write_wins", STREAM + "SELECT user_id, arg_max(value, idx) AS value FROM s GROUP BY 1")
def last_write(spark, sf_dir):
    return stream(spark, sf_dir).groupBy("user_id").agg(F.max_by("value", "idx").alias("value"))


@query("j14_membership", "SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AS member FROM orders")
def membership(spark, sf_dir):
    """Ids come as one list column a segment, as in a file of lists."""
    lists = load(spark, sf_dir, "customer").groupBy("c_mktsegment", F.floor(F.col("c_custkey") / 100)).agg(F.array_join(F.collect_list(F.col("c_custkey").cast("string")), " ").alias("ids"))
    ids = lists.where("c_mktsegment = 'BUILDING'").select(F.explode(F.split("ids", " ")).alias("o_custkey")).select(F.col("o_custkey").cast("long").alias("o_custkey")).distinct().withColumn("_k", F.lit(True))
    return load(spark, sf_dir, "orders").join(ids, "o_custkey", "left").select("o_orderkey", F.coalesce("_k", F.lit(False)).alias("member"))


@query("j13_metadata_joins", "SELECT l_orderkey, l_linenumber, p_brand, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size > 10")
def metadata(spark, sf_dir):
    li, p, s = (load(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    return li.join(p.where("p_size > 10"), li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey).select("l_orderkey", "l_linenumber", "p_brand", "s_name")


@query("j15_totals", "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 9) AS share FROM orders")
def totals(spark, sf_dir):
    share = F.col("o_totalprice") / F.sum("o_totalprice").over(Window.partitionBy("o_custkey"))
    return load(spark, sf_dir, "orders").select("o_orderkey", F.round(share, 9).alias("share"))


@query("u1_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(spark, sf_dir):
    return load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).unionByName(load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query("u2_union_labels", STATE + "SELECT DISTINCT label FROM st WHERE trigger_id IN (0, 1)")
def union_labels(spark, sf_dir):
    st = state(spark, sf_dir)
    return st.where("trigger_id = 0").select("label").union(st.where("trigger_id = 1").select("label")).distinct()


@query("u3_difference", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 48")
def difference(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey").subtract(load(spark, sf_dir, "lineitem").where("l_quantity > 48").select("l_partkey"))


@query("f15_outer_product", "SELECT vec_id, round(list_sum([CAST(a AS DOUBLE) FOR a IN embedding[1:3]]) * list_sum([CAST(b AS DOUBLE) FOR b IN embedding[4:6]]), 6) AS total FROM embeddings")
def outer(spark, sf_dir):
    d = lambda a, n: F.transform(F.slice("embedding", a, n), lambda x: x.cast("double"))
    return load(spark, sf_dir, "embeddings").select("vec_id", F.round(arrays.total(arrays.outer(d(1, 3), d(4, 3))), 6).alias("total"))


@query("f23_top_k", "SELECT vec_id, CAST(list_grade_up(list_transform(embedding, lambda v: -v))[1] - 1 AS BIGINT) AS first, CAST(list_grade_up(list_transform(embedding, lambda v: -v))[2] - 1 AS BIGINT) AS second FROM embeddings")
def top_k(spark, sf_dir):
    best = arrays.top_k(F.col("embedding"), 2)
    return load(spark, sf_dir, "embeddings").select("vec_id", F.get(best, F.lit(0)).cast("long").alias("first"), F.get(best, F.lit(1)).cast("long").alias("second"))


@query("f16_cosine_to_first", "WITH f AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(0.5 + 0.5 * list_cosine_similarity([CAST(v AS DOUBLE) FOR v IN embedding], [CAST(v AS DOUBLE) FOR v IN e]), 6) AS similarity FROM embeddings, f")
def cosine(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    first = F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("_e")))  # one row
    return e.join(first).select("vec_id", F.round(arrays.cosine_half(F.col("embedding"), F.col("_e")), 6).alias("similarity"))


@query("pf11_composite_model", STREAM + "SELECT user_id, 'current' AS variant, count(*) AS n FROM s WHERE label >= 2 GROUP BY 1 UNION ALL SELECT user_id, 'trained' AS variant, count(*) AS n FROM s WHERE label <= 2 GROUP BY 1")
def composite(spark, sf_dir):
    e = events(spark, sf_dir)
    pick = lambda flag, name: e.where(flag).groupBy("user_id").agg(F.count("*").alias("n")).withColumn("variant", F.lit(name))
    return pick("label >= 2", "current").unionByName(pick("label <= 2", "trained")).select("user_id", "variant", "n")


@query("sc32_per_class", STATE + "SELECT key, timestamp FROM st WHERE trigger_id = 0 AND label = 2")
def per_class(spark, sf_dir):
    return state(spark, sf_dir).where("trigger_id = 0 and label = 2").select("key", "timestamp")


@query("j3_key_weight", STATE + "SELECT key, label, round(1.0 / (key % 9 + 1), 6) AS weight FROM st WHERE trigger_id = 1")
def key_weight(spark, sf_dir):
    st = state(spark, sf_dir)
    weights = st.where("trigger_id = 1").select("key", F.round(1.0 / (F.col("key") % 9 + 1), 6).alias("weight"))
    return st.join(weights, "key").select("key", "label", "weight")
