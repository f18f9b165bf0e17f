"""Scoring and coreset queries over embeddings; the first ten numbers serve as logits."""

from __future__ import annotations

from pyspark.sql import functions as F

from accrete.operators import scoring
from accrete.plans.registry import query
from accrete.plans.tables import STREAM, events, load

L = "embedding[1:10]"
P = "WITH l AS (SELECT vec_id AS key, label, [CAST(v AS DOUBLE) FOR v IN embedding[1:10]] AS z FROM embeddings), e AS (SELECT *, [exp(v - list_max(z)) FOR v IN z] AS ex FROM l), p AS (SELECT *, [v / list_sum(ex) FOR v IN ex] AS p FROM e)\n"


def rows(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").cast("long").alias("label"), "embedding", F.slice("embedding", 1, 10).alias("logits"))


@query("dn1_loss_sample", STREAM + "SELECT key FROM s WHERE value > 0 ORDER BY -ln(((('0x' || substr(md5('7:' || key), 1, 8))::BIGINT) + 0.5) / 4294967296.0) / value, key LIMIT 90")
def loss(spark, sf_dir):
    return scoring.importance_sample(events(spark, sf_dir), "value", 90, 7).select("key")


@query("dn2_gradient_norm", P + "SELECT key, round(sqrt(list_sum([(p[i] - CASE WHEN i - 1 = label THEN 1 ELSE 0 END) ** 2 FOR i IN range(1, 11)])), 6) AS grad_norm FROM p")
def gradient_norm(spark, sf_dir):
    return scoring.with_gradient_norm(rows(spark, sf_dir), "logits", "label").select("key", F.round("grad_norm", 6).alias("grad_norm"))


@query("dn3_uncertainty", P + "SELECT key, round(CAST(list_max(z) AS DOUBLE), 6) AS least_confidence, round(list_sum([v * ln(v + 1e-6) FOR v IN p]), 6) AS entropy, round(list_reverse_sort(p)[1] - list_reverse_sort(p)[2], 6) AS margin FROM p")
def uncertainty(spark, sf_dir):
    got = scoring.with_uncertainty(rows(spark, sf_dir), "logits")
    return got.select("key", *[F.round(c, 6).alias(c) for c in ("least_confidence", "entropy", "margin")])


@query("dn3_least_margin", P + "SELECT key FROM p ORDER BY list_reverse_sort(p)[1] - list_reverse_sort(p)[2], key LIMIT 50")
def least_margin(spark, sf_dir):
    return scoring.with_uncertainty(rows(spark, sf_dir), "logits").orderBy("margin", "key").limit(50).select("key")


@query("dn4_rs2_replacement", STREAM + "SELECT key FROM s ORDER BY md5('3:' || key), key LIMIT 120")
def rs2(spark, sf_dir):
    return scoring.epoch_subset(events(spark, sf_dir), 120, 3, True).select("key")


@query("dn5_rs2_disjoint", STREAM + "SELECT key FROM (SELECT key, row_number() OVER (ORDER BY md5('0:' || key), key) AS rn FROM s) WHERE rn > 240 AND rn <= 360")
def rs2_disjoint(spark, sf_dir):
    return scoring.epoch_subset(events(spark, sf_dir), 120, 2, False).select("key")


@query("dn6_rho_top", STREAM + "SELECT key, round(value - label * 10, 6) AS rho FROM s ORDER BY value - label * 10 DESC, key LIMIT 40")
def rho(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("il", F.col("label") * 10.0)
    return scoring.rho_top(e, "value", "il", 40).select("key", F.round("rho", 6).alias("rho"))


@query("dn7_twin_losses", STREAM + "SELECT key, CASE WHEN key % 2 = 0 THEN value * 2 ELSE value * 3 END AS il FROM s")
def twin(spark, sf_dir):
    """Each half is scored by the model of the other half; here the two models are value * 3 (of even keys) and value * 2."""
    return events(spark, sf_dir).select("key", F.when(F.col("key") % 2 == 0, F.col("value") * 2).otherwise(F.col("value") * 3).alias("il"))


@query("dn15_weighted_loss", STREAM + "SELECT idx // 256 AS batch, round(sum(value * (label + 1)) / sum(label + 1), 6) AS loss FROM s GROUP BY 1")
def weighted_loss(spark, sf_dir):
    from accrete.plans.tables import stream

    return stream(spark, sf_dir).groupBy(F.floor(F.col("idx") / 256).alias("batch")).agg(F.round(F.sum(F.col("value") * (F.col("label") + 1)) / F.sum(F.col("label") + 1), 6).alias("loss"))


@query("dn14_class_distances", "WITH e AS (SELECT vec_id, label, [CAST(v AS DOUBLE) FOR v IN embedding] AS x FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(sqrt(list_sum([(a.x[i] - b.x[i]) ** 2 FOR i IN range(1, 65)])), 5) AS distance FROM e a JOIN e b ON a.vec_id < b.vec_id AND a.label = b.label")
def distances(spark, sf_dir):
    """All pairs inside each class; classes are the blocks within which coresets compare."""
    return scoring.class_distances(rows(spark, sf_dir), "key", "label", "embedding", 5)


def _coreset(kernel):
    def run(spark, sf_dir):
        got = scoring.coreset(rows(spark, sf_dir), kernel, 10, "key", "label", "embedding")
        return got.select("key", "label", F.round("weight", 6).alias("weight"))

    return run


for _id, _kernel in (("dn9", "k_center"), ("dn10", "grad_match"), ("dn11", "craig"), ("dn12", "facility_location"), ("dn12", "graph_cut"), ("dn12", "log_determinant")):
    query(f"{_id}_{_kernel}")(_coreset(_kernel))
