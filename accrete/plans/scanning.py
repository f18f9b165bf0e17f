"""Catalog queries: orders are files, line items are samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from accrete.operators import catalog
from accrete.operators.ordering import global_row_number, worker_split
from accrete.plans.registry import query
from accrete.plans.tables import STREAM, events, files, load, samples

FILES = """
WITH f AS (SELECT o_orderkey AS file_id, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS updated_at, n AS number_of_samples
           FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey),
sa AS (SELECT l_orderkey * 10 + l_linenumber AS key, l_orderkey AS file_id, CAST(l_linenumber AS BIGINT) AS sample_index, CAST(ascii(l_returnflag) AS BIGINT) AS label FROM lineitem)
"""
FROM, TO = 900_000_000, 950_000_000


@query("sc16_point_get", FILES + "SELECT key, label, sample_index FROM sa WHERE file_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def point_get(spark, sf_dir):
    filled = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("file_id"))
    keys = samples(spark, sf_dir).join(filled, "file_id", "left_semi").select("key").distinct()
    return catalog.get(samples(spark, sf_dir), keys).select("key", "label", "sample_index")


@query("sc17_new_data_since", FILES + f"SELECT key, label, updated_at AS timestamp FROM sa JOIN f USING (file_id) WHERE updated_at >= {TO}")
def since(spark, sf_dir):
    return catalog.scan_since(samples(spark, sf_dir), files(spark, sf_dir), TO)


@query("sc18_data_in_interval", FILES + f"SELECT key, label, updated_at AS timestamp FROM sa JOIN f USING (file_id) WHERE updated_at BETWEEN {FROM} AND {TO}")
def interval(spark, sf_dir):
    return catalog.scan_interval(samples(spark, sf_dir), files(spark, sf_dir), FROM, TO)


@query("sc19_data_per_worker", STREAM + "SELECT worker_id, count(*) AS n, min(key) AS min_key, max(key) AS max_key FROM (SELECT key, CAST(ntile(7) OVER (ORDER BY key) - 1 AS BIGINT) AS worker_id FROM s) GROUP BY 1")
def per_worker(spark, sf_dir):
    return worker_split(events(spark, sf_dir), 7).groupBy("worker_id").agg(F.count("*").alias("n"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))


@query("sc20_dataset_size", FILES + f"SELECT CAST(coalesce(sum(number_of_samples), 0) AS BIGINT) AS n FROM f WHERE updated_at >= {FROM} AND updated_at < {TO}")
def size(spark, sf_dir):
    return catalog.dataset_size(files(spark, sf_dir), FROM, TO)


@query("sc20_dataset_size_empty", "SELECT CAST(0 AS BIGINT) AS n")
def size_empty(spark, sf_dir):
    return catalog.dataset_size(files(spark, sf_dir), 10, 20)


@query("sc21_availability", "SELECT 'F' AS name, count(*) > 0 AS available FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'none' AS name, count(*) > 0 FROM orders WHERE o_orderstatus = 'none'")
def available(spark, sf_dir):
    asked = spark.createDataFrame([("F",), ("none",)], "name string")
    known = load(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("name")).distinct().withColumn("_k", F.lit(True))
    return asked.join(known, "name", "left").select("name", F.coalesce("_k", F.lit(False)).alias("available"))


@query("sc22_register_upsert", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'changed' ELSE c_mktsegment END AS segment FROM customer")
def upsert(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    shown = c.select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return catalog.upsert(shown, c.where("c_acctbal < 0").select("c_custkey", F.lit("changed").alias("segment")), "c_custkey")


@query("sc24_delete_recount", FILES + "SELECT file_id, count(*) AS number_of_samples FROM sa WHERE key NOT IN (SELECT key FROM sa WHERE label = 82) GROUP BY 1")
def delete(spark, sf_dir):
    s = samples(spark, sf_dir)
    return catalog.recount(catalog.delete_samples(s, s.where("label = 82").select("key").distinct()))


@query("sc13_ingest_new_files", FILES + f"SELECT CAST(file_id AS VARCHAR) AS path, updated_at FROM f WHERE updated_at >= {FROM} AND file_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def ingest(spark, sf_dir):
    listed = files(spark, sf_dir).select(F.col("file_id").cast("string").alias("path"), "updated_at")
    known = load(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").cast("string").alias("path"))
    return catalog.new_files(listed, known, FROM)


@query("a3_distinct_files", FILES + "SELECT label, count(DISTINCT file_id) AS n_files FROM sa GROUP BY 1")
def distinct_files(spark, sf_dir):
    return samples(spark, sf_dir).groupBy("label").agg(F.countDistinct("file_id").alias("n_files"))


@query("k6_slice", STREAM + "SELECT key, timestamp FROM s WHERE idx >= 100 AND idx < 350")
def slice_of(spark, sf_dir):
    return global_row_number(events(spark, sf_dir), "timestamp", "key").where("idx >= 100 and idx < 350").select("key", "timestamp")


@query("k10_latest", FILES + "SELECT max(updated_at) AS last FROM f")
def latest(spark, sf_dir):
    return files(spark, sf_dir).agg(F.max("updated_at").alias("last"))


@query("s7_new_at_boundary", STREAM + "SELECT key, timestamp FROM s WHERE timestamp >= 1705000000 AND key NOT IN (SELECT key FROM s WHERE timestamp < 1705000000 OR label = 0)")
def boundary(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.where("timestamp >= 1705000000").join(e.where("timestamp < 1705000000 or label = 0").select("key"), "key", "left_anti").select("key", "timestamp")
