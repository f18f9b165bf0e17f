"""Queries that write tables and files to the shared folder and read them back: nations are CSV rows, events a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from accrete.operators import selection
from accrete.plans.registry import query
from accrete.plans.tables import STATE, STREAM, events, load, samples, state
from accrete.plans.scanning import FILES
from accrete.session import ensure_checkpoint_dir
from accrete.sources import files as sources

NATIONS = "WITH n AS (SELECT n_nationkey AS i, n_regionkey AS label, n_nationkey || ',' || n_name AS payload FROM nation)\n"


def folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def csv_nations(spark, sf_dir):
    path = folder(spark)
    n = load(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name", F.col("n_nationkey").alias("at"))
    sources.write_rows(n, path, "n_regionkey")
    return sources.read_samples("csv", spark, path, 3, 0).select(F.col("sample_index").alias("i"), "label", F.col("payload").cast("string").alias("payload"))


@query("sc1_csv_source", NATIONS + "SELECT i, label, payload FROM n")
def csv_source(spark, sf_dir):
    return csv_nations(spark, sf_dir)


@query("sc2_csv_pick", NATIONS + "SELECT i, payload FROM n WHERE i IN (0, 7, 24)")
def csv_pick(spark, sf_dir):
    return sources.pick(csv_nations(spark, sf_dir).withColumnRenamed("i", "sample_index"), [7, 0, 24, 7]).select(F.col("sample_index").alias("i"), "payload")


@query("sc3_csv_labels", NATIONS + "SELECT label, count(*) AS n FROM n GROUP BY 1")
def csv_labels(spark, sf_dir):
    return csv_nations(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


@query("sc4_csv_delete", NATIONS + "SELECT i - (i > 3)::BIGINT - (i > 10)::BIGINT AS i, payload FROM n WHERE i NOT IN (3, 10)")
def csv_delete(spark, sf_dir):
    return sources.without(csv_nations(spark, sf_dir).withColumnRenamed("i", "sample_index"), [10, 3]).select(F.col("sample_index").alias("i"), "payload")


@query("sc8_drop_empty_files", FILES + "SELECT f.file_id FROM f WHERE EXISTS (SELECT 1 FROM sa WHERE sa.file_id = f.file_id AND sample_index > 2)")
def drop_empty(spark, sf_dir):
    from accrete.plans.tables import files

    sa = samples(spark, sf_dir)
    return sources.drop_empty_files(files(spark, sf_dir), sa, sa.where("sample_index <= 2"))[0].select("file_id")


@query("sc23_delete_dataset", FILES + "SELECT count(*) AS n_samples, count(DISTINCT file_id) AS n_files FROM sa JOIN orders ON o_orderkey = file_id WHERE o_orderstatus <> 'F'")
def delete_dataset(spark, sf_dir):
    kept = load(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("file_id"))
    return samples(spark, sf_dir).join(kept, "file_id", "left_semi").agg(F.count("*").alias("n_samples"), F.countDistinct("file_id").alias("n_files"))


@query("sc37_json_lines", "SELECT conv_id, turn, role, text FROM conversations")
def json_lines(spark, sf_dir):
    path = folder(spark)
    sources.append_log(load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), path)
    schema = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").schema.simpleString()[7:-1].replace(":", " ")
    return sources.json_lines(spark, path, schema).select("conv_id", "turn", "role", "text")


@query("sk1_selector_samples", STATE + "SELECT trigger_id, count(*) AS n, CAST(sum(key) AS BIGINT) AS keys, count(DISTINCT label) AS labels FROM st WHERE trigger_id = 1 GROUP BY 1")
def selector_samples(spark, sf_dir):
    path, st = folder(spark), state(spark, sf_dir).withColumn("pipeline_id", F.lit(1))
    for trigger in (0, 1):
        sources.append_state(st.where(F.col("trigger_id") == trigger), path)
    got = spark.read.parquet(path).where("pipeline_id = 1 and trigger_id = 1")
    return got.groupBy(F.col("trigger_id").cast("long").alias("trigger_id")).agg(F.count("*").alias("n"), F.sum("key").alias("keys"), F.countDistinct("label").alias("labels"))


PARTS = STATE + ", p AS (SELECT *, (row_number() OVER (PARTITION BY trigger_id ORDER BY timestamp, key) - 1) // 128 AS partition_id FROM st)\n"


def written(spark, sf_dir):
    path, st = folder(spark), state(spark, sf_dir)
    following = 0
    for trigger in (0, 1):
        following = selection.run_trigger(st, path, following, lambda s, t=trigger: selection.new_data(s, t), 128)
    return path


@query("sel1_trigger_sets", PARTS + "SELECT trigger_id, partition_id, count(*) AS n, CAST(sum(key) AS BIGINT) AS keys FROM p WHERE trigger_id <= 1 GROUP BY 1, 2")
def trigger_sets(spark, sf_dir):
    got = spark.read.parquet(written(spark, sf_dir))
    return got.groupBy(F.col("trigger_id").cast("long").alias("trigger_id"), F.col("partition_id").cast("long").alias("partition_id")).agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


@query("sc30_trigger_partition", PARTS + "SELECT key FROM p WHERE trigger_id = 1 AND partition_id = 2")
def trigger_partition(spark, sf_dir):
    return sources.read_training_set(spark, written(spark, sf_dir), 1, 2).select("key")


@query("sk4_worker_range", PARTS + "SELECT key FROM (SELECT key, row_number() OVER (ORDER BY key) - 1 AS i FROM p WHERE trigger_id = 0) WHERE i BETWEEN 100 AND 249")
def worker_range(spark, sf_dir):
    from accrete.operators.ordering import global_row_number

    placed = global_row_number(sources.read_training_set(spark, written(spark, sf_dir), 0).select("key"), "key")
    return placed.where("idx between 100 and 249").select("key")


@query("sk8_stage_log", STREAM + "SELECT label, count(*) AS n FROM s WHERE idx < 900 GROUP BY 1")
def stage_log(spark, sf_dir):
    from accrete.plans.tables import stream

    path, rows = folder(spark), stream(spark, sf_dir).select("idx", "label")
    for start in (0, 300, 600):
        sources.append_log(rows.where((F.col("idx") >= start) & (F.col("idx") < start + 300)), path)
    return sources.json_lines(spark, path, "idx long, label long").groupBy("label").agg(F.count("*").alias("n"))


@query("sk10_training_losses", STATE + "SELECT trigger_id, count(*) AS n, round(avg(value), 6) AS loss FROM st WHERE value > 10 GROUP BY 1")
def training_losses(spark, sf_dir):
    path = folder(spark)
    sources.append_losses(state(spark, sf_dir).select("key", "trigger_id", F.when(F.col("value") > 10, F.col("value")).alias("loss")), path)
    return spark.read.parquet(path).groupBy("trigger_id").agg(F.count("*").alias("n"), F.round(F.avg("loss"), 6).alias("loss"))


@query("sk11_period_files", STREAM + "SELECT (timestamp - 1704067200) // 604800 AS period, count(*) AS n, CAST(sum(key) AS BIGINT) AS keys FROM s GROUP BY 1")
def period_files(spark, sf_dir):
    path = folder(spark)
    sources.write_periods(events(spark, sf_dir).select("key", "label", F.floor((F.col("timestamp") - 1704067200) / 604800).alias("period")), path, "period")
    got = spark.read.csv(path, sep="\t", schema="key long, label long, period long")
    return got.groupBy("period").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))
