"""Text, JSON and time functions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from accrete.functions import text
from accrete.operators import evaluation, runlog
from accrete.plans.registry import query
from accrete.plans.tables import STREAM, load, stream


@query("f1_one_line", r"SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'), ' ') AS line FROM documents")
def one_line(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.one_line(F.col("text")).alias("line"))


@query("f2_first_token", r"SELECT split_part(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'), ' '), ' ', 1) AS token, count(*) AS n FROM documents GROUP BY 1")
def first_token(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy(text.first_token(F.col("text")).alias("token")).agg(F.count("*").alias("n"))


@query("f3_padded_ids", "SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 9, '0') || '_' || p_brand AS id FROM part")
def padded(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", F.concat(text.padded(F.col("p_partkey"), 9), F.lit("_"), F.col("p_brand")).alias("id"))


@query("f5_joined_cells", "SELECT c_custkey, concat_ws(',', c_name, CAST(c_nationkey AS VARCHAR), c_mktsegment) AS cells FROM customer")
def cells(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(",", "c_name", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("cells"))


@query("f6_path_parts", r"SELECT page_id, regexp_replace(regexp_replace(url, '^.*/', ''), '\.[^.]*$', '') AS stem, regexp_extract(url, '(\.[^./]*)$', 1) AS extension FROM pages")
def path_parts(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", text.stem(F.col("url")).alias("stem"), text.extension(F.col("url")).alias("extension"))


@query("f7_durations", "SELECT c_custkey, (c_custkey % 90) * CASE c_custkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600 WHEN 3 THEN 86400 WHEN 4 THEN 604800 ELSE 31536000 END AS seconds FROM customer")
def durations(spark, sf_dir):
    shown = F.concat((F.col("c_custkey") % 90).cast("string"), F.substr(F.lit("smhdwy"), (F.col("c_custkey") % 6 + 1).cast("int"), F.lit(1)))
    return load(spark, sf_dir, "customer").select("c_custkey", evaluation.seconds_column(shown).alias("seconds"))


@query("f9_periods", "SELECT CAST(floor(epoch(date_trunc('day', ts))) AS BIGINT) AS day, count(*) AS n, count(DISTINCT date_trunc('hour', ts)) AS hours FROM events GROUP BY 1")
def periods(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy(F.unix_seconds(F.date_trunc("day", "t")).alias("day")).agg(F.count("*").alias("n"), F.countDistinct(F.date_trunc("hour", "t")).alias("hours"))


@query("f10_year_as_day", "SELECT o_orderkey, (year(o_orderdate) - 1970) * 86400 + 1 AS day FROM orders")
def year_as_day(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", text.year_as_day(F.col("o_orderdate")).alias("day"))


@query("f20_runs", STREAM + "SELECT CAST(run AS BIGINT) AS run, label, count(*) AS n FROM (SELECT label, sum(new) OVER (ORDER BY idx) - 1 AS run FROM (SELECT *, CASE WHEN lag(label) OVER (ORDER BY idx) IS DISTINCT FROM label THEN 1 ELSE 0 END AS new FROM s)) GROUP BY 1, 2")
def runs(spark, sf_dir):
    return runlog.rle(stream(spark, sf_dir).select("idx", "label"), "idx", "label")


@query("f24_majority", "SELECT event_id, (CAST(value > 10 AS INT) + CAST(user_id % 2 = 0 AS INT) + CAST(event_type = 'click' AS INT)) * 2 > 3 AS fired FROM events")
def majority(spark, sf_dir):
    from accrete.operators.triggers import majority as most

    m = F.create_map(F.lit("value"), F.col("value") > 10, F.lit("user"), F.col("user_id") % 2 == 0, F.lit("type"), F.col("event_type") == "click")
    return load(spark, sf_dir, "events").select("event_id", most(m).alias("fired"))


@query("f25_json", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def json(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.from_json("props", "k long")["k"]).alias("k"))


@query("f27_pivot", "SELECT c_nationkey, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building, count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS machinery FROM customer GROUP BY 1")
def pivot(spark, sf_dir):
    counts = load(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    got = runlog.metric_pivot(counts, "c_nationkey", "c_mktsegment", ["BUILDING", "MACHINERY"], "n")
    return got.select("c_nationkey", F.coalesce("BUILDING", F.lit(0)).alias("building"), F.coalesce("MACHINERY", F.lit(0)).alias("machinery"))


@query("pf8_frequent_classes", "SELECT p_partkey FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) >= 10)")
def frequent(spark, sf_dir):
    return runlog.frequent(load(spark, sf_dir, "part"), "p_brand", 10).select("p_partkey")


@query("pf12_dense_labels", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS label FROM part")
def dense_labels(spark, sf_dir):
    """Labels by sorted value: ranked among the distinct values, a list of classes, and joined back."""
    from pyspark.sql import Window

    p = load(spark, sf_dir, "part")
    classes = p.select("p_brand").distinct().withColumn("label", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("p_brand")).cast("long") - 1)
    return p.join(classes, "p_brand").select("p_partkey", "label")


@query("pf13_linearized", "SELECT c_custkey, CAST(dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS BIGINT) AS new_id FROM customer")
def linearized(spark, sf_dir):
    return runlog.linearized(load(spark, sf_dir, "customer"), "c_nationkey", "c_custkey").select("c_custkey", F.col("new_id").cast("long").alias("new_id"))


@query("sc38_page_titles", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def titles(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("w10_fractional_place", STREAM + ", d AS (SELECT (timestamp - 1704067200) // 86400 AS day, min(timestamp) AS a FROM s GROUP BY 1), p AS (SELECT day, a, lead(a) OVER (ORDER BY day) AS b FROM d) SELECT key, round(p.day + (s.timestamp - a)::DOUBLE / (coalesce(b, a + 86400) - a), 6) AS place FROM s JOIN p ON (s.timestamp - 1704067200) // 86400 = p.day")
def places(spark, sf_dir):
    """Where a sample lies between its period's first sample and the next period's; one row a period in the window."""
    from pyspark.sql import Window

    from accrete.plans.tables import events

    e = events(spark, sf_dir).withColumn("day", F.floor((F.col("timestamp") - 1704067200) / 86400))
    periods = e.groupBy("day").agg(F.min("timestamp").alias("a"))
    periods = periods.withColumn("b", F.coalesce(F.lead("a").over(Window.partitionBy(F.lit(0)).orderBy("day")), F.col("a") + 86400))
    return e.join(periods, "day").select("key", F.round(F.col("day") + (F.col("timestamp") - F.col("a")) / (F.col("b") - F.col("a")), 6).alias("place"))
