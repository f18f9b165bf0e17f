from pyspark.sql import functions as F

from accrete.operators import drift


def stream(spark, n=60):
    return spark.range(n).select(F.col("id").alias("idx"), (F.col("id") * 10).alias("timestamp"), F.when(F.col("id") < 30, 0.0).otherwise(5.0).alias("x"))


def places(df):
    return sorted(r["idx"] for r in df.collect())


def test_amount_windows(spark):
    s = stream(spark)
    current, reference = drift.amount_windows(s, 19, 14, 10, 8)
    assert places(current) == list(range(15, 20))
    assert places(reference) == list(range(7, 15))
    current, _ = drift.amount_windows(s, 19, 14, 10, 8, overlap=True)
    assert places(current) == list(range(10, 20))
    assert places(drift.amount_windows(s, 19, None, 3, 8)[1]) == []


def test_time_windows(spark):
    current, reference = drift.time_windows(stream(spark), 19, 14, 30, 40)
    assert places(current) == [16, 17, 18, 19]
    assert places(reference) == [10, 11, 12, 13, 14]


def test_drift_trigger(spark):
    s = stream(spark)

    def distance(current, reference):
        return current.agg(F.avg("x").alias("a")).join(reference.agg(F.avg("x").alias("b"))).select(F.abs(F.col("a") - F.col("b")).alias("distance"))

    got = drift.drift_trigger(s, 10, distance, lambda d, _: d > 1, lambda end, last: drift.amount_windows(s, end, last, 10, 10))
    assert [(end, fired) for end, _, fired in got] == [(9, True), (19, False), (29, False), (39, True), (49, False), (59, False)]


def test_performance_trigger():
    got = drift.performance_trigger(enumerate([0.9, 0.9, 0.7, 0.7, 0.5]), [drift.below(0.5), drift.drop_from_mean(5, 0.15)])
    assert [fired for _, fired in got] == [False, False, True, False, True]
    decide = drift.quantile_decision(3, 0.5)
    assert [decide(v, s) for v, s in ((1, []), (2, [1]), (2, [1, 2, 3]))] == [True, True, False]


def test_drop_from_mean_at_the_border():
    """Decisions 0.02 below the mean are those of a running total, as the query's SQL keeps it."""
    import random

    import duckdb

    r = random.Random(3)
    accuracies = [0.16, 0.22, 0.23, 0.23, 0.19] + [round(r.gauss(20, 2)) / 100 for _ in range(5000)]
    con = duckdb.connect()
    con.execute("create table a as select unnest(range(len($1))) as chunk, unnest($1::double[]) as acc", [accuracies]).fetchall()
    expected = con.sql("""WITH RECURSIVE f AS (SELECT chunk, false AS fired, acc AS total, 1 AS n FROM a WHERE chunk = 0
      UNION ALL SELECT chunk, low, CASE WHEN low THEN 0 ELSE total + acc END, CASE WHEN low THEN 0 ELSE n + 1 END
      FROM (SELECT a.chunk, acc, total, n, n > 0 AND total / greatest(n, 1) - acc >= 0.02::DOUBLE AS low FROM f JOIN a ON a.chunk = f.chunk + 1))
    SELECT chunk, fired FROM f ORDER BY chunk""").fetchall()
    assert drift.performance_trigger(enumerate(accuracies), [drift.drop_from_mean(1 << 30, 0.02)]) == expected
