import pytest

from accrete.operators import evaluation, triggers


def series(spark, values):
    return spark.createDataFrame(list(enumerate(map(float, values))), "chunk long, score double")


def fired(df):
    return [r["fired"] for r in df.orderBy("chunk").collect()]


def test_quantile_first_fires(spark):
    got = fired(triggers.dynamic_quantile(series(spark, [5, 11, 15, 10, 20]), 3, 0.5))
    assert got == [True, True, True, False, True]


def test_quantile_at_the_line(spark):
    """Decisions on scores that lie on the line are those of quantile_cont; the numbers are of a table where they weren't."""
    import math
    import random

    import duckdb
    from pyspark.sql import functions as F

    from accrete.functions.arrays import fused

    r = random.Random(0)
    past = [1.6] * 3 + [1.6, 1.6, 1.6, 2.4, 2.4, 1.8, 2.18, 2.18, 2.18, 2.18, 2.18, 2.18, 2.2, 2.2, 2.185]
    values = past + [r.randrange(0, 12) / 5 for _ in range(3000)] + [round(r.uniform(1.9, 2.1), 3) for _ in range(1000)]
    con = duckdb.connect()
    con.execute("create table s as select unnest(range(len($1))) as chunk, unnest($1::double[]) as score", [values]).fetchall()
    sql = "select score > quantile_cont(score, {q}) over (order by chunk rows between {k} preceding and 1 preceding) from s order by chunk"
    for k, q in ((8, 0.75), (2, 0.75), (5, 0.3)):
        expected = [f for (f,) in con.sql(sql.format(k=k, q=q)).fetchall()]
        assert fired(triggers.dynamic_quantile(series(spark, values), k, q)) == [True, *expected[1:]]
    numbers = [(r.uniform(-3, 3), r.random(), r.uniform(-3, 3)) for _ in range(2000)] + [(math.inf, 0.5, 1.0)]
    got = spark.createDataFrame(numbers, "a double, b double, c double").select("a", "b", "c", fused(F.col("a"), F.col("b"), F.col("c")).alias("x")).collect()
    assert all(row["x"] == float(math.inf if math.isinf(row["a"]) else _exactly(row["a"], row["b"], row["c"])) for row in got)


def _exactly(a, b, c):
    from fractions import Fraction

    return Fraction(a) * Fraction(b) + Fraction(c)


def test_rolling_average(spark):
    got = fired(triggers.rolling_average(series(spark, [10, 10, 13, 10]), 2, 0.2))
    assert got == [True, False, True, False]


def test_amount_keeps_the_rest_back(spark):
    stream = spark.range(10).selectExpr("id as key", "id as timestamp", "id as idx")
    got = triggers.amount_trigger(stream, 4).collect()
    assert [r["trigger_id"] for r in sorted(got, key=lambda r: r["key"])] == [0] * 4 + [1] * 4 + [None] * 2


def test_time_boundary_is_next_window(spark):
    stream = spark.createDataFrame([(0, 0), (1, 9), (2, 10), (3, 35)], "key long, timestamp long")
    got = {r["trigger_id"]: r["n"] for r in triggers.time_trigger_counts(stream, 10).collect()}
    assert got == {0: 2, 1: 1, 2: 0}


def test_ensemble_and_folds():
    fires = {"a": [3, 6, 9], "b": [4, 9]}
    assert triggers.ensemble(fires, all_of) == [4, 9]
    got = triggers.avoidable_misclassifications([(0, 5, 10), (1, 8, 10), (2, 1, 10)], 0.5, 3)
    assert got == [(0, 0.0, 0.0, False), (1, 3.0, 3.0, True), (2, 0.0, 0.0, False)]
    assert [f for _, _, f in triggers.cost_trigger([(0, 1.0), (1, 5.0), (2, 6.0)], lambda _: 4.0, 1.0)] == [False, True, False]


def all_of(decisions):
    return all(decisions.values())


def test_durations():
    assert evaluation.seconds("2d") == 172_800
    with pytest.raises(ValueError):
        evaluation.seconds("2M")
    assert evaluation.interval_of("(-2d; +0y]") == (-172_800.0, False, 0.0, True)


def test_auc_and_f1(spark):
    rows = spark.createDataFrame([(0, 0.1, "g"), (0, 0.4, "g"), (1, 0.35, "g"), (1, 0.8, "g")], "y long, score double, g string")
    assert evaluation.roc_auc(rows, ["g"]).first()["auc"] == pytest.approx(0.75)
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 2)], "y long, p long")
    got = evaluation.f1(rows, 3).first()
    assert got["f1_micro"] == pytest.approx(0.75)
    assert got["f1_macro"] == pytest.approx((2 / 3 + 2 / 3 + 1) / 3)


def test_requests(spark):
    intervals = spark.createDataFrame([(0, 5, 0), (5, 10, 5), (10, 20, 30)], "start long, end long, active_before long")
    models = spark.createDataFrame([(21, 2), (22, 6), (23, 25)], "id_model long, last_timestamp long")
    rows = evaluation.requests(intervals, models).collect()
    active = {r["start"]: r["id_model"] for r in rows if r["active"]}
    trained = {r["start"]: r["id_model"] for r in rows if r["trained"]}
    assert active == {5: 21, 10: 23}
    assert trained == {0: 21, 5: 22, 10: 23}


def test_mmd_is_near_the_mean_kernel(spark):
    import numpy as np
    from pyspark.sql import functions as F

    r = np.random.default_rng(0)
    a, b = r.normal(0, 1, (80, 4)), r.normal(0.8, 1, (80, 4))
    kernel = lambda x, y: np.exp(-((x[:, None] - y[None]) ** 2).sum(-1) / (2 * 2.0**2)).mean()
    exact = kernel(a, a) + kernel(b, b) - 2 * kernel(a, b)
    frame = lambda x: spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>")
    got = triggers.mmd(frame(a), frame(b), "v", 2.0, features=4096).first()["distance"]
    assert got == pytest.approx(exact, abs=0.03)
    same = triggers.mmd(frame(a), frame(a), "v", 2.0).select(F.round("distance", 9).alias("distance")).first()["distance"]
    assert same == 0
