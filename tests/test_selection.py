import pytest

from accrete.operators import selection
from accrete.operators.ordering import global_row_number, worker_split


@pytest.mark.parametrize(
    ("capacity", "sizes", "share"),
    [(1000, [10, 15, 30], 333), (100, [30, 50, 40, 28], 25), (100, [30, 50, 40, 21], 26), (100, [30, 50, 40, 20], 26), (100, [30, 50, 40, 19], 27), (200, [30, 80, 90, 28], 71), (60, [10, 10, 100], 40)],
)
def test_fair_share(capacity, sizes, share):
    assert selection.fair_share(sizes, capacity) == share


def test_fair_share_compat():
    assert selection.fair_share([10, 10, 100], 60, compat=True) == 30


def state(spark):
    rows = [(i, 1000 + i // 3, i % 4 if i < 100 else 0, i // 50) for i in range(150)]
    return spark.createDataFrame(rows, "key long, timestamp long, label long, trigger_id long")


def test_places(spark):
    got = global_row_number(state(spark).repartition(5), "timestamp", "key").collect()
    assert sorted(r["idx"] for r in got) == list(range(150))
    assert all(r["idx"] == r["key"] for r in got)
    assert global_row_number(state(spark).limit(0), "key").count() == 0


@pytest.mark.parametrize(("n", "workers"), [(13, 5), (9, 3), (3, 5), (150, 7)])
def test_worker_split(spark, n, workers):
    rows = worker_split(state(spark).where(f"key < {n}"), workers).groupBy("worker_id").count().collect()
    sizes = {r["worker_id"]: r["count"] for r in rows}
    assert [sizes.get(w, 0) for w in range(workers)] == [n // workers + (w < n % workers) for w in range(workers)]


def test_balanced(spark):
    counts = {r["label"]: r["count"] for r in selection.balanced(state(spark), "label", 80).groupBy("label").count().collect()}
    assert counts == {0: 20, 1: 20, 2: 20, 3: 20}
    assert selection.balanced(state(spark), "label", 1000, force="column").groupBy("label").count().select("count").distinct().count() == 1


def test_freshness(spark):
    used = state(spark).where("trigger_id = 0")
    got = selection.freshness(state(spark), used, 50, None).groupBy("used").count().collect()
    assert {r["used"]: r["count"] for r in got} == {True: 50, False: 50}
    got = selection.freshness(state(spark), used, 25, 40).groupBy("used").count().collect()
    assert {r["used"]: r["count"] for r in got} == {True: 30, False: 10}


def test_schedule():
    assert [selection.scheduled([0, 3, 5], t) for t in (0, 2, 3, 9)] == [1, 1, 2, 3]
    with pytest.raises(ValueError):
        selection.scheduled([3, 3], 0)
