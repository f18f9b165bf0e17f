import numpy as np
from pyspark.sql import functions as F

from accrete.functions import arrays
from accrete.operators import scoring


def plain_distances(df):
    """The join that class_distances stands for."""
    a, b = df.withColumnsRenamed({"key": "a", "v": "_a"}), df.withColumnsRenamed({"key": "b", "v": "_b"})
    return a.join(b, "label").where("a < b").select("a", "b", F.round(arrays.euclidean(F.col("_a"), F.col("_b")), 5).alias("distance"))


def plain(rows):
    return sorted(repr(tuple(r)) for r in rows)


def test_class_distances(spark, monkeypatch):
    """Against the plain join: copies, near ties of the last digit, repeated and missing keys, and vectors that are null or of odd lengths."""
    monkeypatch.setattr(scoring, "MOST", 20)
    r = np.random.default_rng(0)
    rows = [(i, i % 3, r.normal(0, 1, 6).round(2).tolist()) for i in range(200)]
    rows += [(200 + i, 0, [0.0, 0.0, 0.0, 0.0, 0.0, (i + 0.5) / 100_000]) for i in range(20)]
    rows += [(7, 1, rows[7][2]), (None, 1, rows[8][2]), (301, None, rows[9][2]), (302, 1, None), (303, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    rows += [(304, 1, [1.0]), (305, 1, []), (306, 1, []), (307, 1, [float("nan")] * 6), (308, 2, [1e200] * 6), (309, 2, [3.0] * 6)]
    df = spark.createDataFrame(rows, "key long, label long, v array<double>")
    got = scoring.class_distances(df, "key", "label", "v", 5)
    assert plain(got.collect()) == plain(plain_distances(df).collect())
    assert scoring.class_distances(df.limit(0), "key", "label", "v", 5).count() == 0


def test_class_distances_come_in_batches_from_arrow(spark):
    """No join makes the pairs row by row: groups of two parts do, and no step keeps all pairs of a class."""
    df = spark.createDataFrame([(i, 0, [float(i)]) for i in range(9)], "key long, label long, v array<double>")
    got = scoring.class_distances(df, "key", "label", "v", 5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "SortMergeJoin" not in plan
    assert got.count() == 36


def test_rounded_distances_are_those_of_added_squares():
    r = np.random.default_rng(1)
    x, y = r.normal(0, 1, (300, 64)), r.normal(0, 1, (200, 64))
    x[:50] = y[:50] + 1e-7 * r.normal(0, 1, (50, 64))
    x[50:100] *= 1e6
    added = np.sqrt(sum((x[:, None, i] - y[None, :, i]) ** 2 for i in range(64)))
    assert (scoring.rounded_distances(x, y, 5) == scoring.rounded(added, 5)).all()
    assert scoring.rounded(np.array([0.000005, 1.0, 0.49999999999999994]), 0).tolist() == [0, 1, 0]


def plain_kernels(x, n):
    """The kernels written with whole matrices."""
    sq = (x * x).sum(1)
    d = np.sqrt(np.maximum(sq[:, None] + sq[None, :] - 2 * x @ x.T, 0))
    norms = np.linalg.norm(x, axis=1)
    cosine = 0.5 + 0.5 * (x @ x.T) / (norms[:, None] * norms[None, :])
    gains = {
        "craig": lambda c, s=d.max() - d: np.maximum(s - s[:, c].max(axis=1, initial=0)[:, None], 0).sum(0),
        "facility_location": lambda c: np.maximum(cosine - cosine[:, c].max(axis=1, initial=0)[:, None], 0).sum(0),
        "graph_cut": lambda c: cosine.sum(0) - 2 * cosine[:, c].sum(1) - np.diag(cosine),
        "log_determinant": lambda c, m=cosine + 1e-3 * np.eye(len(x)): np.diag(m) - ((m[c] * np.linalg.solve(m[np.ix_(c, c)], m[c])).sum(0) if c else 0),
    }
    return {name: scoring.greedy(gain, n, len(x)) for name, gain in gains.items()}


def test_kernels_hold_one_matrix():
    """Beside the matrix of similarities only strips of it are held, and the rows chosen are those of whole matrices."""
    import tracemalloc

    x = np.random.default_rng(2).normal(0, 1, (1001, 16))
    expected = plain_kernels(x, 20)
    for name, chosen in expected.items():
        tracemalloc.start()
        got, _ = scoring.KERNELS[name](x, 20)
        _, peak = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert got.tolist() == chosen
        assert peak < 1.6 * len(x) ** 2 * 8, (name, peak)


def swept(a, b, ridge, steps=300):
    """Coordinate descent weight by weight."""
    q, c = a.T @ a + ridge * np.eye(a.shape[1]), a.T @ b
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        for j in range(len(w)):
            w[j] = max(0.0, w[j] + (c[j] - q[j] @ w) / q[j, j])
    return w


def test_weights_are_those_of_sweeps():
    """Also where some stay at zero, and where 300 sweeps, or 7, don't reach the minimum."""
    r = np.random.default_rng(3)
    zeros = 0
    for i in range(60):
        a, b = r.normal(0, 0.5 if i % 2 else 3, (8, r.integers(1, 30))), r.normal(0, 3, 8)
        for steps in (7, 300):
            expected = swept(a, b, 1.0, steps)
            zeros += (expected == 0).sum()
            assert np.allclose(scoring._nonnegative(a, b, 1.0, steps), expected, rtol=0, atol=1e-10)
    assert zeros > 100


def test_grad_match_takes_few_seconds():
    """120 of 400 vectors took 300 * 120 * 121 / 2 steps in Python, more than 5 seconds."""
    import time

    x = np.random.default_rng(4).normal(0, 1, (400, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    start = time.process_time()
    chosen, weight = scoring.grad_match(x, 120)
    assert time.process_time() - start < 3 * len(set(chosen.tolist())) / 120
    assert np.allclose(weight, swept(x[chosen].T, x.sum(0), 1.0), rtol=0, atol=1e-9)


def whole_graph_cut(rows, ratio):
    """Graph cut with the matrix of each whole class, rows in order of keys."""
    got = []
    for label in {r[1] for r in rows if r[1] is not None}:
        part = sorted(r for r in rows if r[1] == label)
        x = np.array([r[2] for r in part])
        got += [(part[i][0], label, 1.0) for i in plain_kernels(x, scoring.target(len(part), ratio))["graph_cut"]]
    return sorted(got)


def test_graph_cut_sees_whole_classes(spark, monkeypatch):
    """Classes above MOST aren't cut, whether one task holds them (label 2) or all do, with pull (0) or nearly without (1)."""
    monkeypatch.setattr(scoring, "MOST", 20)
    monkeypatch.setattr(scoring, "OFFERS", 12, raising=False)
    r = np.random.default_rng(5)
    rows = [(i, 0, r.normal(0.7, 1, 6).round(2).tolist()) for i in range(200)]
    rows += [(1000 - i, 1, r.normal(0, 1, 6).round(2).tolist()) for i in range(90)]
    rows += [(2000 + i, 2, r.normal(0, 1, 6).round(2).tolist()) for i in range(60)] + [(3000, None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "key long, label long, v array<double>").repartition(3)
    got = scoring.coreset(df, "graph_cut", 10, "key", "label", "v")
    assert sorted(tuple(row) for row in got.collect()) == whole_graph_cut(rows, 10)


def test_graph_cut_takes_the_first_of_equal_rows(spark, monkeypatch):
    """Also where equal vectors lie in several tasks, and where vectors without length compete."""
    far = [(100 - i, 0, [1.0, 2.0, 0.5]) for i in range(30)] + [(200 + i, 0, [-1.0, 0.5, 3.0]) for i in range(12)]
    rows = far + [(300 + i, 0, [0.0, 0.0, 0.0]) for i in range(8)]
    x = np.array([r[2] for r in sorted(rows)])
    gain, left, pull = scoring.unit_rows(x), list(range(50)), 0.5 * scoring.unit_rows(x).sum(0)
    expected = []
    for _ in range(10):
        first = max(left, key=lambda i: (round(gain[i] @ pull - 0.5 * gain[i].any(), 9), -i))
        left.remove(first)
        pull, expected = pull - gain[first], [*expected, sorted(rows)[first][0]]
    df = spark.createDataFrame(rows, "key long, label long, v array<float>").repartition(5)
    for most in (4096, 4):
        monkeypatch.setattr(scoring, "MOST", most)
        got = scoring.coreset(df, "graph_cut", 20, "key", "label", "v").collect()
        assert sorted(row.key for row in got) == sorted(expected), most


def test_most_gain_bounds_rows_that_were_not_offered():
    r = np.random.default_rng(6)
    for i in range(300):
        d = int(r.integers(1, 8))
        units = scoring.unit_rows(np.concatenate([r.normal(r.choice([0, 1]), 1, (60, d)), np.zeros((2, d))]))
        cut, old = scoring.GraphCut(units), r.normal(0, r.choice([0.01, 1, 50]), d) * (i % 10 > 0)
        new, gains = old - units[r.integers(0, 62, r.integers(1, 9))].sum(0), units @ old - cut.own
        for rest in np.sort(gains)[[0, 20, 61]]:
            unsent = gains <= rest
            assert (units @ new - cut.own)[unsent].max() <= scoring.most_gain(rest, old, new, 1.0) + scoring.rounding(new, 1.0)


def test_vectors_without_a_cosine_are_named():
    import pytest

    for odd in (np.nan, np.inf, 1e200):
        with pytest.raises(ValueError, match="not finite"):
            scoring.unit_rows(np.array([[1.0, 2.0], [odd, 0.0]]))


def test_vectors_come_in_order_from_batches_of_any_size():
    import pyarrow as pa
    import pytest

    r = np.random.default_rng(7)
    keys, x = r.permutation(500), r.normal(0, 1, (500, 3)).astype("float32")
    sizes = np.split(np.arange(500), [0, 100, 100, 137, 400])
    batches = [pa.RecordBatch.from_pydict({"key": pa.array(keys[at]), "vector": pa.array(x[at].tolist(), pa.list_(pa.float32()))}) for at in sizes]
    got, units = scoring._ordered(pa.Table.from_batches(batches))
    assert got.to_pylist() == list(range(500))
    assert (units == scoring.unit_rows(x[np.argsort(keys)])).all()
    for odd in ([None], [[1.0]], [[1.0, None, 2.0]]):
        more = pa.RecordBatch.from_pydict({"key": pa.array([500]), "vector": pa.array(odd, pa.list_(pa.float32()))})
        with pytest.raises(ValueError, match="one length"):
            scoring._ordered(pa.Table.from_batches([*batches, more]))
