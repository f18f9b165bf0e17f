"""Scores and coresets: importance sampling, uncertainty, epoch subsets, and greedy selection kernels per class.

The kernels see one class at a time, as they compare all pairs of its vectors; classes larger than MOST are cut into
parts by hash, each giving its share of the target, so that no task holds more than MOST vectors. Graph cut needs no
pairs and is never cut: a class goes to one task, or to all tasks at once if its vectors are more than one should hold.
"""

from __future__ import annotations

import base64
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from accrete.functions.arrays import entropy, gradient, l2, margin, softmax
from accrete.operators.ordering import hash_rank, weighted_sample_n

MOST = 4096  # a matrix of MOST * MOST numbers is what a task may hold
STEP = 1 << 18  # pairs of one batch
STRIP = 64  # rows of a strip of a matrix
OFFERS = 1024  # rows of a class that tasks offer each other at once


def target(n: int, ratio: int, ratio_max: int = 100) -> int:
    return max(n * ratio // ratio_max, 1)


def importance_sample(rows: DataFrame, score: str, n: int, seed: int = 42) -> DataFrame:
    """n rows with probability in proportion to the score, and weight 1 / (rows * p)."""
    size, total = rows.agg(F.count("*"), F.sum(score)).first()
    got = weighted_sample_n(rows, n, score, seed)
    return got.withColumn("weight", F.lit(float(total or 0.0)) / (F.lit(float(size)) * F.col(score)))


def with_gradient_norm(rows: DataFrame, logits: str, label: str) -> DataFrame:
    return rows.withColumn("_p", softmax(F.col(logits))).withColumn("grad_norm", l2(gradient(F.col("_p"), F.col(label)))).drop("_p")


def with_uncertainty(rows: DataFrame, logits: str) -> DataFrame:
    """least_confidence (the greatest logit), entropy (negated, so that small is uncertain) and margin of each row."""
    got = rows.withColumn("_p", softmax(F.col(logits)))
    return got.withColumn("least_confidence", F.array_max(logits).cast("double")).withColumn("entropy", -entropy(F.col("_p"))).withColumn("margin", margin(F.col("_p"))).drop("_p")


def epoch_subset(rows: DataFrame, n: int, epoch: int, replacement: bool, key: str = "key") -> DataFrame:
    """RS2: a fresh shuffle's first n a round; without replacement the epochs walk through one shuffle's disjoint parts."""
    if replacement:
        return rows.orderBy(hash_rank(epoch, key), key).limit(n)
    parts = max(rows.count() // n, 1)
    at = Window.partitionBy(F.lit(0)).orderBy("_h", key)
    nth, seed = epoch % parts, epoch // parts
    first = rows.withColumn("_h", hash_rank(seed, key)).orderBy("_h", key).limit((nth + 1) * n)
    return first.withColumn("_rn", F.row_number().over(at)).where(F.col("_rn") > nth * n).drop("_rn", "_h")


def rho_top(rows: DataFrame, training_loss: str, irreducible_loss: str, n: int, key: str = "key") -> DataFrame:
    return rows.withColumn("rho", F.col(training_loss) - F.col(irreducible_loss)).orderBy(F.desc("rho"), key).limit(n)


def strips(size: int) -> Iterator[slice]:
    """Cuts of a matrix's rows, so that what is worked out on the way is small beside the matrix."""
    return (slice(start, start + STRIP) for start in range(0, size, STRIP))


def euclidean_matrix(x: np.ndarray) -> np.ndarray:
    sq = (x * x).sum(1)
    d = 2 * x @ x.T
    for s in strips(len(x)):
        d[s] = np.sqrt(np.maximum(sq[s, None] + sq[None, :] - d[s], 0))
    return d


def unit_rows(x: np.ndarray) -> np.ndarray:
    """The rows of x at length 1; those without length stay at 0."""
    x = x.astype("float64")
    norm = np.linalg.norm(x, axis=1)[:, None]
    if not np.isfinite(norm).all():
        raise ValueError("a vector whose length is not finite has no cosine with others")
    return x / np.where(norm > 0, norm, 1)


def cosine_matrix(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1)
    c = x @ x.T
    for s in strips(len(x)):
        norms = norm[s, None] * norm[None, :]
        c[s] = np.where(norms > 0, 0.5 + 0.5 * c[s] / np.where(norms > 0, norms, 1), 0.5)
    return c


def k_center(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Farthest-first from row 0."""
    chosen, least = [0], np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < min(n, len(x)):
        chosen.append(int(np.argmax(np.where(np.isin(np.arange(len(x)), chosen), -1, least))))
        least = np.minimum(least, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return np.asarray(chosen), np.ones(len(chosen))


def greedy(gain, n: int, size: int) -> list[int]:
    """The naive greedy optimizer: the item with the greatest gain, again and again (ties: first)."""
    chosen: list[int] = []
    for _ in range(min(n, size)):
        g = gain(chosen).astype("float64")
        g[chosen] = -np.inf
        chosen.append(int(np.argmax(g)))
    return chosen


def facility_location(similarity: np.ndarray, n: int) -> list[int]:
    state = {"best": np.zeros(len(similarity)), "k": 0}
    sums = np.zeros((STRIP + 1, len(similarity)))  # the sum so far, then a strip's gains: added up row by row, as in one sum

    def gain(chosen):
        if len(chosen) > state["k"]:
            state["best"] = np.maximum(state["best"], similarity[:, chosen[-1]])
            state["k"] = len(chosen)
        sums[0] = 0
        for s in strips(len(similarity)):
            part = sums[1 : 1 + len(similarity[s])]
            np.subtract(similarity[s], state["best"][s, None], out=part)
            np.maximum(part, 0, out=part)
            sums[0] = sums[: 1 + len(part)].sum(0)
        return sums[0]

    return greedy(gain, n, len(similarity))


class GraphCut:
    """Graph cut over the similarities 0.5 + 0.5 * cosine of some rows of a class, without the matrix of all pairs.

    With u the vectors at length 1, a row's gain is that of its similarities with all rows, less penalty times its own
    and twice those with the chosen rows. Summed up, this is u . pull - penalty / 2 * u . u, and what is equal for all
    rows; pull is half the sum of all u less penalty times the sum of the chosen ones.
    """

    def __init__(self, units: np.ndarray, penalty: float = 1.0):
        self.units, self.penalty = units, penalty
        self.own = 0.5 * penalty * units.any(axis=1)  # u . u is 1, or 0 where a vector has no length
        self.left = len(units)

    def best(self, pull: np.ndarray, n: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """The n greatest gains of rows not yet taken, and these rows; of equal gains the first.

        Equal vectors gain equally here wherever they stand, for what a matrix product finds to be close is summed up again.
        """
        n = min(n, self.left)
        gain = self.units @ pull - self.own
        least = gain.max() if n == 1 else np.partition(gain, len(gain) - n)[len(gain) - n]
        near = np.nonzero(gain >= least - rounding(pull, self.penalty))[0]
        exact = (self.units[near] * pull).sum(1) - self.own[near]
        order = np.argsort(-exact, kind="stable")[:n] if n > 1 else [np.argmax(exact)]
        return exact[order], near[order]

    def take(self, row: int) -> None:
        self.own[row], self.left = np.inf, self.left - 1


def rounding(pull: np.ndarray, penalty: float) -> float:
    """More than gains of one row, summed up in different orders, differ by."""
    return 4 * (len(pull) + 4) * np.finfo("float64").eps * (np.linalg.norm(pull) + penalty)


def most_gain(rest: float, old: np.ndarray, new: np.ndarray, penalty: float) -> float:
    """What a row can gain at most under the pull new that gained no more than rest under old.

    Its vector has length 1, so it leans towards old by a cosine of at most p, and that bounds how far it leans towards new.
    """
    size, longest = np.linalg.norm(old), np.linalg.norm(new)
    got = longest
    if size > 0:
        along = new @ old / size
        across = np.linalg.norm(new - along * old / size)
        p = min(max((rest + penalty / 2 + rounding(old, penalty)) / size, -1.0), 1.0)
        if along > p * longest:
            got = p * along + np.sqrt((1 - p) * (1 + p)) * across
    return max(got - penalty / 2, 0.0 if rest >= 0 else -np.inf)  # vectors without length always gain 0


def graph_cut(units: np.ndarray, n: int, penalty: float = 1.0) -> list[int]:
    cut, pull, chosen = GraphCut(units, penalty), 0.5 * units.sum(0), []
    for _ in range(min(n, len(units))):
        chosen.append(int(cut.best(pull)[1][0]))
        cut.take(chosen[-1])
        pull -= penalty * units[chosen[-1]]
    return chosen


def log_determinant(similarity: np.ndarray, n: int) -> list[int]:
    """Adds 1e-3 to the similarity's diagonal, in place."""
    m = similarity
    m[np.diag_indices(len(m))] += 1e-3

    def gain(c):
        if not c:
            return np.diag(m).copy()
        solved = np.linalg.solve(m[np.ix_(c, c)], m[c])
        solved *= m[c]
        return np.diag(m) - solved.sum(0)

    return greedy(gain, n, len(m))


def craig(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Facility location on shifted negative distances; a chosen row weighs 1 plus the rows that it stands for."""
    s = euclidean_matrix(x)
    np.subtract(s.max(), s, out=s)
    chosen = facility_location(s, n)
    stands = np.bincount(np.argmax(s[:, chosen], axis=1), minlength=len(chosen))
    return np.asarray(chosen), 1.0 + stands


def _nonnegative(a: np.ndarray, b: np.ndarray, ridge: float, steps: int = 300) -> np.ndarray:
    """Nonnegative least squares by projected coordinate descent on the normal equations.

    While the same weights stay at zero, a sweep over the others is one linear map, so that sweeps weight by weight are
    left to those that change this set. Sweeps end early where they move nothing by more than rounding.
    """
    q, c = a.T @ a + ridge * np.eye(a.shape[1]), a.T @ b
    w, step, same, needed = np.zeros(len(c)), 0, 0, 2
    zero = np.zeros(len(c), dtype=bool)
    equations = list(enumerate(zip(q, c.tolist(), np.diag(q).tolist(), strict=True)))
    while step < steps:
        before, now = zero, w.tolist()
        for j, (row, goal, own) in equations:
            value = now[j] + (goal - float(row.dot(w))) / own
            w[j] = value if value > 0 else 0.0
        zero, step = w == 0, step + 1
        same = same + 1 if (zero == before).all() else 0
        if same >= needed and not zero.all():
            w, step, settled = _sweep_on(q, c, w, zero, step, steps)
            if settled:
                return w
            same, needed = 0, 2 * needed
    return w


def _sweep_on(q: np.ndarray, c: np.ndarray, w: np.ndarray, zero: np.ndarray, step: int, steps: int) -> tuple[np.ndarray, int, bool]:
    """Sweeps for as long as those at zero, and no others, stay there: w, the sweeps done, and whether w has settled."""
    free, held = np.nonzero(~zero)[0], np.nonzero(zero)[0]
    inner = q[np.ix_(free, free)]
    both = np.linalg.solve(np.tril(inner), np.column_stack([-np.triu(inner, 1), c[free]]))
    turn, shift = np.ascontiguousarray(both[:, :-1]), both[:, -1]
    across = q[np.ix_(held, free)]
    done = free[None, :] < held[:, None]  # weights that a sweep has renewed when it comes to one at zero
    new, old, x = across * done, across * ~done, w[free]
    while step < steps:
        y = turn @ x + shift
        if y.min() <= 0 or (len(held) and (c[held] - new @ y - old @ x).max() > 0):
            break
        moved, x, step = np.abs(y - x).max(), y, step + 1
        if moved <= 16 * np.finfo("float64").eps * x.max():
            step = steps
    w = np.zeros(len(c))
    w[free] = x
    return w, step, step >= steps


def grad_match(x: np.ndarray, n: int, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Orthogonal matching pursuit toward the sum of the gradients, with nonnegative weights."""
    goal, chosen, w = x.sum(0), [], np.zeros(0)
    for _ in range(min(n, len(x))):
        left = x @ (goal - (x[chosen].T @ w if chosen else 0))
        left[chosen] = -np.inf
        chosen.append(int(np.argmax(left)))
        w = _nonnegative(x[chosen].T, goal, ridge)
    return np.asarray(chosen), w


KERNELS = {
    "k_center": k_center,
    "craig": craig,
    "grad_match": grad_match,
    "facility_location": lambda x, n: ((c := np.asarray(facility_location(cosine_matrix(x), n))), np.ones(len(c))),
    "graph_cut": lambda x, n: ((c := np.asarray(graph_cut(unit_rows(x), n))), np.ones(len(c))),
    "log_determinant": lambda x, n: ((c := np.asarray(log_determinant(cosine_matrix(x), n))), np.ones(len(c))),
}


def cut_classes(rows: DataFrame, key: str, label: str) -> DataFrame:
    """rows with _part, their place by hash among the _parts of their class, each of about MOST rows at the most."""
    parts = rows.groupBy(label).agg(F.ceil(F.count("*") / MOST).alias("_parts"))
    return rows.join(F.broadcast(parts), label).withColumn("_part", F.pmod(F.xxhash64(key), F.col("_parts")))  # one row a class


def coreset(rows: DataFrame, kernel: str, ratio: int, key: str, label: str, vector: str) -> DataFrame:
    """key, label and weight of the rows that a kernel keeps in each class."""
    if kernel == "graph_cut":
        return graph_cut_classes(rows, ratio, key, label, vector)
    cut = cut_classes(rows, key, label)

    def select(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(key).reset_index(drop=True)
        chosen, weight = KERNELS[kernel](np.stack(part[vector].to_list()).astype("float64"), target(len(part), ratio))
        return pd.DataFrame({"key": part[key].values[chosen], "label": part[label].values[chosen], "weight": weight})

    return cut.select(key, label, vector, "_part").groupBy(label, "_part").applyInPandas(select, "key long, label long, weight double")


CHOSEN = "key long, label long, weight double"


def _chosen(keys: pa.Array, label: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([keys, pa.array([label] * len(keys), pa.int64()), pa.array(np.ones(len(keys)))], names=["key", "label", "weight"])


def _ordered(table: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """The keys of a table in order, and its vectors at length 1."""
    order = pc.sort_indices(table["key"])
    place, start, units = np.argsort(order.to_numpy()), 0, np.empty((0, 0))
    for vectors in (c for c in table["vector"].chunks if len(c)):
        flat, width = vectors.flatten(), pc.unique(pc.list_value_length(vectors)).to_pylist()
        if start == 0:
            units = np.empty((len(table), width[0] or 0))
        if flat.null_count or width != [units.shape[1]]:
            raise ValueError("vectors of one length and without nulls are needed")
        x = flat.to_numpy(zero_copy_only=False).reshape(len(vectors), width[0])
        to, start = place[start : start + len(x)], start + len(x)
        for s in strips(len(x)):
            units[to[s]] = unit_rows(x[s])
    return pa.concat_arrays(table["key"].take(order).chunks), units


def graph_cut_classes(rows: DataFrame, ratio: int, key: str, label: str, vector: str, penalty: float = 1.0) -> DataFrame:
    """key, label and weight 1 of the rows that graph cut keeps in each class, always chosen from the whole class.

    A class of up to MOST * MOST numbers is held by one task. The vectors of larger ones are dealt to as many tasks as run
    at once, which agree on each row in turn (_agreed); these classes fail where a cluster can't start them together.
    """
    rows = rows.where(F.col(label).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"))
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width"))
    large = {r.label: target(r.n, ratio) for r in sizes.where(F.col("n") * F.col("width") > MOST * MOST).collect()}

    def select(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, units = _ordered(pa.Table.from_batches(list(batches)))
        yield _chosen(keys.take(pa.array(graph_cut(units, target(len(units), ratio), penalty))), group[0].as_py())

    inside = F.col("label").isin(list(large))
    got = rows.where(~inside).groupBy("label").applyInArrow(select, CHOSEN)
    if not large:
        return got
    dealt = rows.where(inside).repartition(rows.sparkSession.sparkContext.defaultParallelism)
    together = dealt.mapInArrow(_agreed(large, penalty), CHOSEN, barrier=True)
    return got.unionByName(together.repartition("key"))  # tasks that start together are a stage of their own


def _agreed(targets: dict[int, int], penalty: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Graph cut by tasks that each hold some rows of the classes.

    In turns, a task offers its best rows of every class, and all tasks take the same of all offers, one after the other, for as
    long as no row that wasn't offered can have gained more by then (most_gain). That is one row a turn at least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()

        def shared(mine: dict) -> list[dict]:
            return [pickle.loads(base64.b64decode(said)) for said in context.allGather(base64.b64encode(pickle.dumps(mine)).decode())]

        batches = list(batches)
        table = pa.Table.from_batches(batches) if batches else None
        keys, cuts, pull = {}, {}, {}
        for label in targets if table else ():
            part = table.filter(pc.equal(table["label"], label))
            if len(part):
                keys[label], units = _ordered(part)
                cuts[label] = GraphCut(units, penalty)
        del batches, table
        sums = shared({label: cut.units.sum(0) for label, cut in cuts.items()})
        for label, part in (item for said in sums for item in said.items()):
            pull[label] = pull.get(label, 0) + 0.5 * part
        taken: dict[int, list[int]] = {label: [] for label in cuts}
        needed, wide = dict(targets), dict.fromkeys(targets, 1 + OFFERS // len(sums))
        while needed:
            mine = {}
            for label, cut in cuts.items():
                if label in needed and cut.left:
                    gains, rows = cut.best(pull[label], wide[label])
                    names = [(k is None, k, context.partitionId(), row) for k, row in zip(keys[label].take(pa.array(rows)).to_pylist(), rows.tolist(), strict=True)]
                    mine[label] = names, cut.units[rows], gains[-1] if cut.left > len(rows) else -np.inf
            offers = shared(mine)
            for label in list(needed):
                names, units, rests = zip(*(o[label] for o in offers if label in o), strict=True)
                names, units, rest = [n for part in names for n in part], np.concatenate(units), max(rests)
                order = sorted(range(len(names)), key=names.__getitem__)
                pool, new, n = GraphCut(units[order], penalty), pull[label], 0
                while n < needed[label] and pool.left:
                    (gain,), (at,) = pool.best(new)
                    if n and rest > -np.inf and gain <= most_gain(rest, pull[label], new, penalty) + rounding(new, penalty):
                        break
                    pool.take(at)
                    new, n = new - penalty * pool.units[at], n + 1
                    *_, task, row = names[order[at]]
                    if task == context.partitionId():
                        cuts[label].take(row)
                        taken[label].append(row)
                pull[label], wide[label], needed[label] = new, 1 + min(4 * n, OFFERS) // len(sums), needed[label] - n
                if not needed[label]:
                    del needed[label]
        for label, chosen in taken.items():
            yield _chosen(keys[label].take(pa.array(chosen, pa.int64())), label)

    return run


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Nonnegative numbers rounded half up, as round does in DuckDB and C."""
    x = x * 10.0**digits
    whole = np.floor(x)
    whole += x - whole >= 0.5
    return whole / 10.0**digits


def _added_up(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The distance of x[i] from y[i], squares added from the first to the last place, as expressions and SQL do."""
    total = np.zeros(len(x))
    for i in range(x.shape[1]):
        total += (x[:, i] - y[:, i]) ** 2
    return np.sqrt(total)


def rounded_distances(x: np.ndarray, y: np.ndarray, digits: int) -> np.ndarray:
    """Euclidean distances of the rows of x from those of y, rounded.

    Found by a matrix product; where its rounding error (at most `err` in the square) could move the last digit, and
    where numbers aren't finite, the squares of the differences are added up instead, so the digits are always theirs.
    """
    with np.errstate(invalid="ignore", over="ignore"):
        a, b = (x * x).sum(1)[:, None], (y * y).sum(1)[None, :]
        square = x @ (-2.0 * y.T)
        square += a
        square += b
        np.maximum(square, 0, out=square)
        err = 8 * (x.shape[1] + 4) * np.finfo("float64").eps * (a.max(initial=0) + b.max(initial=0))
        d = np.sqrt(square)
        got = rounded(d, digits)
        # |sqrt(s) - sqrt(t)| = |s - t| / (sqrt(s) + sqrt(t)), and never above sqrt(|s - t|)
        np.maximum(d, err**0.5, out=square)
        np.divide(err, square, out=square, where=square > 0)
        d -= got
        np.abs(d, out=d)
        d += square
        sure = 0.5 * 10.0**-digits - 8 * np.finfo("float64").eps * (2 * (a.max(initial=0) + b.max(initial=0))) ** 0.5
        i, j = np.nonzero(~(d < sure) | ~np.isfinite(got))
        got[i, j] = rounded(_added_up(x[i], y[j]), digits)
    return got


def _matrix(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, short ones filled with zeros, and their lengths; a null or a vector with nulls counts as -1."""
    length = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten()
    if not vectors.null_count and not flat.null_count and (length == length[:1]).all():
        return flat.to_numpy(zero_copy_only=False).astype("float64").reshape(len(vectors), -1), length
    lists = [None if v is None or None in v else v for v in vectors.to_pylist()]
    length = np.array([-1 if v is None else len(v) for v in lists])
    x = np.zeros((len(lists), max(length.max(initial=0), 0)))
    for i, v in enumerate(lists):
        if v:
            x[i, : len(v)] = v
    return x, length


def class_distances(rows: DataFrame, key: str, label: str, vector: str, digits: int) -> DataFrame:
    """a, b (a < b) and the rounded Euclidean distance of all pairs inside each class; null without two vectors of one length.

    Each two parts of a class meet in one group, which holds 2 * MOST vectors and hands out its pairs batch by batch.
    """
    cut = cut_classes(rows.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(label).alias("_label"), F.col(vector).alias("_vector")), "_key", "_label")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))
    met = cut.select("_label", "_key", "_vector", "_part", other.alias("_other"))
    met = met.select("_label", F.least("_part", "_other").alias("_low"), F.greatest("_part", "_other").alias("_high"), "_part", "_key", "_vector")

    def pairs(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, low, high = (g.as_py() for g in group)
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        keys, part = table["_key"].to_numpy(), table["_part"].to_numpy()
        vectors = table["_vector"].combine_chunks()
        x, length = _matrix(vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors)
        one, two = np.nonzero(part == low)[0], np.nonzero(part == high)[0]
        one, two = one[np.argsort(keys[one], kind="stable")], two[np.argsort(keys[two], kind="stable")]
        odd = bool((length != length[0]).any() or length[0] < 0)
        x2, step = x[two], max(STEP // max(len(two), 1), 1)
        for start in range(0, len(one), step):
            rows_ = one[start : start + step]
            # inside a part a pair is met twice, and its rows are in order: those before the block's first key are left out
            skip = np.searchsorted(keys[two], keys[rows_[0]], "right") if low == high else 0
            d = rounded_distances(x[rows_], x2[skip:], digits)
            k1, k2 = keys[rows_][:, None], keys[two][None, skip:]
            a, b = np.broadcast_arrays(k1, k2) if low == high else (np.minimum(k1, k2), np.maximum(k1, k2))
            missing = None
            if odd:
                missing = (length[rows_][:, None] != length[two][None, skip:]) | (length[rows_] < 0)[:, None]
            keep = a < b
            if keep.all():
                a, b, d, missing = a.ravel(), b.ravel(), d.ravel(), missing if missing is None else missing.ravel()
            else:
                a, b, d, missing = a[keep], b[keep], d[keep], missing if missing is None else missing[keep]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d, mask=missing)], names=["a", "b", "distance"])

    return met.groupBy("_label", "_low", "_high").applyInArrow(pairs, "a long, b long, distance double")
