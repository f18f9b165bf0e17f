"""What to train on: new-data, freshness, stratified and random selection over (key, timestamp, label, trigger_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from accrete.operators.ordering import hash_rank, hash_uniform, sample_n


def tail_filter(state: DataFrame, next_trigger: int, tail: int | None) -> DataFrame:
    """Rows seen in the last `tail` triggers before next_trigger; all of them for None."""
    return state if tail is None else state.where(F.col("trigger_id") >= next_trigger - tail)


def new_data(state: DataFrame, trigger: int, tail: int | None = 0, limit: int | None = None, limit_by: str = "sampleUAR", seed: int = 42) -> DataFrame:
    """Keys of this trigger (tail 0), of it and the tail triggers before it, or of all so far (None), with a limit."""
    rows = state.where(F.col("trigger_id") <= trigger)
    rows = rows if tail is None else rows.where(F.col("trigger_id") >= trigger - tail)
    if limit is None:
        return rows
    if limit_by == "lastX":
        return rows.orderBy(F.desc("timestamp"), F.desc("key")).limit(limit)
    return sample_n(rows, limit, seed)


def freshness(state: DataFrame, used: DataFrame, unused_percent: int, limit: int | None, seed: int = 42) -> DataFrame:
    """A mix of used and unused keys in the asked-for proportion: scaled to the scarcer side, or up to the limit."""
    marked = state.join(used.select("key").distinct().withColumn("used", F.lit(True)), "key", "left").withColumn("used", F.coalesce("used", F.lit(False)))
    counts = {r["used"]: r["n"] for r in marked.groupBy("used").agg(F.count("*").alias("n")).collect()}  # two rows
    n_used, n_unused = counts.get(True, 0), counts.get(False, 0)
    if limit is not None:
        take_unused = min(int(limit * unused_percent / 100), n_unused)
        take_used = min(limit - int(limit * unused_percent / 100), n_used)
    elif n_used == 0:
        take_unused, take_used = n_unused, 0
    else:
        by_unused, by_used = n_unused / (unused_percent / 100), n_used / ((100 - unused_percent) / 100)
        total = int(min(by_unused, by_used))
        take_unused, take_used = int(total * unused_percent / 100), total - int(total * unused_percent / 100)
    return sample_n(marked.where("not used"), take_unused, seed).unionAll(sample_n(marked.where("used"), take_used, seed))


def target_size(n: int, ratio: int, ratio_max: int = 100, limit: int | None = None) -> int:
    target = n * ratio // ratio_max
    return target if limit is None else min(target, limit)


def fair_share(sizes: list[int], capacity: int, compat: bool = False) -> int:
    """The largest equal share a group that fits the capacity, smaller groups giving what they can (water-filling).

    compat: only the first group of each duplicated size is set aside in a round, as in the system whose results this
    flag reproduces.
    """
    left, rest = sorted(sizes), capacity
    while left:
        share = rest // len(left)
        full = [s for s in left if s <= share]
        if not full or len(full) == len(left):
            return share
        rest -= sum(full)
        for s in dict.fromkeys(full) if compat else full:
            left.remove(s)
    return capacity


def balanced(state: DataFrame, by: str, target: int, force: str | None = None, seed: int = 42) -> DataFrame:
    """Per group of `by` a fair share of the target, in hash order.

    force: "column" gives all groups the smallest group's size; "size" takes one more a group and cuts at the target.
    """
    sizes = sorted(r["count"] for r in state.groupBy(by).count().collect())  # one number a group
    share = min([fair_share(sizes, target), *sizes]) if force == "column" else fair_share(sizes, target)
    share += force == "size"
    w = Window.partitionBy(by).orderBy(hash_rank(seed, "key"), "key")
    got = state.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= share).drop("_rn")
    return got.orderBy("timestamp", "key").limit(target) if force == "size" else got


def random_no_replacement(state: DataFrame, last_used: DataFrame, round_start: int, target: int, seed: int = 42) -> DataFrame:
    """target keys not used since round_start; where these run out the rest starts a new round."""
    known = state.join(last_used, "key", "left")
    fresh = (F.coalesce("last_used", F.lit(-1)) < round_start).cast("int")
    return known.orderBy(F.desc(fresh), hash_rank(seed, "key"), "key").limit(target).drop("last_used")


def holdout(state: DataFrame, percent: int, seed: int = 42) -> DataFrame:
    """state with half: 1 for rows of the holdout set, 0 for the complement."""
    return state.withColumn("half", (hash_uniform(seed, "key") < percent / 100).cast("long"))


def partition_ids(state: DataFrame, size: int) -> DataFrame:
    """state with partition_id: chunks of `size` keys inside each trigger, by (timestamp, key)."""
    w = Window.partitionBy("trigger_id").orderBy("timestamp", "key")
    return state.withColumn("partition_id", F.floor((F.row_number().over(w) - 1) / size))


def scheduled(thresholds: list[int], trigger: int) -> int:
    """Which of the downsamplers is active: thresholds increase strictly."""
    if any(b <= a for a, b in zip(thresholds, thresholds[1:], strict=False)):
        raise ValueError("thresholds must increase")
    return sum(trigger >= t for t in thresholds)


def freshness_first(state: DataFrame, limit: int | None, seed: int = 42) -> DataFrame:
    """The first freshness trigger: nothing is used yet, so all keys up to the limit."""
    return state if limit is None else sample_n(state, limit, seed)


def mark_used(used: DataFrame, selected: DataFrame, trigger: int) -> DataFrame:
    """used (key, last_used_in_trigger) with the keys of this trigger's selection."""
    now = selected.select("key").distinct().withColumn("last_used_in_trigger", F.lit(trigger))
    return used.unionByName(now).groupBy("key").agg(F.max("last_used_in_trigger").alias("last_used_in_trigger"))


def coreset(state: DataFrame, trigger: int, warmup: int, presample, seed: int = 42) -> DataFrame:
    """All of this trigger's keys for the first `warmup` triggers, and what `presample` takes of them from then on."""
    rows = state.where(F.col("trigger_id") == trigger)
    return rows if trigger + 1 <= warmup else presample(rows)


def run_trigger(state: DataFrame, path: str, trigger: int, choose, size: int) -> int:
    """Chooses this trigger's set, writes it in partitions of `size` keys, and gives the next trigger's number."""
    from accrete.sources.files import write_training_set

    chosen = choose(state).select("key", "timestamp").withColumn("trigger_id", F.lit(trigger))
    write_training_set(partition_ids(chosen, size).select("key", "trigger_id", "partition_id"), path)
    return trigger + 1


def interleaved(used: DataFrame, unused: DataFrame, size: int) -> DataFrame:
    """Chunks of `size` keys of both in turn, used ones first: key, used, chunk and place of the chunk."""
    w = Window.partitionBy(F.lit(0)).orderBy("key")
    part = lambda df, flag: df.select("key", F.lit(bool(flag)).alias("used"), F.floor((F.row_number().over(w) - 1) / size).alias("chunk"))  # noqa: E731  both are samples of a limit
    both = part(used, True).unionAll(part(unused, False))
    return both.withColumn("place", F.col("chunk") * 2 + F.when(F.col("used"), 0).otherwise(1))
