"""Drift and performance triggers: windows relative to the last trigger, a distance a chunk, a decision, in order.

Each evaluation depends on where the last trigger fell, so evaluations follow one another on the driver; what each looks
at is a filter and an aggregation over the stream by Spark, and only its distance comes back.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def amount_windows(stream: DataFrame, end: int, last_trigger: int | None, current: int, reference: int, overlap: bool = False) -> tuple[DataFrame, DataFrame]:
    """The current and the reference window at place `end` (its sample included).

    last_trigger: the place of the last sample of the last trigger. The current window holds the last `current` samples,
    without overlap none from before the trigger; the reference holds the last `reference` samples up to the trigger.
    """
    idx = F.col("idx")
    since = -1 if last_trigger is None else last_trigger
    start = end - current if overlap else max(end - current, since)
    return stream.where((idx > start) & (idx <= end)), stream.where((idx > since - reference) & (idx <= since))


def time_windows(stream: DataFrame, end: int, last_trigger: int | None, current_s: int, reference_s: int, overlap: bool = False) -> tuple[DataFrame, DataFrame]:
    """The same by data time: reaching back so many seconds from the last sample, and from the trigger's last sample."""
    idx, ts = F.col("idx"), F.col("timestamp")
    since = -1 if last_trigger is None else last_trigger
    at = {r["idx"]: r["timestamp"] for r in stream.where(idx.isin(end, since)).select("idx", "timestamp").collect()}  # two rows at most
    now = stream.where((idx <= end) & (ts >= at[end] - current_s))
    before = stream.where((idx <= since) & (ts >= at.get(since, 0) - reference_s))
    return (now if overlap else now.where(idx > since)), before


def drift_trigger(
    stream: DataFrame,
    every: int,
    distance: Callable[[DataFrame, DataFrame], DataFrame],
    decide: Callable[[float, list[float]], bool],
    windows: Callable[[int, int | None], tuple[DataFrame, DataFrame]],
    warmup: int = 0,
) -> list[tuple[int, float | None, bool]]:
    """(place, distance, fired) of each evaluation; the first fires, the next `warmup` ones only collect distances.

    decide: gets a distance and those before it. distance: a DataFrame with one number, called distance.
    """
    total = stream.count()
    out, last, seen = [], None, []
    for end in range(every - 1, total, every):
        if last is None:
            out.append((end, None, True))
            last = end
            continue
        value = distance(*windows(end, last)).first()["distance"]
        fired = value is not None and len(seen) >= warmup and decide(value, seen)
        seen.append(value)
        out.append((end, value, fired))
        last = end if fired else last
    return out


def quantile_decision(k: int, q: float) -> Callable[[float, list[float]], bool]:
    """Above the interpolated quantile of the last k distances; the first one is."""

    def decide(value: float, seen: list[float]) -> bool:
        past = sorted(seen[-k:])
        if not past:
            return True
        at = q * (len(past) - 1)
        low = int(at)
        line = past[low] + (at - low) * (past[min(low + 1, len(past) - 1)] - past[low])
        return value > line

    return decide


def performance_trigger(accuracies: Iterable[tuple[int, float]], criteria: Iterable[Callable[[float, list[float]], bool]]) -> list[tuple[int, bool]]:
    """Folds (chunk, accuracy): fires where any criterion holds; a criterion sees the accuracies since the last firing."""
    out, since, criteria = [], [], list(criteria)
    for chunk, accuracy in accuracies:
        fired = any(c(accuracy, since) for c in criteria)
        out.append((chunk, fired))
        if fired:
            since = []
        else:
            since.append(accuracy)
    return out


def below(threshold: float) -> Callable[[float, list[float]], bool]:
    return lambda value, _: value <= threshold


def drop_from_mean(k: int, deviation: float) -> Callable[[float, list[float]], bool]:
    """At least `deviation` below the mean of the last k values since the last firing.

    They are added one by one, as a running total in SQL is: sum() carries the rounding errors along from Python 3.12 on.
    """
    return lambda value, seen: bool(seen) and reduce(operator.add, seen[-k:]) / len(seen[-k:]) - value >= deviation


def warmup_policy(warmup: int, during: Callable[[int], bool], after: Callable[[int], bool]) -> Callable[[int], bool]:
    """One policy for the first `warmup` intervals, another from then on."""
    return lambda interval: during(interval) if interval < warmup else after(interval)
