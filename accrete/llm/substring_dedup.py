"""Substring dedup with suffix automata of reference shards.

A window is WINDOW consecutive words of one document; a word goes if a window covering it also starts in a document with
a smaller doc_id. Streaming all documents past automata of all others is quadratic, so hashes first find what each
document must be held against:

1. Anchors: each window is represented by the rightmost least hash of its GRAM-word runs (winnowing), so equal windows
   have equal anchors. Documents whose words are those of an earlier one are settled by the hash of the whole. Anchors of
   the others that occur in two documents or more mark segments of suspect windows (Arrow batches of word hashes).
2. Window hashes of suspect segments, aggregated (combined before the shuffle), name the first document of each window,
   and thereby which reference segments a later segment has to be streamed past.
3. Shards: a suffix automaton is built of each reference segment and sent to every task that holds segments to be streamed
   past it; a popular one is sent to several tasks, with at most SHARE segments each. Matching statistics over the streamed
   segment give the maximal spans of WINDOW words or more, which are removed.

No automaton is larger than a document's segment, no group is gathered whole, and nothing is broadcast to all tasks: the
collection of all automata has no size bound. Word runs are compared as 64-bit hashes of words.

Defined results: null or blank text has no words and loses none; repeated doc_ids count as one document by their first
row in no particular order; null doc_ids are left out; texts of any length are whole; ties don't occur, as only smaller
doc_ids count. `remove` carries other columns along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accrete.llm.near_dedup import _mixed, _runs
from accrete.llm.text import words
from accrete.session import cut

WINDOW, GRAM = 50, 16
SHARE = 500


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` words, from those of runs of 1, 2, 4, .. words."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    got, covered, power, width = None, 0, _mixed(h + np.uint64(size)), 1
    while covered < size:
        if size & width:
            n = len(h) - covered - width + 1
            got = power[:n] if got is None else _mixed(got[:n] * np.uint64(31) + power[covered : covered + n])
            covered += width
        if covered < size:
            power = _mixed(power[:-width] * np.uint64(31) + power[width:])
            width *= 2
    return got


def anchors(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """For each window start the hash of its representative run: the least, by which equal windows agree."""
    grams = run_hashes(h, gram)
    width, n = window - gram + 1, len(h) - window + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    least, have = grams, 1
    while have < width:
        step = min(have, width - have)
        least, have = np.minimum(least[: len(least) - step], least[step:]), have + step
    return least[:n]


class SuffixAutomaton:
    """All runs of words of one reference segment."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in symbols:
            state = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = state
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[state] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = self.link[p]
                    self.link[q] = self.link[state] = copy
            last = state

    def spans(self, symbols: list[int], least: int) -> list[tuple[int, int]]:
        """Maximal spans (start, end) of the symbols that lie in matches of `least` symbols or more."""
        state = matched = 0
        found: list[list[int]] = []
        for i, c in enumerate(symbols):
            while state and c not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                matched += 1
            if matched >= least:
                if found and found[-1][1] >= i + 1 - matched:
                    found[-1][1] = i + 1
                    found[-1][0] = min(found[-1][0], i + 1 - matched)
                else:
                    found.append([i + 1 - matched, i + 1])
        return [(a, b) for a, b in found]


def _described(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, n_words, whole (the hash of all words) and anchors (distinct) of each document."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            rows = []
            for doc_id, h in zip(batch["doc_id"].tolist(), batch["hashes"].tolist(), strict=True):
                found = np.unique(anchors(np.asarray(h, "int64").view(np.uint64), window, gram))
                rows.append((doc_id, len(h), found.view("int64")))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "anchors"]).assign(whole=batch["whole"].values)

    listed = docs.where("doc_id is not null").select("doc_id", words(F.col("text")).alias("_words"))
    hashed = listed.select("doc_id", F.transform("_words", lambda w: F.xxhash64(w)).alias("hashes"))
    hashed = hashed.withColumn("whole", F.xxhash64("hashes"))
    return hashed.mapInPandas(batches, "doc_id long, n_words long, anchors array<long>, whole long")


def _segments(docs: DataFrame, suspects: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, segment (its first word's place) and hashes: runs of words covered by windows with shared anchors."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            rows = []
            for doc_id, h, shared in zip(batch["doc_id"].tolist(), batch["hashes"].tolist(), batch["shared"].tolist(), strict=True):
                h = np.asarray(h, "int64").view(np.uint64)
                starts = np.flatnonzero(np.isin(anchors(h, window, gram), np.asarray(shared, "int64").view(np.uint64)))
                cuts = np.flatnonzero(np.diff(starts) > 1) + 1
                for run in np.split(starts, cuts):
                    if len(run):
                        rows.append((doc_id, int(run[0]), h[run[0] : run[-1] + window].view("int64")))
            yield pd.DataFrame(rows, columns=["doc_id", "segment", "hashes"])

    hashed = docs.join(suspects, "doc_id").select("doc_id", "shared", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"))
    return hashed.mapInPandas(batches, "doc_id long, segment int, hashes array<long>")


def _windows(segments: DataFrame, window: int) -> DataFrame:
    """window (its hash), doc_id and segment of each window of the segments, each once a segment."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            found = [np.unique(run_hashes(np.asarray(h, "int64").view(np.uint64), window)).view("int64") for h in batch["hashes"].tolist()]
            sizes = [len(f) for f in found]
            yield pd.DataFrame({"window": np.concatenate(found) if found else np.zeros(0, "int64"), "doc_id": np.repeat(batch["doc_id"].values, sizes), "segment": np.repeat(batch["segment"].values, sizes)})

    return segments.mapInPandas(batches, "window long, doc_id long, segment int")


def spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words and spans (array of start, end in words, end exclusive) to be removed of each document."""
    table = cut(_described(docs, window, gram))
    firsts = table.where(F.col("n_words") >= window).groupBy("whole", "n_words").agg(F.min("doc_id").alias("_first"))
    judged = table.join(firsts, ["whole", "n_words"], "left").withColumn("_copy", F.coalesce(F.col("_first") < F.col("doc_id"), F.lit(False)))
    placed = judged.where(~F.col("_copy")).select("doc_id", F.explode("anchors").alias("anchor"))
    shared = placed.groupBy("anchor").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b")).where("_a < _b").select("anchor")
    suspects = placed.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("shared"))
    segments = cut(_segments(docs, suspects, window, gram))
    seen = _windows(segments, window)
    first = seen.groupBy("window").agg(F.min(F.struct("doc_id", "segment")).alias("r"), F.max("doc_id").alias("_last")).where("r.doc_id < _last").select("window", F.col("r.doc_id").alias("ref_doc"), F.col("r.segment").alias("ref_segment"))
    routes = cut(seen.join(first, "window").where("doc_id > ref_doc").select("doc_id", "segment", "ref_doc", "ref_segment").distinct())
    shares = routes.groupBy("ref_doc", "ref_segment").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    references = segments.select(F.col("doc_id").alias("ref_doc"), F.col("segment").alias("ref_segment"), "hashes").join(shares, ["ref_doc", "ref_segment"])
    references = references.select("ref_doc", "ref_segment", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(-1).cast("long").alias("doc_id"), F.lit(-1).alias("segment"), "hashes", F.lit(0).alias("streamed"))
    streamed = routes.join(shares, ["ref_doc", "ref_segment"]).join(segments, ["doc_id", "segment"])
    streamed = streamed.select("ref_doc", "ref_segment", F.pmod(F.xxhash64("doc_id", "segment"), F.col("shares")).cast("int").alias("share"), "doc_id", "segment", "hashes", F.lit(1).alias("streamed"))

    def match(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _runs(it, ["ref_doc", "ref_segment", "share"]):
            automaton, rows = None, []
            for doc_id, segment, h, is_streamed in zip(group["doc_id"].tolist(), group["segment"].tolist(), group["hashes"].tolist(), group["streamed"].tolist(), strict=True):
                if not is_streamed:
                    automaton = automaton or SuffixAutomaton(h.tolist())
                    continue
                rows += [(doc_id, segment + a, segment + b) for a, b in automaton.spans(h.tolist(), window)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end"]).astype("int64")

    keys = ["ref_doc", "ref_segment", "share"]
    matched = references.unionByName(streamed).repartition(*keys).sortWithinPartitions(*keys, "streamed").mapInPandas(match, "doc_id long, start long, end long")
    whole = judged.where("_copy").select("doc_id", F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"))
    united = matched.unionByName(whole).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_found"))

    def merged(found):
        def step(done, x):
            last = F.element_at(done, -1)
            joins = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= x["start"])
            longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
            return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(x)))

        return F.aggregate(found, F.array().cast("array<struct<start:bigint,end:bigint>>"), step)

    spans = united.select("doc_id", merged(F.col("_found")).alias("spans"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return table.select("doc_id", "n_words").dropDuplicates(["doc_id"]).join(spans, "doc_id", "left").withColumn("spans", F.coalesce("spans", empty))


def remove(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs with kept (the words that stay, joined by one space), n_words and n_removed."""
    found = spans(docs.select("doc_id", "text"), window, gram)
    split = docs.drop("kept", "n_words", "n_removed", "spans").join(found, "doc_id").withColumn("_words", words(F.col("text")))
    # what lies between the spans: from the end of each to the start of the next
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["end"]))
    starts = F.concat(F.transform("spans", lambda s: s["start"]), F.array("n_words"))
    gaps = F.zip_with(ends, starts, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    kept = F.flatten(F.transform(gaps, lambda g: F.slice("_words", (g["a"] + 1).cast("int"), (g["b"] - g["a"]).cast("int"))))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return split.withColumn("kept", F.when(F.size("spans") == 0, F.array_join("_words", " ")).otherwise(F.array_join(kept, " "))).withColumn("n_removed", removed).drop("_words", "spans")
