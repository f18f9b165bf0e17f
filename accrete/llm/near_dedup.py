"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation, components.

1. Per document (Arrow batches): the set of 64-bit shingle hashes, SAMPLES MinHash samples, BANDS keys of ROWS samples
   each, and an odd sketch: every sample flips one of BITS parity bits, so that the bits in which two sketches differ
   estimate how many samples differ, most precisely where nearly all agree. A document's node is the hash of its set, so
   copies are one node.
2. Per band key: pairs whose sketches differ in at most MOST_DIFFERENT bits (a similarity of 0.8 lies five standard
   deviations below) are united, and a spanning forest of them is kept: at most one edge a member. A bucket of more than
   BUCKET members isn't compared: all its members are joined to its least one, which can only add candidates.
3. Components of these candidates; inside each the full sets are compared exactly, in pairs of blocks of bounded size,
   each giving a spanning forest of the true links; their components are the result.

A pair at 0.8 shares no band with probability (1 - 0.8 ** ROWS) ** BANDS, about 3e-6. Nothing is capped: what isn't
compared by sketch is compared exactly.

Defined results: null or blank text has an empty set, is linked with nothing and keeps itself; fewer than SHINGLE words
are one shingle; exact copies are linked; of a repeated doc_id every row has a row of its own, by its own text; null
doc_ids are ignored by `groups`, and `keep_first` keeps their rows. Other columns are carried along by `keep_first`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accrete.llm.components import components
from accrete.llm.text import lower_ascii, words
from accrete.session import cut

SAMPLES, BANDS, ROWS, BITS = 256, 24, 4, 512
BUCKET = 1000
MOST_DIFFERENT = 141  # expected at a similarity of 0.6: 256 * (1 - exp(-2 * 2 * 256 * 0.4 / 512))
#: Members and shingles of a block; a task holds two blocks.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 1_500_000
GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer: well-spread 64-bit values of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = _mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64) * GOLD)
_FACTORS = _mixed(np.arange(1001, SAMPLES + 1001, dtype=np.uint64) * GOLD) | np.uint64(1)


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; a shorter text is one run."""
    h = np.asarray(hashes, "int64").view(np.uint64)
    if not len(h):
        return h
    n = max(1, len(h) - size + 1)
    got = np.full(n, min(size, len(h)), np.uint64) * GOLD
    for k in range(min(size, len(h))):
        got = _mixed(got * np.uint64(31) + h[k : k + n])
    return np.unique(got)


def samples_of(shingles: np.ndarray) -> np.ndarray:
    """MinHash samples of a set."""
    least = np.full(SAMPLES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(shingles), 1024):
        part = (shingles[at : at + 1024, None] ^ _SEEDS) * _FACTORS
        np.minimum(least, (part ^ (part >> np.uint64(32))).min(axis=0), out=least)
    return least


def band_keys(samples: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * GOLD
    for r in range(ROWS):
        keys = _mixed(keys * np.uint64(31) + samples[r : BANDS * ROWS : ROWS])
    return keys.view("int64")


def odd_sketch(samples: np.ndarray) -> bytes:
    """BITS parity bits: each sample with its place flips one."""
    at = (_mixed(samples + _SEEDS) % np.uint64(BITS)).astype("int64")
    return np.packbits((np.bincount(at, minlength=BITS) & 1).astype("uint8")).tobytes()


def described(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, whole (the hash of its words), n_shingles, node, keys and sketch of each document; the last three are null for empty sets."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            rows = []
            for doc_id, hashes in zip(batch["doc_id"].tolist(), batch["hashes"].tolist(), strict=True):
                s = shingle_set(hashes, size)
                if not len(s):
                    rows.append((doc_id, 0, None, None, None))
                    continue
                samples = samples_of(s)
                rows.append((doc_id, len(s), np.uint64(xxhash.xxh64_intdigest(s.tobytes())).astype("int64"), band_keys(samples), odd_sketch(samples)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "node", "keys", "sketch"]).astype({"node": "Int64"}).assign(whole=batch["whole"].values)

    hashed = docs.where("doc_id is not null").select("doc_id", F.transform(words(lower_ascii(F.col("text"))), lambda w: F.xxhash64(w)).alias("hashes"))
    return hashed.withColumn("whole", F.xxhash64("hashes")).mapInPandas(batches, "doc_id long, n_shingles long, node long, keys array<long>, sketch binary, whole long")


def _forest(n: int, pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs that join two trees, in order."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    kept = []
    for a, b in pairs:
        if (x := find(a)) != (y := find(b)):
            root[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def _runs(it: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Groups of equal keys in a stream that is sorted by them."""
    rest = None
    for batch in it:
        if not len(batch):
            continue
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        cuts = np.flatnonzero(np.any([(batch[k].values[1:] != batch[k].values[:-1]) for k in keys], axis=0)) + 1
        edges = [0, *cuts.tolist()]
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a > 1:
                yield batch.iloc[a:b]
        rest = batch.iloc[edges[-1] :]
    if rest is not None and len(rest) > 1:
        yield rest


def candidate_edges(table: DataFrame) -> DataFrame:
    """Edges a, b between nodes that may be similar. table: from `described`."""
    rows = table.where("node is not null").select("node", "sketch", F.explode("keys").alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least"))
    large = sizes.where(F.col("n") > BUCKET)
    stars = rows.join(large, "key").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()

    def compare(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple[int, int]] = []
        for group in _runs(it, ["key"]):
            nodes, first = np.unique(group["node"].values, return_index=True)
            if len(nodes) < 2:
                continue
            sketches = np.frombuffer(b"".join(group["sketch"].values[first]), np.uint64).reshape(len(nodes), -1)
            near = ((i, i + 1 + int(j)) for i in range(len(nodes) - 1) for j in np.flatnonzero(np.bitwise_count(sketches[i + 1 :] ^ sketches[i]).sum(axis=1) <= MOST_DIFFERENT))
            found += [(int(nodes[a]), int(nodes[b])) for a, b in _forest(len(nodes), near)]
            if len(found) > 20_000:
                yield pd.DataFrame(found, columns=["a", "b"])
                found = []
        yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    small = rows.join(large.select("key"), "key", "left_anti")
    compared = small.repartition("key").sortWithinPartitions("key").mapInPandas(compare, "a long, b long")
    return stars.union(compared.distinct())


def true_edges(docs: DataFrame, table: DataFrame, clusters: DataFrame, size: int, percent: int) -> DataFrame:
    """Edges a, b between nodes whose full sets are similar: a spanning forest per pair of blocks of each cluster."""
    nodes = table.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "whole", "n_shingles")).alias("_d")).select("node", "_d.*")
    members = nodes.join(clusters, "node")
    blocks = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = members.join(blocks, "root").select("doc_id", "whole", "node", "root", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    sets = docs.select("doc_id", "text").join(placed, "doc_id")
    hashed = sets.select("node", "root", "blocks", "block", "whole", F.transform(words(lower_ascii(F.col("text"))), lambda w: F.xxhash64(w)).alias("hashes"))
    # only the text that the node was made of, where a doc_id has several
    hashed = hashed.select("node", "root", "blocks", "block", F.when(F.xxhash64("hashes") == F.col("whole"), F.col("hashes")).alias("hashes")).where("hashes is not null")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = hashed.select("node", "root", "block", "hashes", other.alias("other")).select("node", "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "hashes")

    def compare(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _runs(it, ["root", "i", "j"]):
            nodes, first = np.unique(group["node"].values, return_index=True)
            sets = [shingle_set(h, size) for h in group["hashes"].values[first]]
            found = [(int(nodes[a]), int(nodes[b])) for a, b in _forest(len(nodes), _similar(sets, percent))]
            yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    keys = ["root", "i", "j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(compare, "a long, b long")


def _similar(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """All pairs with 100 * intersection >= percent * union, by products of 0-1 matrices over the shared shingles."""
    n, sizes = len(sets), np.asarray([len(s) for s in sets], "int64")
    every = np.concatenate(sets)
    values, where = np.unique(every, return_inverse=True)
    shared = np.bincount(where) > 1
    place = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(n), sizes)
    keep = shared[where]
    owner, column = owner[keep], place[where[keep]]
    both = np.zeros((n, n), "float32")
    width = max(1, 16_000_000 // n)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, [at, at + width])
        matrix = np.zeros((n, min(width, int(shared.sum()) - at)), "float32")
        matrix[owner[lo:hi], column[lo:hi] - at] = 1
        both += matrix @ matrix.T
    both = both.astype("int64")
    for i in range(n - 1):
        inter = both[i, i + 1 :]
        for j in np.flatnonzero(100 * inter >= percent * (sizes[i] + sizes[i + 1 :] - inter)):
            yield i, i + 1 + int(j)


def groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id of its component) of each document."""
    table = cut(described(docs, size))
    clusters = components(candidate_edges(table))
    linked = components(true_edges(docs, table, clusters, size, percent))
    nodes = table.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("_first"))
    rooted = nodes.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = rooted.groupBy("root").agg(F.min("_first").alias("component_id"))
    named = rooted.join(firsts, "root").select("node", "component_id")
    return table.join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without those whose component has a smaller doc_id, with the columns of docs."""
    gone = groups(docs.select("doc_id", "text"), size, percent).where("component_id < doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
