"""Connected components of an edge table as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accrete.session import cut


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """node and root (the smallest node of its component) for every node of an edge; edges: a, b of one orderable type.

    Alternating star contraction: in a large-star step every node hangs its larger neighbours on its smallest one, in a
    small-star step it hangs its smaller neighbours and itself there; both are an aggregation (combined before the
    shuffle) and a join on the node, so no neighbourhood is ever gathered. It ends when a round changes nothing; each
    round is written to the checkpoint folder. Null nodes and loops are dropped.
    """
    now = cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    size = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    known = size(now)
    if known[0] == 0:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(rounds):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.union(least.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        if (found := size(now)) == known:
            break
        known = found
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select("root", "root").distinct())
