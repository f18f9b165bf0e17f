"""Benchmark decontamination by the exact similarity of item-sized windows.

1. Gate: the weights of the runs of SHINGLE words that a document shares with an item must sum up to `similar` of the item's
   own, as a smaller sum can't give the similarity. What is left is counted so for each item-sized window that
   holds such a run, wherever it starts in the document; a document shorter than the item is one window.
2. The exact weighted similarity of the shingle multisets decides on each such window: the sum of smaller over the sum of larger
   counts, each shingle weighted by its rarity among the items, ln(1 + items / items that hold it).

There are no fingerprints: windows at 0.8 may differ from their item in any number of SimHash bits, of words and of
weighted runs alike, so that each radius loses some. The gate loses none.

Words are compared in lower case without PUNCTUATION. Everything is a DataFrame expression. The benchmark's tables are
broadcast only if the benchmark has MOST_ITEMS items or fewer (counted first); beyond that they are joined by shuffles.

Defined results: null or blank texts and items match nothing, nor do items of fewer than SHINGLE words; an item of which
a document holds several windows is reported once, with its most similar and then first window; repeated items are
reported by each item_id, repeated doc_ids together; texts of any length are searched whole; other columns are ignored by
`leaks` and carried along by `keep_clean`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accrete.llm.text import words

SHINGLE, SIMILAR = 5, 0.8
#: Similarities are rounded to six places; sums of weights may differ in the last bits.
SLACK = 1e-6
MOST_ITEMS = 20_000
#: Signs that don't tell words apart.
PUNCTUATION = ".,;:!?\"'()[]"


def _hashes(text: Column) -> Column:
    plain = F.translate(text, PUNCTUATION + "ABCDEFGHIJKLMNOPQRSTUVWXYZ", " " * len(PUNCTUATION) + "abcdefghijklmnopqrstuvwxyz")
    return F.transform(words(plain), lambda w: F.xxhash64(w))


def _with_shingles(df: DataFrame) -> DataFrame:
    """df (with hashes) with shingles: the hash of each SHINGLE-word run, from those of its parts."""
    tail = lambda c, k: F.slice(c, 1 + k, F.greatest(F.size("hashes") - k, F.lit(0)))
    df = df.withColumn("_two", F.zip_with("hashes", tail("hashes", 1), lambda x, y: F.xxhash64(x, y)))
    df = df.withColumn("_four", F.zip_with("_two", tail("_two", 2), lambda x, y: F.xxhash64(x, y)))
    df = df.withColumn("_five", F.zip_with("_four", tail("hashes", 4), lambda x, y: F.xxhash64(x, y)))
    return df.withColumn("shingles", F.slice("_five", 1, F.greatest(F.size("hashes") - SHINGLE + 1, F.lit(0)))).drop("_two", "_four", "_five")


def leaks(docs: DataFrame, items: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, item_id, start (a word's place), n_words and similarity of each item that a document holds."""
    items = items.where("item_id is not null").select("item_id", _hashes(F.col("text")).alias("hashes"))
    items = _with_shingles(items).where(F.size("hashes") >= SHINGLE).withColumn("length", F.size("hashes"))
    n_items = items.count()
    small = (lambda df: F.broadcast(df)) if n_items <= MOST_ITEMS else (lambda df: df)
    # shingle counts of the items, weighted by rarity among them
    of_items = items.select("item_id", F.explode("shingles").alias("shingle")).groupBy("item_id", "shingle").agg(F.count("*").alias("there"))
    weight = of_items.groupBy("shingle").agg(F.log1p(n_items / F.count("*")).alias("weight"))
    of_items = of_items.join(weight, "shingle")
    totals = of_items.groupBy("item_id").agg(F.sum(F.col("there") * F.col("weight")).alias("item_total"))
    known = of_items.join(totals, "item_id").join(items.select("item_id", "length").distinct(), "item_id").select("item_id", "length", "item_total", "shingle", "weight")
    # outer, as otherwise a filter on the array's size is pushed below all that makes the array, and computes it many times
    held = _with_shingles(docs.where("doc_id is not null").select("doc_id", _hashes(F.col("text")).alias("hashes"))).select("doc_id", F.xxhash64("hashes").alias("copy"), F.size("hashes").alias("size"), F.posexplode_outer("shingles").alias("pos", "shingle"))
    pair = ["doc_id", "copy", "size", "item_id", "length", "item_total"]
    enough = F.col("held") >= F.col("item_total") * (similar - SLACK) - SLACK
    pairs = held.join(small(known), "shingle").groupBy(*pair).agg(F.sum("weight").alias("held"), F.collect_list(F.struct("pos", "weight")).alias("_at")).where(enough)
    # every start of a window that holds the run; a document shorter than the item is one window
    last = F.greatest(F.col("size") - F.col("length"), F.lit(0))
    first = F.greatest(F.least(F.col("_p.pos") - F.col("length") + SHINGLE, last), F.lit(0))
    starts = pairs.withColumn("_p", F.explode("_at")).select(*pair, "_p.weight", F.explode(F.sequence(first, F.least("_p.pos", last))).alias("start"))
    starts = starts.groupBy(*pair, "start").agg(F.sum("weight").alias("held")).where(enough)
    wanted = starts.groupBy("doc_id").agg(F.collect_list(F.struct("copy", "item_id", "start", "length")).alias("_w"))
    windows = docs.select("doc_id", "text").join(wanted, "doc_id").select("doc_id", "_w", _hashes(F.col("text")).alias("hashes")).withColumn("copy", F.xxhash64("hashes"))
    cut_out = F.transform(F.filter("_w", lambda w: w["copy"] == F.col("copy")), lambda w: F.struct(w["item_id"].alias("item_id"), w["start"].alias("start"), w["length"].alias("length"), F.slice("hashes", w["start"] + 1, w["length"]).alias("hashes")))
    windows = windows.select("doc_id", "copy", F.explode(cut_out).alias("w")).select("doc_id", "copy", "w.*").dropDuplicates(["doc_id", "copy", "item_id", "start", "length"])
    window = ["doc_id", "copy", "item_id", "start", "length", "n_words"]
    here = _with_shingles(windows.withColumn("n_words", F.size("hashes"))).select(*window, F.explode("shingles").alias("shingle")).groupBy(*window, "shingle").agg(F.count("*").alias("here"))
    here = here.join(small(weight), "shingle", "left").join(small(of_items.select("item_id", "shingle", "there")), ["item_id", "shingle"], "left")
    heavy = F.coalesce("weight", F.log1p(F.lit(float(n_items))))
    sums = here.groupBy(*window).agg(F.sum(F.least("here", F.coalesce("there", F.lit(0))) * heavy).alias("common"), F.sum(F.col("here") * heavy).alias("total"))
    scored = sums.join(small(totals), "item_id").withColumn("similarity", F.round(F.col("common") / (F.col("total") + F.col("item_total") - F.col("common")), 6)).where(F.col("similarity") >= similar)
    best = scored.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("start", "n_words", "similarity"), F.struct("similarity", -F.col("start"), "n_words")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.start").cast("long").alias("start"), F.col("b.n_words").cast("long").alias("n_words"), "b.similarity")


def keep_clean(docs: DataFrame, items: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of docs that hold no item, with the columns of docs."""
    gone = leaks(docs.select("doc_id", "text"), items, similar).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
