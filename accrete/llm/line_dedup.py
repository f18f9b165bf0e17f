"""Fuzzy line dedup: MinHash of character shingles, banding, exact Jaccard verification, union-find.

A line is what lies between line feeds, compared without white space around it; lines without a word aren't judged. A
line's shingles are its runs of SHINGLE characters, one at every character (a shorter line is one shingle). Two lines are
alike if the Jaccard similarity of these sets is SIMILAR or more; components of alike lines keep their first line, by
doc_id and then by place, and the others go.

1. Every line gets a 64-bit id (its hash), so that equal lines are one from here on, and band keys of its signature. The
   signature of a line with few words, or with few words for its length, is that of all its shingles. For other lines it is that
   of the shingles at word starts, a sample by content of SAMPLED or more; lines near the border have both, so that two
   alike lines have one in common. The sampled hashes lie on a circle; from each of BANDS fixed points on it, the next ROWS
   hashes of the line are one key: the ROWS least under the order that starts there. Two sets of similarity s agree in a
   band with a probability of about s ** ROWS: a pair at 0.8 is missed with 0.002, at 0.9 with 1e-5.
2. Lines that share a key are candidates. A bucket of up to BUCKET lines compares all its pairs; in a larger one every line
   is compared with the bucket's leader first. Where a line of a large bucket isn't alike to its leader, the bucket's lines are banded
   once more by all their shingles with FINE_ROWS hashes a key and FINE_BANDS keys (a pair at 0.8 is missed with 0.001), which tells
   lines of one template apart. Of these buckets too, small ones compare all pairs and large ones each line with the leader; every
   bucket has a leader of its own, so that a line of a large group meets up to FINE_BANDS of them. What then isn't of one
   component with the leader of its large bucket is compared with all the bucket's lines of other components, in pairs of blocks of about
   BLOCK lines, by parity bitmaps of the sets: these differ in no more bits than the sets do in shingles, so that no
   pair at `similar` is lost and only pairs near it are told. That is n lines times those outside of the leader's component, for each bucket.
3. The full shingle sets of candidates decide, and components are found by star contraction. The places of candidates are
   broadcast to where lines are split if they are MOST_SENT or fewer (counted first), and joined otherwise.

Everything is a DataFrame expression. Groups of equal lines are aggregated before any shuffle; no bucket is gathered
beyond BUCKET ids, or a block of it.

Defined results: null text has no lines and stays null; blank lines stay; text without lines to remove is unchanged, to
the byte; repeated doc_ids are told apart by their text's hash only, equal rows are one document; null doc_ids come first;
lines of any length are read whole; other columns are carried along, n_chars is counted anew where docs has it, and columns
named n_lines or n_removed are replaced.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accrete.llm.components import components
from accrete.llm.text import SPACE, upto
from accrete.session import cut

SHINGLE, SIMILAR = 9, 0.8
BANDS, ROWS = 12, 4
FINE_BANDS, FINE_ROWS = 40, 8
#: Sets up to this size have a key from each of their hashes on.
FEW = 16
#: Distinct word starts from which on they stand for a line, and characters a word start; below and above the first and second
#: of each pair only one of both signatures is made.
SAMPLED, SPARSE = (16, 24), (12, 16)
MOST_SENT = 300_000
BUCKET = 8
#: Lines a block, and longs a parity bitmap.
BLOCK, LONGS = 128, 16


def shingles(line: Column) -> Column:
    """Distinct hashes of a line's shingles."""
    # of four bytes a character, so that each is found at once; the outer array makes the bytes once for all shingles
    at = F.sequence(F.lit(1), F.greatest(4 * (F.length(line) - SHINGLE) + 1, F.lit(1)), F.lit(4))
    runs = F.transform(F.array(F.encode(line, "UTF-32")), lambda b: F.transform(at, lambda i: F.xxhash64(F.substring(b, i, F.lit(4 * SHINGLE)))))
    return F.array_distinct(F.get(runs, F.lit(0)))


def places(hashes: Column, points: list[int]) -> Column:
    """How many of the sorted hashes are below each of the ascending points."""
    among = F.sort_array(F.concat(hashes, F.array(*[F.lit(x).cast("long") for x in points])))
    # a point's place among hashes and points, less the points before it; the outer array sorts once for all points
    return F.array(*[(F.array_position(among, F.lit(x).cast("long")) - 1 - k).cast("int") for k, x in enumerate(points)])


def with_keys(lines: DataFrame, name: str, bands: int, rows: int) -> DataFrame:
    """lines (with set: hashes) with the column `name`: the distinct keys of its bands; null if set is."""
    starts = [-(1 << 63) + k * ((1 << 64) // bands) for k in range(bands)]
    lines = lines.withColumn("set", F.sort_array("set"))
    # the place of the first hash from each point on: the point's place among hashes and points, less the points before it
    among = lines.withColumn("_among", F.sort_array(F.concat("set", F.array(*[F.lit(x).cast("long") for x in starts]))))
    first = [(F.array_position("_among", F.lit(x).cast("long")) - 1 - k).cast("int") for k, x in enumerate(starts)]
    every = F.sequence(F.lit(0), F.size("set") - 1)
    lines = among.withColumn("_at", F.when(F.size("set") <= FEW, every).otherwise(F.array_distinct(F.array(*[x % F.size("set") for x in first]))))
    keys = F.transform("_at", lambda i: F.xxhash64(F.lit(name), *[F.get("set", (i + k) % F.size("set")) for k in range(rows)]))
    return lines.withColumn(name, F.when(F.col("set").isNotNull(), keys)).drop("_among", "_at", "set")


def signed(lines: DataFrame) -> DataFrame:
    """lines (with line) with keys: those of the signatures that it has."""
    parts = lines.withColumn("_chars", F.length("line")).withColumn("_n", F.col("_chars") - F.length(F.replace("line", F.lit(" "))) + 1)
    parts = parts.withColumn("_words", F.when(F.col("_n") >= SAMPLED[0], F.split("line", " ")))
    half = (SHINGLE + 1) // 2
    begins = F.zip_with("_words", F.slice("_words", 2, 1 << 30), lambda a, b: F.xxhash64(F.left(a, F.lit(SHINGLE)), F.left(b, F.lit(half))))
    parts = parts.withColumn("_starts", F.array_distinct(begins)).withColumn("_n", F.coalesce(F.size("_starts"), F.lit(0)))
    whole = (F.col("_n") < SAMPLED[1]) | (F.col("_chars") > SPARSE[0] * F.col("_n"))
    sampled = (F.col("_n") >= SAMPLED[0]) & (F.col("_chars") <= SPARSE[1] * F.col("_n"))
    got = with_keys(parts.withColumn("set", F.when(sampled, F.col("_starts"))).drop("_words", "_starts"), "_sampled", BANDS, ROWS)
    got = with_keys(got.withColumn("set", F.when(whole, shingles(F.col("line")))), "_whole", BANDS, ROWS)
    none = F.array().cast("array<bigint>")
    return got.withColumn("keys", F.concat(F.coalesce("_sampled", none), F.coalesce("_whole", none))).drop("_sampled", "_whole", "_n", "_chars")


def _lines(docs: DataFrame) -> DataFrame:
    """doc, at, line and id of every line that is judged; doc tells a row of docs apart."""
    split = docs.select("doc", F.posexplode_outer(F.split("text", "\n")).alias("at", "line"))
    return split.withColumn("line", F.btrim("line", F.lit(SPACE))).where("line <> ''").withColumn("id", F.xxhash64("line"))


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def buckets(keyed: DataFrame) -> DataFrame:
    """key, id, members and leader of each bucket with two lines or more. keyed: id and keys, one row an id.

    Each bucket has a leader of its own choice, so that a line of a large group meets many.
    """
    rows = keyed.select("id", F.explode_outer("keys").alias("key")).repartition("key")
    several = rows.groupBy("key").agg(F.count("*").alias("members"), F.min_by("id", F.xxhash64("id", "key")).alias("leader")).where("members > 1")
    # most keys have one line: a hash table of the others spares sorting all rows
    return cut(rows.join(several.hint("shuffle_hash"), "key"))


def candidates(shared: DataFrame) -> DataFrame:
    """Pairs a < b: all of small buckets, and each line of a large one with its leader. shared: from `buckets`."""
    small = shared.where(F.col("members") <= BUCKET).groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    pairs = small.select(F.explode(F.flatten(F.transform("ids", lambda a, i: F.transform(F.slice("ids", i + 2, BUCKET), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p")).select("p.a", "p.b")
    return pairs.union(shared.where((F.col("members") > BUCKET) & (F.col("id") != F.col("leader"))).select(*_ordered("id", "leader"))).distinct()


def alike(pairs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """Those pairs whose shingle sets are similar enough. texts: id and line of every id in a pair."""
    # texts travel and not sets, which are ten times as large
    both = pairs.join(texts.withColumnsRenamed({"id": "a", "line": "_a"}), "a").join(texts.withColumnsRenamed({"id": "b", "line": "_b"}), "b")
    sets = both.select("a", "b", shingles(F.col("_a")).alias("_a"), shingles(F.col("_b")).alias("_b"))
    common = F.size(F.array_intersect("_a", "_b"))
    # written before it is filtered: a filter would be pushed down to the texts and make each set several times
    judged = cut(sets.select("a", "b", (common >= similar * (F.size("_a") + F.size("_b") - common)).alias("near")))
    return judged.where("near").select("a", "b")


def unsettled(shared: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of large buckets in which some line isn't joined to the leader by an edge."""
    large = shared.where(F.col("members") > BUCKET)
    far = large.where(F.col("id") != F.col("leader")).select("key", *_ordered("id", "leader")).join(edges, ["a", "b"], "left_anti")
    return cut(large.join(far.select("key").distinct(), "key", "left_semi"))


def with_bitmap(lines: DataFrame) -> DataFrame:
    """lines (with set: hashes) with n, the set's size, and bits: longs whose bits are the parities of how many hashes fall on each."""
    points = [F.lit(-(1 << 63) + k * ((1 << 64) // LONGS)).cast("long") for k in range(LONGS)]
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))
    # a long takes the hashes from one point to the next, which lie together in the sorted set, so that each hash is met once
    lines = lines.withColumn("set", F.sort_array("set")).withColumn("n", F.size("set"))
    lines = lines.withColumn("_among", F.sort_array(F.concat("set", F.array(*points))))
    lines = lines.withColumn("_at", F.array(*[(F.array_position("_among", x) - 1 - k).cast("int") for k, x in enumerate(points)], "n"))
    part = lambda k: F.slice("set", F.get("_at", F.lit(k)) + 1, F.get("_at", F.lit(k + 1)) - F.get("_at", F.lit(k)))
    bits = F.array(*[F.aggregate(part(k), F.lit(0).cast("long"), lambda acc, h: acc.bitwiseXOR(bit(h))) for k in range(LONGS)])
    return lines.withColumn("bits", bits).drop("_among", "_at")


def may(x: Column, y: Column, similar: float) -> Column:
    """Whether the bitmaps allow that the sets are similar; x and y: structs with n and bits."""
    # similar sets differ in (1 - similar) / (1 + similar) of their sizes' sum at most; the small number is for rounding
    apart = reduce(add, [F.bit_count(x["bits"][k].bitwiseXOR(y["bits"][k])) for k in range(LONGS)])
    return apart * (1 + similar) <= (x["n"] + y["n"]) * (1 - similar) + 1e-6


def near_bitmaps(pairs: DataFrame, drawn: DataFrame, similar: float) -> DataFrame:
    """Those pairs a, b whose bitmaps allow the similarity. drawn: id, n and bits."""
    side = lambda x: drawn.select(F.col("id").alias(x), F.struct("n", "bits").alias(f"_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(may(F.col("_a"), F.col("_b"), similar)).select("a", "b")


def blocks(shared: DataFrame, drawn: DataFrame, roots: DataFrame) -> DataFrame:
    """key, home, block, lines and the bucket's numbers of blocks, of large buckets that hold several components.

    home: the lines are of the leader's component. drawn: id, n and bits; roots: from `components`.
    """
    large = shared.where(F.col("members") > BUCKET).select("key", "id", "leader")
    placed = large.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").join(roots.select(F.col("node").alias("leader"), F.col("root").alias("led")), "leader", "left")
    root = F.coalesce("root", "id")
    placed = cut(placed.select("key", "id", root.alias("root"), (root == F.coalesce("led", "leader")).alias("home")))
    many = lambda of: F.ceil(F.count_if(of) / BLOCK).cast("int")
    counts = placed.groupBy("key").agg(many(F.col("home")).alias("homes"), many(~F.col("home")).alias("others")).where("others > 0")
    dealt = placed.join(counts, "key").withColumn("block", F.pmod(F.xxhash64("id", "key"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("others"))).cast("int"))
    line = F.struct("id", "root", "n", "bits")
    return cut(dealt.join(drawn, "id").groupBy("key", "home", "block", "homes", "others").agg(F.collect_list(line).alias("lines")))


def across(parts: DataFrame, similar: float) -> DataFrame:
    """Pairs a < b of one bucket and several components whose bitmaps allow the similarity. parts: from `blocks`."""
    meets = lambda home, first, n: F.transform(upto(n - first), lambda k: F.struct(F.lit(home).alias("home"), (k + first).alias("block")))
    targets = F.explode(F.concat(meets(False, F.col("block"), F.col("others")), meets(True, F.lit(0), F.col("homes"))))
    ours = parts.where("not home").select("key", F.col("lines").alias("_ours"), targets.alias("_to")).select("key", "_ours", "_to.home", "_to.block")

    pair = lambda x, y: F.struct(F.least(x["id"], y["id"]).alias("a"), F.greatest(x["id"], y["id"]).alias("b"))
    found = F.flatten(F.transform("_ours", lambda x: F.transform(F.filter("lines", lambda y: (x["root"] != y["root"]) & may(x, y, similar)), lambda y: pair(x, y))))
    return ours.join(parts.select("key", "home", "block", "lines"), ["key", "home", "block"]).select(F.explode(found).alias("p")).select("p.a", "p.b").distinct()


def links(known: DataFrame, lines: DataFrame, similar: float) -> DataFrame:
    """Edges a, b that join the ids of alike lines. known: id, first (doc and at) and keys; lines: from `_lines`."""
    shared = buckets(known)
    pairs = cut(candidates(shared))
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().join(known.select("id", "first"), "id").select("id", F.col("first.doc").alias("doc"), F.col("first.at").alias("at"))
    wanted = cut(wanted)
    sent = F.broadcast(wanted) if wanted.count() <= MOST_SENT else wanted
    texts = cut(lines.drop("id").join(sent, ["doc", "at"]).select("id", "line"))
    edges = alike(pairs, texts, similar)
    if shared.where(F.col("members") > BUCKET).isEmpty() or (open_rows := unsettled(shared, edges)).isEmpty():
        return edges
    again = texts.join(open_rows.select("id").distinct(), "id").withColumn("set", shingles(F.col("line")))
    drawn = cut(with_keys(with_bitmap(again), "keys", FINE_BANDS, FINE_ROWS).drop("line"))
    fine = buckets(drawn.select("id", "keys"))
    apart = cut(candidates(fine).join(pairs, ["a", "b"], "left_anti"))
    drawn = drawn.select("id", "n", "bits")
    edges = cut(edges.union(alike(near_bitmaps(apart, drawn, similar), texts, similar)))
    if fine.where(F.col("members") > BUCKET).isEmpty():
        return edges
    parts = blocks(fine, drawn, components(edges))
    if parts.isEmpty():
        return edges
    last = cut(across(parts, similar).join(pairs.union(apart), ["a", "b"], "left_anti"))
    return cut(edges.union(alike(last, texts, similar)))


def repeated_lines(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc and at of each line that goes. docs: doc (orderable, one a row) and text."""
    lines = _lines(docs)
    described = signed(lines).select("id", F.struct("doc", "at").alias("place"), "keys")
    # written once: the counts of keys and the join need other columns of it, so that Spark would compute it for each
    known = cut(described.groupBy("id").agg(F.min("place").alias("first"), F.count("*").alias("times"), F.first("keys").alias("keys")))
    roots = components(links(known, lines, similar)).withColumnRenamed("node", "id")
    known = known.select("id", "first", "times")
    linked = known.join(roots, "id")
    firsts = linked.groupBy("root").agg(F.min("first").alias("kept"))
    repeated = known.where("times > 1").join(roots, "id", "left_anti").select("id", F.col("first").alias("kept"))
    doubtful = linked.join(firsts, "root").select("id", "kept").union(repeated)
    return lines.select("doc", "at", "id").join(doubtful, "id").where(F.struct("doc", "at") != F.col("kept")).select("doc", "at")


def dedup(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """docs with the text's repeated lines removed, and with n_lines and n_removed (lines judged and lines gone)."""
    keyed = docs.select(F.struct(*docs.columns).alias("_row")).withColumn("doc", F.struct(F.col("_row.doc_id").alias("doc_id"), F.xxhash64("_row.text").alias("text")))
    gone = repeated_lines(keyed.select("doc", F.col("_row.text").alias("text")), similar).groupBy("doc").agg(F.collect_set("at").alias("_gone"))
    got = keyed.join(gone.select(F.col("doc.doc_id").alias("_id"), F.col("doc.text").alias("_hash"), "_gone"), F.col("_id").eqNullSafe(F.col("doc.doc_id")) & (F.col("_hash") == F.col("doc.text")), "left")
    text = F.col("_row.text")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    got = got.withColumn("_text", F.when(F.col("_gone").isNull(), text).otherwise(kept))
    judged = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)).cast("long")
    shown = {c: F.col(f"_row.{c}") for c in docs.columns}
    shown["text"] = F.col("_text")
    if "n_chars" in docs.columns:
        shown["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    shown |= {"n_lines": judged, "n_removed": F.coalesce(F.size("_gone"), F.lit(0)).cast("long")}
    return got.select(*[column.alias(name) for name, column in shown.items()])
