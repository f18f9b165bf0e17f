"""URL filters: exact rules first, then the ratio of two character language models.

Rules name a host and a path prefix; a rule fits its host and all subdomains, and the longest rule that fits decides.
For the other URLs two smoothed variable-order Markov models, of accepted and of rejected URLs, give log-likelihoods: the
probability of a character after up to ORDER - 1 others is interpolated with that after one fewer, down to a uniform one.
The difference, divided by the number of characters, is the score. The threshold is calibrated on accepted URLs that
the models haven't seen: at least the share KEEP of these URLs lies at it or below, to STEP of the score.

Labels: the models learn from the rules' verdicts. URLs that a rule blocks are rejected, as are those whose host has a
word of SEEDS; all others are accepted, which takes the many that nothing speaks against for what they most likely are.
All counts cover all URLs, each as often as it occurs. URLs are first counted by their spelling with digits folded, models are tables
of character sequences built by aggregations, and scores are a join on those sequences, in SALTS shares of the
spellings, so that a sequence of all URLs is no hot key. No Python.

Defined results: null, empty or malformed URLs have an empty host and path, no rule, a null score and the verdict allow;
repeated rows are judged alike; without rejected or without accepted examples every score is 0 and the verdict allow.
URLs of any length are read whole. Other columns are carried along; those named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from accrete.llm.text import lower_ascii
from accrete.session import cut

#: Verdict, host and path of each rule.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SEEDS = ("spam", "casino", "pills", "porn", "viagra", "bets", "loan", "xxx")
ORDER = 4
PRIOR = 4.0
ALPHABET = 96
KEEP, STEP = 0.995, 1e-4
HELD_OUT = 5
SALTS = 16
LABELS = ("accepted", "rejected")


def host(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct of rule and verdict of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def spelling(host: Column, path: Column) -> Column:
    """What the models read: digits folded."""
    return F.regexp_replace(F.concat(host, path), "[0-9]+", "0")


def sequences(text: Column) -> Column:
    """ORDER characters up to each character of a text, after a start that no URL holds."""
    padded = F.concat(F.lit("\x02" * (ORDER - 1)), text)
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(padded, i, F.lit(ORDER))))


def model(counts: DataFrame) -> DataFrame:
    """gram and llr: the log ratio of a sequence's last character under the models of rejected and accepted URLs.

    counts: gram, accepted and rejected, one row a sequence that occurs anywhere. Level k has the chance of a character
    after k - 1 others; it is joined from the counts of k characters, of the k - 1 before, and level k - 1.
    """
    sums = [F.sum(c).alias(c) for c in LABELS]
    level = counts.agg(*[F.sum(c).alias(f"_all_{c}") for c in LABELS]).select(F.lit("").alias("seen"), *[F.lit(1.0 / ALPHABET).alias(f"p_{c}") for c in LABELS])
    for k in range(1, ORDER + 1):
        seen = counts.select(F.substring("gram", ORDER - k + 1, k).alias("seen"), *LABELS).groupBy("seen").agg(*sums)
        seen = seen.withColumn("_after", F.substring("seen", 1, k - 1)).withColumn("_shorter", F.substring("seen", 2, k - 1))
        after = seen.groupBy("_after").agg(*[F.sum(c).alias(f"_before_{c}") for c in LABELS])
        joined = seen.join(after, "_after").join(level.withColumnRenamed("seen", "_shorter"), "_shorter")
        level = joined.select("seen", *[((F.col(c) + PRIOR * F.col(f"p_{c}")) / (F.col(f"_before_{c}") + PRIOR)).alias(f"p_{c}") for c in LABELS])
    total = counts.agg(F.min_by("gram", "gram").alias("_any"), *[F.sum(c).alias(c) for c in LABELS]).select((F.col("accepted") > 0).alias("_a"), (F.col("rejected") > 0).alias("_r"))
    # one row
    return level.crossJoin(F.broadcast(total)).select(F.col("seen").alias("gram"), F.when(F.col("_a") & F.col("_r"), F.log("p_rejected") - F.log("p_accepted")).otherwise(0.0).alias("llr"))


def scores(spelt: DataFrame) -> DataFrame:
    """spelt (_spelling, n, _bad, _held) with score."""
    grams = spelt.select("*", F.explode(sequences(F.col("_spelling"))).alias("gram"))
    trained = [F.sum(F.when(~F.col("_held") & (F.col("_bad") == k), F.col("n")).otherwise(0)).alias(c) for k, c in enumerate(LABELS)]
    ratios = cut(model(grams.groupBy("gram").agg(*trained))).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = grams.withColumn("_salt", F.pmod(F.xxhash64("_spelling"), F.lit(SALTS)).cast("int"))
    return salted.join(ratios, ["gram", "_salt"]).groupBy("_spelling", "n", "_bad", "_held").agg((F.sum("llr") / F.count("*")).alias("score"))


def threshold(scored: DataFrame, keep: float = KEEP) -> DataFrame:
    """_line, one row: the least multiple of STEP, 0 or more, that the share `keep` of the held-out accepted URLs doesn't exceed.

    The window runs over distinct multiples of STEP, whose number the range of scores bounds.
    """
    held = scored.where("_held and _bad = 0").groupBy(F.ceil(F.col("score") / STEP).alias("_step")).agg(F.sum("n").alias("n"))
    far = held.withColumn("_upto", F.sum("n").over(Window.orderBy("_step"))).withColumn("_all", F.sum("n").over(Window.partitionBy()))
    least = far.where(F.col("_upto") >= keep * F.col("_all")).agg(F.min("_step").alias("_step"))
    return least.select(F.greatest(F.coalesce("_step", F.lit(0)) * STEP, F.lit(0.0)).alias("_line"))


def judge(pages: DataFrame, rules=RULES, seeds=SEEDS, keep: float = KEEP) -> DataFrame:
    """pages (with url) with host, path, rule, score and verdict."""
    pages = pages.drop("host", "path", "rule", "verdict", "score", "_spelling", "_rule")
    pages = pages.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url"))).withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    pages = pages.withColumn("_spelling", spelling(F.col("host"), F.col("path")))
    rejected = F.coalesce(F.col("_rule.verdict") == "block", F.lit(False))
    for s in seeds:
        rejected = rejected | F.contains(F.col("host"), F.lit(s))
    counted = pages.where("_spelling <> ''").groupBy("_spelling", rejected.cast("int").alias("_bad")).agg(F.count("*").alias("n"))
    # digits folded, a spelling can have both labels, as a rule's path may hold a digit
    spelt = counted.withColumn("_held", F.pmod(F.xxhash64("_spelling"), F.lit(HELD_OUT)) == 0)
    scored = cut(scores(cut(spelt)))
    by_spelling = scored.groupBy("_spelling").agg(F.min("score").alias("score"))
    got = pages.join(by_spelling, "_spelling", "left").crossJoin(F.broadcast(threshold(scored, keep)))  # one row
    by_model = F.when(F.col("score") > F.col("_line"), F.lit("block")).otherwise(F.lit("allow"))
    return got.withColumn("rule", F.col("_rule.rule")).withColumn("verdict", F.coalesce(F.col("_rule.verdict"), by_model)).drop("_rule", "_spelling", "_line")
