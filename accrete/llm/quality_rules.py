"""Quality rules whose cutoffs come from labelled documents with a bounded risk of rejecting good ones.

Every rule is a rate over the whole text with a fixed ladder of cutoffs, from the most lenient to the strictest. For each
stratum (the document's language, or "other") and each rule the labelled documents give, per cutoff, how many good ones
it would reject. A cutoff is accepted while the exact binomial tail says that the true share of rejected good documents
exceeds the rule's allowance only with probability delta / (strata x rules): Bonferroni across strata and rules, a fixed
sequence along the ladder (it stops at the first cutoff that fails). The rules' allowances add up to alpha, so that by
the union bound the rules together reject at most alpha of the good documents of a stratum, with confidence 1 - delta.
That holds for every accepted cutoff at once; of these the one is taken that rejects the most labelled bad documents,
each rejected good one counting against COST of them, the most lenient of equals, and none where that isn't worth it.

Everything is a DataFrame expression: one aggregation of the labelled rows to counts per stratum, rule and rung, whose
size is fixed by these lists, and one scan of all documents against at most len(STRATA) rows of cutoffs.

Defined results: null or blank text has no words and fails the base rule; a null or unlisted language is "other"; null
qualities don't count as labels, and several labels of one document count as its lowest; without labels no rule of the
method rejects. Repeated doc_ids stay separate rows. `judge` returns no other columns; `keep_good` returns all columns as
they were, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from accrete.llm.text import SPACE, count_of, words
from accrete.session import cut

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊÇÑÁÍÓÚ"
COST = 10
STRATA = ("en", "de", "fr", "es")
#: Each rule's rate and its ladder, lenient first.
LADDERS = {
    "symbols_per_word": (2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25, 0.15, 0.1),
    "marks_per_word": (2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25, 0.15),
    "upper_share": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "dup_line_share": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "repeat_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
    "bar_line_share": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "single_word_share": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "mean_word_chars": (30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.0),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_repeated_words(docs: DataFrame, hashes: str, name: str) -> DataFrame:
    """docs with the number of words inside windows of WINDOW words whose like occurs twice or more.

    hashes: the column of one 64-bit hash a window start. Each step is a column of its own, as an expression inside a
    lambda is computed again for every element.
    """
    n = F.size(hashes)
    repeats = F.size(F.array_distinct(hashes)) < n
    pairs = F.when(repeats, F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    same = lambda p, k: F.coalesce(p["h"] == F.get("_pairs", k)["h"], F.lit(False))
    shared = F.filter("_pairs", lambda p, k: same(p, k - 1) | same(p, k + 1))
    gap = lambda i, k: F.least(F.coalesce(F.get("_at", k + 1) - i, F.lit(WINDOW)), F.lit(WINDOW))
    covered = F.aggregate(F.transform("_at", gap), F.lit(0), lambda s, g: s + g)
    docs = docs.withColumn("_pairs", pairs).withColumn("_shared", shared).withColumn("_at", F.sort_array(F.transform("_shared", lambda p: p["i"])))
    return docs.withColumn(name, F.coalesce(covered, F.lit(0)).cast("long")).drop("_pairs", "_shared", "_at")


def features(docs: DataFrame) -> DataFrame:
    """docs with the counts of COUNTS, base_failed and the rates of LADDERS."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.drop(*COUNTS, *LADDERS, "base_failed", "_text", "_words", "_lines", "_windows", "_hashes", "_capitals", "_marks", "_bars")
    got = docs.withColumn("_text", text).withColumn("_words", words(F.col("_text")))
    got = got.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w))).withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0))
    # the hash of a window from those of its halves, three times; at the text's end nulls stand in, and that part is cut off
    for width in (1, 2, 4):
        got = got.withColumn("_windows" if width == 4 else f"_h{width}", F.zip_with("_hashes" if width == 1 else f"_h{width // 2}", F.slice("_hashes" if width == 1 else f"_h{width // 2}", 1 + width, F.greatest(F.size("_hashes") - width, F.lit(0))), lambda x, y: F.xxhash64(x, y)))
    got = got.select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.slice("_windows", 1, F.greatest(F.size("_hashes") - WINDOW + 1, F.lit(0))).alias("_windows"),
        F.size("_lines").alias("_lines"),
        F.size(F.filter("_lines", lambda x: F.contains(x, F.lit(" | ")))).alias("_bars"),
        F.size(F.array_distinct("_hashes")).alias("_kinds"),
        F.regexp_replace("_text", f"[^{SYMBOLS}{CAPITALS}!?]+", "").alias("_signs"),
    )
    got = got.withColumns({"n_symbols": count_of(F.col("_signs"), SYMBOLS).cast("long"), "_capitals": count_of(F.col("_signs"), CAPITALS), "_marks": count_of(F.col("_signs"), "!?")})
    got = with_repeated_words(got, "_windows", "n_repeat_words")
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    per_line = lambda c: F.col(c) / F.greatest(F.col("_lines"), F.lit(1))
    rates = {
        "symbols_per_word": per_word("n_symbols"),
        "marks_per_word": per_word("_marks"),
        "upper_share": F.col("_capitals") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_line_share": per_line("n_dup_lines"),
        "repeat_share": per_word("n_repeat_words"),
        "bar_line_share": per_line("_bars"),
        "single_word_share": F.lit(1.0) - per_word("_kinds"),
        "mean_word_chars": per_word("word_chars"),
    }
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return got.select(*docs.columns, *COUNTS, failed.alias("base_failed"), *[v.alias(k) for k, v in rates.items()])


def stratum(lang: Column) -> Column:
    return F.when(lang.isin(*STRATA), lang).otherwise(F.lit("other"))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of X ~ Binomial(n, p), summed in logarithms; 1 where k / n is p or more (the test can't pass there)."""
    zero = F.struct((n * F.lit(p) * 0 + n * F.log1p(F.lit(-p))).alias("term"), (n * F.log1p(F.lit(-p))).alias("sum"))

    def step(s, i):
        term = s["term"] + F.log((n - i + 1) / i) + F.log(F.lit(p)) - F.log1p(F.lit(-p))
        high, low = F.greatest(s["sum"], term), F.least(s["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    summed = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), zero, step, lambda s: F.exp(s["sum"]))
    return F.when((n == 0) | (k >= n * p), F.lit(1.0)).otherwise(summed)


def fit(rates: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """One row a stratum that has labels: the accepted cutoff of each rule (null: none). rates: from `features`."""
    allowed, tests = alpha / len(LADDERS), (len(STRATA) + 1) * len(LADDERS)
    labels = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    judged = rates.select("doc_id", stratum(F.col("lang")).alias("stratum"), *LADDERS).join(labels, "doc_id")
    rung = lambda rule, cuts: sum((F.col(rule) > c).cast("int") for c in cuts)  # noqa: E731  how many rungs reject it
    rungs = F.array(*[F.struct(F.lit(rule).alias("rule"), rung(rule, cuts).alias("rung")) for rule, cuts in LADDERS.items()])
    good = (F.col("_quality") > 0).cast("long")
    counts = judged.select("stratum", good.alias("good"), F.explode(rungs).alias("r")).groupBy("stratum", "r.rule", "r.rung").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    # what step j rejects (from 1, lenient first) lies above len - j + 1 rungs or more, as the ladder falls
    ladder = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(j).alias("step"), F.lit(float(c)).alias("cutoff"), F.lit(len(cuts) - j + 1).alias("least")) for rule, cuts in LADDERS.items() for j, c in enumerate(cuts, 1)])
    by = counts.groupBy("stratum", "rule").agg(F.sum("good").alias("n"), F.collect_list(F.struct("rung", "good", "bad")).alias("at"))
    above = lambda which: F.aggregate("at", F.lit(0).cast("long"), lambda a, x: a + F.when(x["rung"] >= F.col("s.least"), x[which]).otherwise(0))
    steps = by.select("*", F.explode(ladder).alias("s")).where("s.rule = rule").select("stratum", "rule", "n", "s.step", "s.cutoff", above("good").alias("good"), above("bad").alias("bad"))
    tested = steps.withColumn("passes", binomial_tail(F.col("good"), F.col("n"), allowed) <= delta / tests)
    in_turn = Window.partitionBy("stratum", "rule").orderBy("step")
    accepted = tested.withColumn("passes", F.min("passes").over(in_turn)).withColumn("worth", F.col("bad") - COST * F.col("good")).where("passes and worth > 0")
    best = accepted.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct("worth", -F.col("step"))).alias("cutoff"))
    return best.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"cut_{rule}") for rule in LADDERS])


def verdicts(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    """measured (from `features`) with rejected_by (the method's rules that reject) and kept."""
    # at most len(STRATA) + 1 rows of len(LADDERS) numbers, whatever the input
    got = measured.withColumn("_stratum", stratum(F.col("lang"))).join(F.broadcast(cuts.withColumnRenamed("stratum", "_stratum")), "_stratum", "left")
    # one expression of both sides: a filter on kept stays above the join, as below it all features would be computed again
    reasons = F.array_compact(F.array(F.when(F.col("base_failed"), F.lit("base")), *[F.when(F.col(rule) > F.col(f"cut_{rule}"), F.lit(rule)) for rule in LADDERS]))
    got = got.withColumn("_reasons", reasons).withColumn("rejected_by", F.array_remove("_reasons", "base")).withColumn("kept", F.size("_reasons") == 0)
    return got.drop("_stratum", "_reasons", *[f"cut_{r}" for r in LADDERS])


def judge(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Per document its counts, base_failed, rejected_by and kept, without its text.

    Measured once: a few numbers a document are written to the checkpoint folder, for the cutoffs and for the verdicts.
    """
    measured = cut(features(docs.select("doc_id", "lang", "text")).drop("text"))
    return verdicts(measured, fit(measured, labels, alpha, delta))


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs; texts are scanned twice instead of being written."""
    cuts = cut(fit(features(docs.select("doc_id", "lang", "text")).drop("text"), labels, alpha, delta))
    whole = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "lang", "text")
    return verdicts(features(whole), cuts).where("kept").select("_row.*")
