"""The thin queries opN_<name> over whole tables, each through its operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from accrete.llm import chat_format, decontamination, html_text, line_dedup, near_dedup, quality_rules, secret_scan, sentence_pieces, substring_dedup, url_filter
from accrete.llm.oracles import ORACLES  # noqa: F401
from accrete.llm.text import read


def op1_sentence_pieces(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return sentence_pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op2_url_filter(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages).select("page_id", "host", "path", "rule", "verdict", "score")


def op3_chat_format(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    chats = chat_format.format_chats(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.withColumn("_loss", F.array_join("loss_texts", "")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_decontamination(spark, sf_dir):
    return decontamination.leaks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))


def op5_html_text(spark, sf_dir):
    return html_text.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", F.col("main_text").alias("text"), "n_chars")


def op6_line_dedup(spark, sf_dir):
    left = line_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op7_secret_scan(spark, sf_dir):
    found = secret_scan.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in secret_scan.BASE_KINDS], F.sha2(shown(base), 256).alias("base_sha256"), shown("spans").alias("spans"))


def op8_substring_dedup(spark, sf_dir):
    left = substring_dedup.remove(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_near_dedup(spark, sf_dir):
    grouped = near_dedup.groups(read(spark, sf_dir, "documents").select("doc_id", "text"), size=4, percent=80)
    return grouped.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op10_quality_rules(spark, sf_dir):
    judged = quality_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by"))


QUERIES = {f.__name__: f for f in (op1_sentence_pieces, op2_url_filter, op3_chat_format, op4_decontamination, op5_html_text, op6_line_dedup, op7_secret_scan, op8_substring_dedup, op9_near_dedup, op10_quality_rules)}

