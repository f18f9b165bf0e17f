"""A corpus pipeline of five stages, each applying one operator to all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers

from accrete.llm import decontamination, line_dedup, near_dedup, quality_rules, sentence_pieces
from accrete.llm.text import read
from accrete.session import cut


def quality(spark, docs, sf_dir):
    """Documents that the rules keep."""
    return quality_rules.keep_good(docs, read(spark, sf_dir, "labels"))


def lines(spark, docs, sf_dir):
    """Documents without lines that repeat an earlier line, exactly or nearly."""
    return line_dedup.dedup(docs).select(*docs.columns)


def near(spark, docs, sf_dir):
    """One document of each group of near duplicates."""
    return near_dedup.keep_first(docs)


def decontaminate(spark, docs, sf_dir):
    """Documents that hold no benchmark item."""
    return decontamination.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def encode(spark, docs, sf_dir):
    """Token counts and digests of what is left."""
    pieces = sentence_pieces.encode(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near), ("decontamination", decontaminate), ("sentence_pieces", encode)]
#: SQL can't express merges by an agenda; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage over documents; what each stage keeps is written to the checkpoint folder in between."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
