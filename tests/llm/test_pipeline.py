"""The pipeline on a small corpus with planted cases, stage by stage and as a whole."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import edited, prose


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    item = prose(45, 900)
    long = prose(150, 901)
    texts = [long, long, edited(long, 3, 1), prose(80, 902), prose(60, 903) + "\n" + item, "too short", None, "junk " * 100, prose(70, 904) + "\n" + prose(40, 905), prose(70, 906) + "\n" + edited(prose(40, 905), 1, 2), ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [{0, 1, 2, 3, 4, 8, 9}, {0, 1, 2, 3, 4, 8, 9}, None, None, None]
    seen = []
    for (name, stage), ids in zip(corpus_pipeline.STAGES, kept, strict=True):
        got = stage(spark, docs, sf_dir)
        rows = {r["doc_id"]: r for r in got.collect()}
        if ids is not None:
            assert set(rows) == ids, name
        if name != "sentence_pieces":
            assert got.columns == docs.columns
            docs = spark.createDataFrame(list(rows.values()), docs.schema)
        seen.append(rows)
    lines = seen[1]
    # document 1 repeats document 0's only line, 2 nearly so, 9 repeats a line of 8 nearly
    assert lines[0]["text"] == prose(150, 901)
    assert (lines[1]["text"], lines[2]["text"]) == ("", "")
    assert lines[9]["text"] == prose(70, 906)
    assert lines[9]["n_chars"] == len(prose(70, 906))
    assert 4 not in seen[3]
    assert {0, 3, 8, 9} <= set(seen[4])


def test_run_is_the_stages_together(spark, sf_dir):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert {0, 3, 8, 9} <= set(got)
    assert 4 not in got
    ids = library.encode(prose(80, 902), add_bos=True, add_eos=True)
    assert got[3]["n_tokens"] == len(ids)
    assert got[3]["ids_sha256"] == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()


def test_empty_documents(spark, sf_dir, tmp_path):
    for table in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").where(F.lit(False)).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
