import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from accrete.llm import sentence_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
PIECES = sentence_pieces.Pieces(PATH)


def expected(text):
    ids = LIBRARY.encode(text, add_bos=True, add_eos=True)
    return ids, LIBRARY.decode(ids)


def check(text):
    ids = np.frombuffer(PIECES.encode_batch([text])[0], "<u4")
    assert (ids.tolist(), PIECES.decode(ids)) == expected(text)


@pytest.mark.parametrize("text", ["", " ", "   ", "a", " a", "a ", "Hello  world \n\n x", "été ñandú 漢字 🙂", "▁x ▁", "<s> </s> <unk> <0x0A>", "\x00\x01", "ab" * 3000, "x" * 5000, "�\t", "á é"])
def test_like_the_library(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    check(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 31_999), max_size=30))
def test_decodes_any_ids(ids):
    assert PIECES.decode(np.asarray(ids, "<u4")) == LIBRARY.decode(ids)


def test_a_full_store_changes_nothing():
    small = sentence_pieces.Pieces(PATH, kept_bytes=500)
    texts = ["one two three", "two four", "five six two one"] * 2
    assert small.encode_batch(texts) == PIECES.encode_batch(texts)


def test_short_units_need_no_heap(monkeypatch):
    """Their agenda is a list, of the same order as the heap of long units."""
    r = random.Random(3)
    units = ["▁" + "".join(r.choice("abcdeinrstéß漢🙂") for _ in range(n)) for n in range(sentence_pieces.SHORT) for _ in range(20)]
    by_heap = [PIECES.by_heap(u) for u in units]

    def refuse(*_):
        raise AssertionError("a heap")

    monkeypatch.setattr(sentence_pieces.heapq, "heapify", refuse)
    monkeypatch.setattr(sentence_pieces.heapq, "heappop", refuse)
    assert [PIECES.by_list(u) for u in units] == by_heap
    for u in units:
        if u != "▁":
            assert PIECES.merge(u) == LIBRARY.encode(u[1:])
    with pytest.raises(AssertionError, match="a heap"):
        PIECES.merge("▁" + "a" * sentence_pieces.SHORT)


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "same text", None), (4, "same text", "z"), (None, "a " * 9000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {r["doc_id"]: r for r in sentence_pieces.encode(docs, PATH, with_ids=True).collect()}
    for doc_id, text, _ in rows:
        ids, decoded = expected(text or "")
        r = got[doc_id]
        assert (r["n_tokens"], r["ids"], r["decoded"]) == (len(ids), ids, decoded)
        assert r["ids_sha256"] == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert sentence_pieces.encode(docs.limit(0), PATH).count() == 0
