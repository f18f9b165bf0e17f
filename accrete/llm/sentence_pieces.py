"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is cut into units that no piece of the vocabulary crosses (a unit is a run of spaces and what follows up to the
next space; the vocabulary is searched once for pieces that would break this). Per unit an agenda of adjacent symbol
pairs, ordered by score and then from the left, is merged until no pair is a piece; it is a list for units of up to SHORT
characters, where looking for the best pair costs less than a heap, and a heap for others. Characters that are no piece fall
back to their bytes. Units repeat, so each worker keeps the ids of those it has met, up to a bound after which it starts
anew; this changes time, never results. Work is done per Arrow batch, and each batch is held against the sentencepiece
library: units that are new to the worker are encoded by it too, as is every WHOLE-th text as a whole, and all ids are
decoded by it. A difference fails the job.

Defined results: null text is the empty text, whose ids are begin and end only; texts of any length are encoded whole;
repeated rows are encoded alike; other columns are carried along, and those named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Bytes that each of a worker's two generations of units may take, with OVERHEAD a unit for its two objects and its place.
KEPT_BYTES, OVERHEAD = 130_000_000, 200
#: The library encodes every so many-th text of a batch as a whole.
WHOLE = 8
PLACES = (1 << 40) - 1
#: Characters of a unit up to which its agenda is a list, and what stands there for a pair that is no piece.
SHORT, NO_PIECE = 48, 1 << 80
#: Texts of a batch whose units are looked up together.
TOGETHER = 100
RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"
RESULT_IDS = "ids array<int>, decoded string"


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol buffer message: ints, or bytes of what has a length."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


class Pieces:
    """A vocabulary file, its agenda encoder and its decoder."""

    def __init__(self, path: str, kept_bytes: int = KEPT_BYTES, check: bool = True):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(size)]
        special = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i) for i in range(size)]
        self.id_of = {names[i]: i for i in range(size) if not special[i]}
        scores = {names[i]: self.library.get_score(i) for i in range(size) if not special[i]}
        place = {score: k for k, score in enumerate(sorted(set(scores.values()), reverse=True))}
        #: An agenda entry is a piece's place by score, best first, and then the pair's place in the unit.
        self.rank = {name: place[score] * (PLACES + 1) for name, score in scores.items()}
        self.byte_ids = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown, self.begin, self.end = self.library.unk_id(), self.library.bos_id(), self.library.eos_id()
        if any(i == self.unknown for i in self.byte_ids):
            raise ValueError("only vocabularies with byte fallback are supported")
        normalizer = dict(_fields(dict(_fields(self.library.serialized_model_proto())).get(3, b"")))
        self.dummy_prefix = bool(normalizer.get(3, 1))
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or not self.dummy_prefix:
            raise ValueError("only identity normalisation with a dummy prefix and all spaces kept is supported")
        if any(re.search(f"[^{SPACE}]{SPACE}", name) for name in self.id_of):
            raise ValueError("a piece has a space after another character: units can't be encoded one by one")
        self.shown = [None if self.library.is_byte(i) else "" if self.library.is_control(i) else self.library.decode([i]) if self.library.is_unknown(i) else names[i].replace(SPACE, " ") for i in range(size)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.units: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.kept_bytes, self.taken, self.check = kept_bytes, 0, check

    def merge(self, unit: str) -> list[int]:
        """The ids of one unit by the agenda."""
        symbols = self.by_list(unit) if len(unit) <= SHORT else self.by_heap(unit)
        ids = list(map(self.id_of.get, symbols))
        if None in ids:
            return [j for s, i in zip(symbols, ids, strict=True) for j in ((i,) if i is not None else [self.byte_ids[b] for b in s.encode("utf-8", "surrogatepass")])]
        return ids

    def by_list(self, unit: str) -> list[str]:
        """The symbols of a short unit."""
        symbols, rank = list(unit), self.rank.get
        agenda = [rank(unit[i : i + 2], NO_PIECE) for i in range(len(unit) - 1)]
        while agenda and (best := min(agenda)) != NO_PIECE:
            i = agenda.index(best)
            pair = symbols[i] = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = rank(pair + symbols[i + 1], NO_PIECE)
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + pair, NO_PIECE)
        return symbols

    def by_heap(self, unit: str) -> list[str]:
        """The symbols of any unit."""
        symbols: list[str | None] = list(unit)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rank, push, pop = self.rank.get, heapq.heappush, heapq.heappop
        agenda = [r + i for i in range(n - 1) if (r := rank(unit[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            entry = pop(agenda)
            i = entry & PLACES
            j = after[i]
            if j >= n or (left := symbols[i]) is None or rank(pair := left + symbols[j]) != entry - i:
                continue  # one of its symbols has been merged meanwhile
            symbols[i], symbols[j] = pair, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(pair + symbols[k])) is not None:
                    push(agenda, r + i)
            if (h := before[i]) >= 0 and (r := rank(symbols[h] + pair)) is not None:
                push(agenda, r + h)
        return [s for s in symbols if s is not None]

    def cut(self, text: str) -> list[str]:
        return re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE)) if text else []

    def learn(self, new: list[str]) -> None:
        """Encodes units that the worker hasn't met; the library must agree."""
        got = [self.merge(u) for u in new]
        if self.check:
            for u, ids, theirs in zip(new, got, self.library.encode([u[1:].replace(SPACE, " ") for u in new], num_threads=1), strict=True):
                # a lone space that only the dummy prefix makes isn't encoded by the library by itself
                if ids != theirs and u != SPACE:
                    raise ValueError(f"the agenda and the library differ on {u!r}: {ids} and {theirs}")
        for u, ids in zip(new, got, strict=True):
            self.keep(u, struct.pack(f"<{len(ids)}I", *ids))

    def keep(self, unit: str, ids: bytes) -> None:
        self.units[unit] = ids
        self.taken += 4 * len(unit) + len(ids) + OVERHEAD

    def meet(self, cut: list[list[str]]) -> None:
        """Brings all units of some texts into the younger generation."""
        if self.taken > self.kept_bytes:
            self.units, self.older, self.taken = {}, self.units, 0
        missing = set().union(*cut).difference(self.units)
        for u in missing:
            if u in self.older:
                self.keep(u, self.older[u])
        self.learn([u for u in missing if u not in self.older])

    def encode_batch(self, texts: list[str], begin: bool = True, end: bool = True) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        head = np.asarray([self.begin] if begin else [], "<u4").tobytes()
        tail = np.asarray([self.end] if end else [], "<u4").tobytes()
        cut = [self.cut(text) for text in texts]
        self.meet(cut)
        return [head + b"".join([self.units[u] for u in units]) + tail for units in cut]

    def decode(self, ids: np.ndarray) -> str:
        """What the library's decode(ids) returns."""
        whole = ids.tolist()
        parts = [self.shown[i] for i in whole]
        if None in parts:
            joined, run = [], bytearray()
            for i, part in zip(whole, parts, strict=True):
                if part is None:
                    run.append(self.byte_of[i])
                    continue
                if run:
                    joined.append(_from_bytes(bytes(run)))
                    run.clear()
                joined.append(part)
            joined.append(_from_bytes(bytes(run)))
            parts = joined
        text = "".join(parts)
        first = next((i for i in whole if self.shown[i] != ""), None)
        return text[1:] if first not in (None, self.unknown) and (self.shown[first] or "").startswith(" ") else text


def same_as_library(pieces: Pieces, texts: list[str], ids: list[np.ndarray], decoded: list[str], begin: bool, end: bool) -> None:
    """Fails where the library encodes every WHOLE-th text, or decodes any ids, otherwise."""
    theirs = pieces.library.encode(texts[::WHOLE], add_bos=begin, add_eos=end, num_threads=1)
    if any(mine.tolist() != other for mine, other in zip(ids[::WHOLE], theirs, strict=True)):
        raise ValueError("the agenda and the library differ on a whole text")
    if pieces.library.decode([i.tolist() for i in ids]) != decoded:
        raise ValueError("the decoder and the library differ")


#: The vocabularies a worker has loaded, with the units it has met in all its tasks.
_LOADED: dict[tuple[str, bool], Pieces] = {}


def loaded(path: str, check: bool) -> Pieces:
    if (path, check) not in _LOADED:
        _LOADED[path, check] = Pieces(path, check=check)
    return _LOADED[path, check]


def _from_bytes(run: bytes) -> str:
    """UTF-8 with one replacement character for every byte that isn't part of a whole character."""
    try:
        return run.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for size in (1, 2, 3, 4):
                try:
                    out.append(run[at : at + size].decode("utf-8"))
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


def encode(docs: DataFrame, path: str, text: str = "text", begin: bool = True, end: bool = True, check: bool = True, with_ids: bool = False) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 of the text column, and ids and decoded if asked for."""
    schema = RESULT + (f", {RESULT_IDS}" if with_ids else "")

    def batches(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces = loaded(path, check)
        for texts in it:
            rows, whole = [], texts.fillna("").tolist()
            for at in range(0, len(whole), TOGETHER):
                some = whole[at : at + TOGETHER]
                encoded = pieces.encode_batch(some, begin, end)
                ids = [np.frombuffer(data, "<u4") for data in encoded]
                decoded = [pieces.decode(i) for i in ids]
                if check:
                    same_as_library(pieces, some, ids, decoded, begin, end)
                for data, i, back in zip(encoded, ids, decoded, strict=True):
                    rows.append((len(i), hashlib.sha256(data).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), *((i.astype("int32"), back) if with_ids else ())))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])

    run = F.pandas_udf(batches, schema)
    names = [f.split()[0] for f in schema.split(", ")]
    kept = [c for c in docs.columns if c not in (*names, "_pieces")]
    return docs.select(*kept, run(F.col(text)).alias("_pieces")).select(*kept, *[F.col(f"_pieces.{n}").alias(n) for n in names])
