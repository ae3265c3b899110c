"""Encoding of the whole corpus with a public byte-level BPE vocabulary (problem 6).

A sentencepiece BPE model is serialised directly from the vocabulary: its pieces are the vocabulary's byte-mapped strings in
the order of their ids, each scored by its negative rank, with identity normalisation. Sentencepiece then merges the
neighbours whose union ranks first, as byte-level BPE does. Texts are cut into pre-tokens by the vocabulary's public pattern;
every distinct pre-token of a batch is encoded once and the texts are put together from a memo. ``decode`` is the inverse mapping.

Null and empty texts have an empty list; names of special tokens within a text are ordinary text; a null id stays null.
The encoding is a map, nothing is shuffled. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = os.environ.get("LODESTONE_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.json"
#: The public pattern that cuts a text before the merges (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII alone, where it can be matched by the faster standard module.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A field of a protocol buffer: varint, 32-bit float or length-delimited."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    return _varint(number << 3) + _varint(value)


def serialise(pieces: list[str]) -> bytes:
    """A sentencepiece model of these pieces, whose ids and ranks are their positions; one unknown piece follows them."""
    normal, unknown, bpe = 1, 2, 2
    out = [_field(1, _field(1, p.encode()) + _field(2, float(-k)) + _field(3, normal)) for k, p in enumerate(pieces)]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(pieces) + 1) + _field(40, len(pieces)) + _field(41, 2**64 - 1) + _field(42, 2**64 - 1) + _field(43, 2**64 - 1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)  # no dummy prefix, all spaces kept, none escaped
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


class Encoder:
    """The encoder of one vocabulary file; its memo is emptied when it passes ``most`` pre-tokens."""

    def __init__(self, vocabulary: str, most: int = 500_000):
        import re

        import regex
        import sentencepiece

        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"] for t in model.get("added_tokens", [])}
        ids = sorted((k, piece) for piece, k in model["model"]["vocab"].items() if piece not in special)
        if [k for k, _ in ids] != list(range(len(ids))):
            raise ValueError("the ids of the vocabulary are not 0, 1, 2, ...")
        self.pieces = [piece for _, piece in ids]
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.pieces))
        letters = byte_letters()
        self.letters = {b: c for b, c in enumerate(letters)}
        self.bytes = {c: b for b, c in enumerate(letters)}
        self.cut, self.cut_ascii = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN, re.ASCII).findall
        self.most, self.memo = most, {}

    def mapped(self, token: str) -> str:
        return token.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the offsets of each text in it."""
        cut = [(self.cut_ascii if t.isascii() else self.cut)(t) if t else () for t in texts]
        if len(self.memo) > self.most:
            self.memo = {}
        new = [*set().union(*cut).difference(self.memo)]
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            self.memo.update(zip(part, self.sp.encode([self.mapped(t) for t in part], num_threads=1), strict=True))
        get = self.memo.__getitem__
        parts = [[*chain.from_iterable(map(get, tokens))] for tokens in cut]
        offsets = np.zeros(len(parts) + 1, np.int32)
        np.cumsum([len(p) for p in parts], out=offsets[1:])
        return np.fromiter(chain.from_iterable(parts), np.int32, offsets[-1]), offsets

    def decode(self, ids: list[int]) -> str:
        letters = "".join(self.pieces[k] for k in ids)
        return bytes(self.bytes[c] for c in letters).decode("utf-8", "replace")


@lru_cache(2)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def encode(documents: DataFrame, vocabulary: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text", batch_rows: int = 1_000) -> DataFrame:
    """``doc_id, ids`` of every document. ``vocabulary`` is the path of a vocabulary file on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for big in batches:
            for k in range(0, big.num_rows, batch_rows):
                batch = big.slice(k, batch_rows)
                ids, offsets = e.encode_all(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["doc_id", "ids"])

    return documents.select(id_column, text_column).mapInArrow(run, "doc_id bigint, ids array<int>")
