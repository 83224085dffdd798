"""Byte-level BPE through a sentencepiece model written straight from a vocabulary.

The vocabulary (token bytes and ranks) becomes a sentencepiece BPE model
without training: every token is spelled in the 256 printable stand-ins for
bytes, scored by its negative rank, with identity normalisation and no dummy
prefix.  Texts are cut into pre-tokens by the tokenizer's pattern, each distinct
pre-token is encoded once per worker as long as ``CACHE_BYTES`` hold it, and ids
are laid end to end.  Decoding
maps ids back to bytes.

Defined results: a null text has null ids, an empty text an empty list; special
tokens' strings are ordinary text; whole texts are encoded, whatever their
length; repeated rows are encoded alike.  Decoding an id outside the vocabulary
is an error; ids whose bytes aren't UTF-8 (cut in mid-character) decode with
replacement characters.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import itertools
import struct
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import byte_sizes, mapped, row_slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_BYTES = 40 << 20  # what a worker remembers of pre-tokens
SLICE = 1 << 20  # bytes of text cut at once
CUT = 200_000  # pre-tokens of one text held at once


def byte_letters() -> list[str]:
    """The printable character that stands for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


def read_vocabulary(path: str) -> list[bytes]:
    """Token bytes in order of rank, from a file of base64 tokens and ranks."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float | str) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    data = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def serialise(tokens: Sequence[bytes]) -> bytes:
    """A sentencepiece ModelProto whose ids are the tokens' ranks; the id after them is for the unknown."""
    letters = byte_letters()
    out = bytearray()
    for rank, token in enumerate(tokens):
        out += _field(1, _field(1, "".join(letters[b] for b in token)) + _field(2, -float(rank)) + _field(3, 1))
    out += _field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2))
    absent = (1 << 64) - 1  # -1 as a varint
    # trainer: type BPE, vocabulary size, which ids are unknown, start, end, padding
    out += _field(2, _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + _field(41, absent) + _field(42, absent) + _field(43, absent))
    # normaliser: identity; no dummy prefix, no white space removed or escaped
    out += _field(3, _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class Codec:
    def __init__(self, tokens: Sequence[bytes], pattern: str = PATTERN):
        import regex
        import sentencepiece

        self.tokens = list(tokens)
        self.find, self.each = regex.compile(pattern).findall, regex.compile(pattern).finditer
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=serialise(tokens))
        self.letters = dict(enumerate(byte_letters()))
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0

    def _ids(self, cut: list[list[str]]) -> list[np.ndarray]:
        """Ids of lists of pre-tokens; one call of the processor for all that aren't known yet."""
        if self.known_bytes > CACHE_BYTES:
            self.known.clear()
            self.known_bytes = 0
        new = list(set(itertools.chain.from_iterable(cut)).difference(self.known))
        if new:
            spelled = [p.encode("utf-8").decode("latin-1").translate(self.letters) for p in new]
            coded = [np.array(x, np.int32).tobytes() for x in self.processor.encode(spelled, num_threads=1)]
            self.known.update(zip(new, coded))
            self.known_bytes += 200 * len(new) + sum(map(len, coded)) + 2 * sum(map(len, new))  # with what Python adds to each
        ids = self.known.__getitem__
        return [np.frombuffer(b"".join(map(ids, p)), np.int32) for p in cut]

    def encode_all(self, texts: Sequence[str | None]) -> list[np.ndarray | None]:
        """Ids of each text; a long one is cut and encoded part by part."""
        short = [i for i, t in enumerate(texts) if t is not None and len(t) <= SLICE]
        out: list[np.ndarray | None] = [None] * len(texts)
        for i, ids in zip(short, self._ids([self.find(texts[i]) for i in short])):
            out[i] = ids
        for i, t in enumerate(texts):
            if t is not None and len(t) > SLICE:
                cut = (m.group() for m in self.each(t))
                out[i] = np.concatenate([self._ids([p])[0] for p in iter(lambda: list(itertools.islice(cut, CUT)), [])])
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: Sequence[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str = VOCABULARY, pattern: str = PATTERN) -> Codec:
    return Codec(read_vocabulary(path), pattern)


def _encode(path: str, pattern: str, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            for at, to in row_slices(byte_sizes(b.column("text")), SLICE):
                part = b.slice(at, to - at)
                texts = part.column("text").to_pylist()
                ids = c.encode_all(texts)
                same = [None if t is None else c.decode(i.tolist()) == t for t, i in zip(texts, ids)] if check else []
                sizes = np.array([0 if x is None else len(x) for x in ids], np.int64)
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
                flat = pa.array(np.concatenate([x for x in ids if x is not None] or [np.zeros(0, np.int32)]), pa.int32())
                none = pa.array([x is None for x in ids])
                lists = pa.ListArray.from_arrays(offsets, flat, mask=none) if any(x is None for x in ids) else pa.ListArray.from_arrays(offsets, flat)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), lists, pa.array(sizes, mask=none.to_numpy(zero_copy_only=False))] + ([pa.array(same, pa.bool_())] if check else []),
                    names=["doc_id", "ids", "tokens"] + (["restored"] if check else []),
                )

    return run


def encode(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN, check: bool = False) -> DataFrame:
    """(doc_id, ids, tokens); with ``check`` also whether decoding gives the text back."""
    kind = dict(docs.dtypes)["doc_id"]
    return mapped(docs.select("doc_id", "text"), _encode(path, pattern, check), f"doc_id {kind}, ids array<int>, tokens bigint" + (", restored boolean" if check else ""))


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, PATTERN)
        for b in batches:
            texts = [None if x.as_py() is None else c.decode(x.as_py()) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return mapped(encoded.select("doc_id", F.col("ids")), run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")
