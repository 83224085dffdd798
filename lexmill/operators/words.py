"""The words of Arrow batches, as :func:`lexmill.functions.text.tokens` finds them, by array operations."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext

from ..functions.text import WORD
from .batches import row_slices

AT_ONCE = 256 << 10


@functools.cache
def letters() -> np.ndarray:
    """Bits of all code points: whether ``WORD`` takes them, asked of the JVM's own expressions."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)  # no halves of pairs
    others = SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(WORD).matcher(every).replaceAll("")
    found = np.zeros(0x110000, bool)
    found[np.frombuffer(every.encode("utf-32-le"), np.uint32)] = True
    found[np.frombuffer(others.encode("utf-32-le"), np.uint32)] = False
    return np.packbits(found)


def words(texts: pa.Array, letter: np.ndarray) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """(first row, words of each row, what lies at words) of consecutive rows of lower-cased ``texts`` without nulls.

    ``letter``: a flag per code point.  Every other entry of the last, from the
    first on, is a word of two letters or more, in order; the others lie between
    words, so that nothing is copied.
    """
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    for lo, hi in row_slices(np.diff(offsets), AT_ONCE, len(texts)):
        part = data.slice(offsets[lo], offsets[hi] - offsets[lo]) if data is not None else pa.py_buffer(b"")
        begin, end, counts = _found(np.frombuffer(part, np.uint8), offsets[lo : hi + 1] - offsets[lo], letter)
        at = np.empty(2 * len(begin), np.int64)
        at[::2], at[1::2] = begin, end
        many = max(0, len(at) - 1)
        yield lo, counts, pa.Array.from_buffers(pa.large_string(), many, [None, pa.py_buffer(at if many else np.zeros(1, np.int64)), part])


def _found(data: np.ndarray, offsets: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes at which words begin and end, and how many words each of the texts between ``offsets`` has."""
    wide = len(data) and data.max() >= 128
    if wide:
        inside = letter[np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)]
        at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # of each character
        edges = np.searchsorted(at, offsets)
    else:
        inside, edges = letter[:128][data], offsets
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    first = edges[:-1][edges[:-1] < edges[1:]]  # of the texts that aren't empty
    fresh[first] = inside[first]
    last[first - 1] = inside[first - 1]  # that before the first one is the end of all
    begin, end = np.flatnonzero(fresh), np.flatnonzero(last) + 1
    long = end - begin > 1
    begin, end = begin[long], end[long]
    counts = np.diff(np.searchsorted(begin, edges))
    return (at[begin], at[end], counts) if wide else (begin, end, counts)
