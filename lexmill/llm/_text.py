"""Vectorised text primitives over Arrow string columns.

A *word* is a maximal run of ASCII letters, digits, underscores and any
non-ASCII characters; ASCII letters are folded to lower case here, other
letters by whoever needs it (``F.lower`` before the Arrow transfer).  All
functions work on whole columns: bytes are read straight from the Arrow buffer
and handled in cache-sized pieces, so that one very long text needs no more
scratch memory than many short ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 17

_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INV = pow(_MULT, -1, 1 << 64)

WORD_CLASS = np.zeros(256, dtype=np.uint64)
for _b in range(256):
    _c = chr(_b)
    if _b >= 0x80 or _c.isalnum() or _c == "_":
        WORD_CLASS[_b] = (ord(_c.lower()) if _b < 0x80 else _b) + 1

_SPLIT_SEED = 0x2545F4914F6CDD1D


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    done = 1
    step = base
    while done < n:
        take = min(done, n - done)
        np.multiply(out[:take], np.uint64(step), out=out[done : done + take])
        step = step * step & _MASK
        done += take
    return out


_POW: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POW or len(_POW["up"]) < n:
        size = max(n, PIECE + 1)
        _POW["up"], _POW["down"] = _powers(_MULT, size), _powers(_INV, size)
    return _POW["up"], _POW["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), in place on a fresh array."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls read as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def words(column: pa.Array, with_bytes: bool = False):
    """Hashes of all words and the row boundaries among them.

    Returns ``(hashes, splits)`` where row i owns ``hashes[splits[i]:splits[i+1]]``;
    with ``with_bytes`` also the byte offset of each word's first byte.
    """
    raw, offs = buffers(column)
    n = len(raw)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    up, down = _power_tables(PIECE + 1)
    got, firsts = [], []
    at = 0
    carry = None  # an unfinished word at the end of a piece: (hash so far, length, first byte)
    while at < n:
        end = min(n, at + PIECE)
        cls = WORD_CLASS[raw[at:end]]
        isw = cls != 0
        size = end - at
        start = isw.copy()
        start[1:] &= ~isw[:-1] | edge[at + 1 : end]
        idx = np.flatnonzero(start)
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(cls * up[:size], out=sums[1:])
        if len(idx):
            stop = np.empty(len(idx), dtype=np.int64)
            stop[:-1] = idx[1:]
            stop[-1] = size
            h = (sums[stop] - sums[idx]) * down[idx]
            first = idx + at
            if carry is not None and idx[0] == 0 and not edge[at]:
                ch, clen, cfirst = carry
                h[0] = np.uint64((int(h[0]) * pow(_MULT, clen, 1 << 64) + ch) & _MASK)
                first[0] = cfirst
                base_len = clen
            else:
                base_len = 0
                if carry is not None:
                    got.append(np.array([carry[0]], dtype=np.uint64))
                    firsts.append(np.array([carry[2]], dtype=np.int64))
            carry = None
            if isw[-1] and end < n and not edge[end]:
                length = size - int(idx[-1]) + (base_len if len(idx) == 1 and idx[0] == 0 else 0)
                carry = (int(h[-1]), length, int(first[-1]))
                h, first = h[:-1], first[:-1]
            got.append(h)
            firsts.append(first)
        elif carry is not None:
            got.append(np.array([carry[0]], dtype=np.uint64))
            firsts.append(np.array([carry[2]], dtype=np.int64))
            carry = None
        at = end
    if carry is not None:
        got.append(np.array([carry[0]], dtype=np.uint64))
        firsts.append(np.array([carry[2]], dtype=np.int64))
    hashes = mix(np.concatenate(got)) if got else np.zeros(0, np.uint64)
    where = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
    splits = np.searchsorted(where, offs, side="left").astype(np.int64)
    return (hashes, splits, where) if with_bytes else (hashes, splits)


def ngrams(hashes: np.ndarray, splits: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of each row, and their row boundaries.

    A row with some words but fewer than ``n`` has one gram, of all its words.
    """
    count = np.diff(splits)
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out_splits = np.concatenate(([0], np.cumsum(grams)))
    total = int(out_splits[-1])
    if total == 0:
        return np.zeros(0, np.uint64), out_splits
    # position in ``hashes`` of the first word of each gram
    first = np.arange(total, dtype=np.int64) + np.repeat(splits[:-1] - out_splits[:-1], grams)
    padded = np.concatenate((hashes, np.zeros(n, np.uint64)))
    acc = np.zeros(total, dtype=np.uint64)
    short = np.repeat(count, grams) if (count < n).any() else None
    for j in range(n):
        w = padded[first + j]
        if short is not None:
            w = np.where(short > j, w, np.uint64(0))
        acc = (acc ^ w) * np.uint64(0x9FB21C651E98DF25)
        acc ^= acc >> np.uint64(28)
    return mix(acc), out_splits


def per_row(values: np.ndarray, splits: np.ndarray) -> np.ndarray:
    """Row number of each element."""
    return np.repeat(np.arange(len(splits) - 1, dtype=np.int64), np.diff(splits))


def reduce_rows(op: np.ufunc, values: np.ndarray, splits: np.ndarray, empty):
    """``op`` over the elements of each row; ``empty`` where a row has none."""
    out = np.full(len(splits) - 1, empty, dtype=values.dtype)
    some = np.flatnonzero(np.diff(splits) > 0)
    if len(some):
        out[some] = op.reduceat(values, splits[:-1][some])
    return out
