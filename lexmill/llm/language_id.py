"""Language identification by interpolated Kneser-Ney character models.

One model per language, of order ``ORDER`` over lower-cased code points.  All
models share sorted arrays of n-gram hashes; next to each hash stand the
interpolated log-probabilities of every language, so a character costs one
binary search unless its n-gram was never seen, when the context's back-off
weight and the next lower order are looked up.  A document gets the language of
lowest cross-entropy per character.  It is rejected where even that exceeds what
held-out documents of this language show at this length.

Models are fitted on a bounded sample: ``TRAIN_DOCS`` documents of each language
for counts and as many again for calibration, ``TRAIN_BYTES`` in all, chosen by a
hash of ``doc_id``; texts of more than a sixteenth of that aren't trained on.
Counts, candidates and thresholds of everything else cover all documents.

Defined results: a null or empty text has no evidence and is rejected with a
null language and null entropy; rows with a null ``lang`` are scored but not
trained on; whole texts are scored, however long; repeated rows are scored
alike.  Extra columns are ignored (:func:`identify`) or carried
(:func:`keep_identified`).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import byte_sizes, mapped, row_slices
from ._text import mix

ORDER = 4
TRAIN_DOCS = 300
TRAIN_BYTES = 16 << 20  # of a language's texts in the sample
PIECE = 1 << 17
SLICE = 2 << 20
MARGIN = 6.0  # standard deviations above the held-out mean
MIN_SPREAD = 0.35  # bits; no threshold is tighter than this
_M = np.uint64(0x9E3779B97F4A7C15)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)


def _grams(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 1..order the hash of the k-gram that ends at each position, start padded with 0."""
    padded = np.concatenate((np.zeros(order, np.uint64), codes.astype(np.uint64) + np.uint64(1)))
    n, acc, power, out = len(codes), np.zeros(len(codes), np.uint64), np.uint64(1), []
    with np.errstate(over="ignore"):
        for k in range(order):
            acc = acc + padded[order - k : order - k + n] * power
            power = power * _M
            out.append(acc)
        return [mix(a + np.uint64(k + 1)) for k, a in enumerate(out)]


def _shift(gram: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """The gram that ends one position earlier; at a text's start the all-padding gram, hashed as 0."""
    out = np.empty_like(gram)
    out[1:] = gram[:-1]
    out[:1] = 0
    if first is not None:
        out[first] = 0
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each hash in the sorted array, -1 where it isn't there."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Models:
    languages: list[str]
    grams: list[np.ndarray]  # by order - 1: sorted hashes
    logp: list[np.ndarray]  # by order - 1: log-probabilities, a column per language
    contexts: list[np.ndarray]  # by context length: sorted hashes
    back: list[np.ndarray]  # by context length: log back-off weights
    floor: np.ndarray  # log-probability of a character never seen
    mean: np.ndarray | None = None
    between: np.ndarray | None = None  # variance of documents' entropies, and its part that falls with length
    within: np.ndarray | None = None

    def score(self, codes: np.ndarray, starts: np.ndarray, skip: int = 0) -> np.ndarray:
        """Log-probabilities (characters x languages); ``starts``: where texts begin.  The first ``skip`` positions are context only."""
        order = len(self.grams)
        grams = _text_grams(codes, starts, order)
        out = np.zeros((len(codes), len(self.languages)), np.float32)
        todo = np.arange(skip, len(codes))
        begin = np.zeros(len(codes), bool)
        begin[starts] = True
        for k in range(order, 0, -1):
            if not len(todo):
                break
            at = _find(self.grams[k - 1], grams[k - 1][todo])
            hit = at >= 0
            out[todo[hit]] += self.logp[k - 1][at[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
            if k == 1:
                out[todo] += self.floor
                break
            before = np.where(begin[todo], np.uint64(0), grams[k - 2][todo - 1])
            ctx = _find(self.contexts[k - 1], before)
            out[todo[ctx >= 0]] += self.back[k - 1][ctx[ctx >= 0]]
        return out[skip:]

    def totals(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Characters and summed log-probabilities of each text."""
        n, sums = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.languages)))
        held: list[np.ndarray] = []
        rows: list[int] = []

        def flush() -> None:
            if not held:
                return
            sizes = np.array([len(c) for c in held])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            sums[rows] += np.add.reduceat(self.score(np.concatenate(held), starts).astype(np.float64), starts, axis=0)
            held.clear()
            rows.clear()

        size = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            codes = _codes(text)
            n[i] = len(codes)
            if len(codes) > PIECE:
                for at in range(0, len(codes), PIECE):
                    skip = min(at, len(self.grams))
                    sums[i] += self.score(codes[at - skip : at + PIECE], np.zeros(0, np.int64) if skip else np.zeros(1, np.int64), skip).sum(axis=0, dtype=np.float64)
                continue
            if size + len(codes) > PIECE:
                flush()
                size = 0
            held.append(codes)
            rows.append(i)
            size += len(codes)
        flush()
        return n, sums

    def judge(self, n: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, bits per character, and whether that is within the language's bounds."""
        bits = -sums / np.maximum(n, 1)[:, None] / np.log(2)
        best = np.argmin(bits, axis=1) if len(bits) else np.zeros(0, np.int64)
        low = bits[np.arange(len(bits)), best]
        spread = np.maximum(np.sqrt(self.between[best] + self.within[best] / np.maximum(n, 1)) * MARGIN, MIN_SPREAD)
        return best, low, (n > 0) & (low <= self.mean[best] + spread)


def _text_grams(codes: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """As :func:`_grams`, over several texts laid end to end, none seeing into the one before."""
    if len(starts) <= 1:
        return _grams(codes, order)
    # padding of ``order`` zeros before every text, dropped again afterwards
    n, texts = len(codes), len(starts)
    sizes = np.diff(np.append(starts, n))
    where = np.arange(n) + np.repeat(np.arange(texts) * order, sizes) + order
    wide = np.zeros(n + order * texts, np.uint64)
    wide[where] = codes.astype(np.uint64) + np.uint64(1)
    acc, power, out = np.zeros(n, np.uint64), np.uint64(1), []
    with np.errstate(over="ignore"):
        for k in range(order):
            acc = acc + wide[where - k] * power
            power = power * _M
            out.append(mix(acc + np.uint64(k + 1)))
    return out


def fit(texts: dict[str, Sequence[str]], order: int = ORDER) -> Models:
    """Interpolated Kneser-Ney: raw counts at the highest order, continuation counts below, one discount per order."""
    languages = sorted(texts)
    seen: list[list[dict]] = []
    for lang in languages:
        held = [c for c in (_codes(t) for t in texts[lang] if t) if len(c)]
        codes = np.concatenate(held) if held else np.zeros(0, np.uint32)
        starts = np.concatenate(([0], np.cumsum([len(c) for c in held])[:-1])).astype(np.int64) if held else np.zeros(0, np.int64)
        grams = _text_grams(codes, starts, order)
        begin = np.zeros(len(codes), bool)
        begin[starts] = True
        levels = []
        for k in range(1, order + 1):
            key, first, count = np.unique(grams[k - 1], return_index=True, return_counts=True)
            ctx = np.where(begin[first], np.uint64(0), grams[k - 2][first - 1]) if k > 1 else np.zeros(len(key), np.uint64)
            suffix = grams[k - 2][first] if k > 1 else np.zeros(len(key), np.uint64)
            levels.append({"key": key, "ctx": ctx, "suffix": suffix, "count": count.astype(np.float64)})
        for k in range(order - 1, 0, -1):  # continuation counts: distinct (k+1)-grams by their suffix
            upper = levels[k]
            c = np.zeros(len(levels[k - 1]["key"]))
            np.add.at(c, np.searchsorted(levels[k - 1]["key"], upper["suffix"]), 1.0)
            levels[k - 1]["count"] = c
        seen.append(levels)
    union = [np.unique(np.concatenate([s[k]["key"] for s in seen])) for k in range(order)]
    ctxs = [np.zeros(0, np.uint64)] + [np.unique(np.concatenate([s[k]["ctx"] for s in seen])) for k in range(1, order)]
    vocabulary = len(union[0]) + 1
    prob: list[np.ndarray] = []
    back: list[np.ndarray] = [np.zeros((0, len(languages)), np.float32)]
    floor = np.zeros(len(languages))
    for k in range(1, order + 1):
        keys = union[k - 1]
        p, b = np.zeros((len(keys), len(languages))), np.zeros((len(ctxs[k - 1]), len(languages)))
        ctx_of, suffix_of = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
        for s in seen:
            at = np.searchsorted(keys, s[k - 1]["key"])
            ctx_of[at], suffix_of[at] = s[k - 1]["ctx"], s[k - 1]["suffix"]
        for j, s in enumerate(seen):
            level = s[k - 1]
            c = level["count"]
            n1, n2 = float((c == 1).sum()), float((c == 2).sum())
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            at = np.searchsorted(keys, level["key"])
            if k == 1:
                total = c.sum()
                gamma = d * len(c) / total if total else 1.0
                floor[j] = np.log(gamma / vocabulary)
                p[:, j] = gamma / vocabulary
                if total:
                    p[at, j] += np.maximum(c - d, 0) / total
                continue
            where = np.searchsorted(ctxs[k - 1], level["ctx"])
            total, kinds = np.zeros(len(ctxs[k - 1])), np.zeros(len(ctxs[k - 1]))
            np.add.at(total, where, c)
            np.add.at(kinds, where, 1.0)
            gamma = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
            b[:, j] = np.log(gamma)
            p[:, j] = gamma[np.searchsorted(ctxs[k - 1], ctx_of)] * prob[-1][np.searchsorted(union[k - 2], suffix_of), j]
            p[at, j] += np.maximum(c - d, 0) / total[where]
        prob.append(p)
        if k > 1:
            back.append(b.astype(np.float32))
    return Models(languages, union, [np.log(p).astype(np.float32) for p in prob], ctxs, back, floor.astype(np.float32))


def calibrate(models: Models, texts: dict[str, Sequence[str]]) -> Models:
    """Mean and spread of held-out entropies; the spread has a part of documents and a part that falls with length."""
    size = len(models.languages)
    models.mean, models.between, models.within = np.full(size, 8.0), np.full(size, 1.0), np.full(size, 16.0)
    for j, lang in enumerate(models.languages):
        n, sums = models.totals(list(texts.get(lang, ())))
        n, sums = n[n > 0], sums[n > 0]
        if len(n) < 5:
            continue
        bits = -sums[:, j] / n / np.log(2)
        models.mean[j] = np.average(bits)
        square = (bits - models.mean[j]) ** 2
        a = np.stack((np.ones(len(n)), 1.0 / n), axis=1)
        fitted = np.linalg.lstsq(a, square, rcond=None)[0]
        models.between[j], models.within[j] = max(fitted[0], 0.25 * square.mean()), max(fitted[1], 4.0)
    return models


def sample(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(lang, text, part): up to ``train_docs`` labelled texts of each language for counts (0) and for calibration (1)."""
    hashed = docs.select("lang", "doc_id", "text").where(f"lang is not null and doc_id is not null and octet_length(text) <= {TRAIN_BYTES // 16}")
    slots = 1 << 30
    counts = hashed.groupBy("lang").count().select(F.col("lang").alias("_l"), (F.lit(4.0 * train_docs) / F.col("count")).alias("share"))
    return (
        hashed.join(F.broadcast(counts), F.col("lang") == F.col("_l"))  # one row per language
        .where(F.pmod(F.xxhash64("doc_id"), F.lit(slots)) < F.col("share") * slots)
        .withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")))
        .withColumn("bytes", F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("at")))
        .where((F.col("at") <= 2 * train_docs) & (F.col("bytes") <= TRAIN_BYTES))
        .select("lang", "text", (F.col("at") % 2).alias("part"))
    )


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, order: int = ORDER) -> Models:
    halves: tuple[dict, dict] = ({}, {})
    for row in sample(docs, train_docs).collect():  # bounded by train_docs and TRAIN_BYTES
        halves[row["part"]].setdefault(row["lang"], []).append(row["text"])
    models = fit({k: sorted(t for t in v if t) for k, v in halves[1].items()} or {"und": [""]}, order)
    return calibrate(models, halves[0])


def _judged(models: Models):
    """Slices of batches with the characters, best language, bits per character and verdict of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for at, to in row_slices(byte_sizes(b.column("text")), SLICE):
                part = b.slice(at, to - at)
                n, sums = models.totals(part.column("text").to_pylist())
                yield part, n, *models.judge(n, sums)

    return run


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """(doc_id, language, bits_per_char, chars, keep) of every row; ``keep`` is false where the text is rejected."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*models.languages, None], pa.string())
        for part, n, best, bits, fits in _judged(models)(batches):
            empty = n == 0
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), names.take(pa.array(np.where(empty, len(models.languages), best))), pa.array(bits, mask=empty), pa.array(n), pa.array(fits)],
                names=["doc_id", "language", "bits_per_char", "chars", "keep"],
            )

    return mapped(docs.select("doc_id", "text"), run, f"doc_id {kind}, language string, bits_per_char double, chars bigint, keep boolean")


def keep_identified(docs: DataFrame, models: Models) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, all columns as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _, _, fits in _judged(models)(batches):
            yield part.filter(pa.array(fits))

    return mapped(docs, run, docs.schema)
