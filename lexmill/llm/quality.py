"""Document quality with hierarchical empirical Bayes over hosts and paths.

A logistic regression on surface features (symbols, capitals, repetition, ...)
gives each document's own evidence.  Grouped sums of that evidence give every
host and every path on a host a posterior share of good documents: a path is
shrunk toward its host, a host toward all documents, by as many pseudo-documents
as the spread between paths and between hosts, found by moments, says.  A
document's final odds are its own, with the prior replaced by what the other
documents of its path say.

The classifier is fitted on up to ``TRAIN_DOCS`` labelled rows; features and site
statistics cover all documents.  The text is read once; what follows works on a
narrow table in the shared folder.

Defined results: a null or empty text has the features of an empty one and is
not kept; null hosts and paths are sites of their own; a null ``doc_id`` is
scored and never used for training; repeated rows are documents each.  Without
labels of both kinds every document's evidence is the prior, 0.5.  Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import byte_sizes, durable, mapped, row_slices
from ._text import buffers, ngrams, per_row, words

TRAIN_DOCS = 20_000
KEEP_AT = 0.5
BROADCAST_SITES = 100_000
SLICE = 4 << 20
PIECE = 1 << 20
FEATURES = ["log_words", "word_length", "symbols", "shouts", "capitals", "digits", "stuttering", "repeated", "line_words"]

_KINDS = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    _KINDS[_b] = 1 if _b < 128 and _c in "#$%&*|~^<>{}[]\\=+@_`" else 2 if _c in "!?" else 3 if "A" <= _c <= "Z" else 4 if "0" <= _c <= "9" else 5 if _c == "\n" else 0


def text_features(text: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` per text."""
    raw, offs = buffers(text)
    n = len(offs) - 1
    kinds = np.zeros((n, 6), np.int64)
    for at in range(0, len(raw), PIECE):
        end = min(len(raw), at + PIECE)
        row = np.searchsorted(offs, np.arange(at, end, 1), side="right") - 1 if n < 2 else np.repeat(np.arange(n), np.clip(offs[1:], at, end) - np.clip(offs[:-1], at, end))
        np.add.at(kinds.reshape(-1), row * 6 + _KINDS[raw[at:end]], 1)
    size = np.maximum(np.diff(offs), 1)
    h, splits = words(text)
    count = np.diff(splits)
    row = per_row(h, splits)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    g, gs = ngrams(h, splits, 3)
    grow = per_row(g, gs)
    order = np.lexsort((g, grow))
    same = np.zeros(len(g), bool)
    same[1:] = (g[order][1:] == g[order][:-1]) & (grow[order][1:] == grow[order][:-1])
    most = np.maximum(count, 1)
    return np.stack([
        np.log1p(count), np.diff(offs) / most, kinds[:, 1] / size, kinds[:, 2] / size, kinds[:, 3] / size, kinds[:, 4] / size,
        np.bincount(row[again], minlength=n) / most, np.bincount(grow[order][same], minlength=n) / np.maximum(np.diff(gs), 1), np.log1p(count / (kinds[:, 5] + 1)),
    ], axis=1)


def features(docs: DataFrame, host: Column, path: Column) -> DataFrame:
    """(doc_id, host, path, chars, one column per feature) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in row_slices(byte_sizes(b.column("_t")), SLICE):
                part = b.slice(lo, hi - lo)
                x = text_features(part.column("_t"))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("doc_id", "host", "path")] + [pa.array(byte_sizes(part.column("_t")))] + [pa.array(x[:, i]) for i in range(len(FEATURES))], names=["doc_id", "host", "path", "chars", *FEATURES])

    kind = dict(docs.dtypes)["doc_id"]
    named = docs.select("doc_id", F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col("text").alias("_t"))
    return mapped(named, run, f"doc_id {kind}, host string, path string, chars bigint, " + ", ".join(f"{f} double" for f in FEATURES))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 60) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps on standardised features; weights and intercept for raw ones."""
    if not len(y) or y.min() == y.max():
        return np.zeros(len(FEATURES)), 0.0
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.hstack(((x - mean) / spread, np.ones((len(x), 1))))
    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) / len(y) + ridge * w
        hess = (z * (p * (1 - p))[:, None]).T @ z / len(y) + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w -= step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1] / spread, float(w[-1] - (w[:-1] * mean / spread).sum())


def strength(prior: float, n: float, groups: float, between: float) -> float:
    """Pseudo-documents of a Beta prior, from the mean squared deviation of group means weighted by size."""
    noise = prior * (1 - prior) * groups / max(n, 1.0)
    excess = between - noise
    return float(np.clip(prior * (1 - prior) / excess - 1, 1.0, 1e6)) if excess > 0 else 1e6


def score(docs: DataFrame, labels: DataFrame, host: Column, path: Column, keep_at: float = KEEP_AT, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, host, path, evidence, host_share, path_share, posterior, keep) of every row."""
    feats = durable(features(docs, host, path))
    judged = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # the sample is the rows of lowest hash: the same at every size of cluster
    rows = feats.join(judged, "doc_id").select(*FEATURES, "quality", F.xxhash64("doc_id").alias("h")).orderBy("h", *FEATURES).limit(train_docs).toArrow()
    w, b = fit(np.stack([rows[f].to_numpy() for f in FEATURES], axis=1), rows["quality"].to_numpy().astype(float))
    logit = F.lit(b)
    for name, weight in zip(FEATURES, w.tolist()):
        logit = logit + F.lit(weight) * F.col(name)
    logit = F.greatest(F.least(logit, F.lit(12.0)), F.lit(-12.0))
    own = feats.select("doc_id", "host", "path", "chars", (F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))).alias("evidence"))
    return combine(own, keep_at)


def combine(own: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """From (doc_id, host, path, chars, evidence): host and path posteriors and each document's own."""
    paths = own.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("evidence").alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.count("*").alias("hp"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("squares"))
    t = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.count("*").alias("hosts"), F.sum("hp").alias("paths"), F.sum(F.col("hs") * F.col("hs") / F.col("hn")).alias("hsq"), F.sum("squares").alias("psq")).first()
    n = t["n"] or 0
    prior = float(np.clip(t["s"] / n, 1e-3, 1 - 1e-3)) if n else 0.5
    by_host = strength(prior, n, t["hosts"], (t["hsq"] - t["s"] ** 2 / n) / n) if n else 1.0
    by_path = strength(prior, n, t["paths"], (t["psq"] - t["hsq"]) / n) if n else 1.0
    sites = paths.join(hosts.select("host", "hn", "hs"), "host")
    if (t["paths"] or 0) <= BROADCAST_SITES:
        sites = F.broadcast(sites)
    host_share = (F.col("hs") + F.lit(by_host * prior)) / (F.col("hn") + F.lit(by_host))
    # the document itself is left out of what its site says about it
    others = (F.col("s") - F.col("evidence") + F.lit(by_path) * F.col("host_share")) / (F.col("n") - 1 + F.lit(by_path))
    others = F.greatest(F.least(others, F.lit(1 - 1e-6)), F.lit(1e-6))
    e = F.greatest(F.least(F.col("evidence"), F.lit(1 - 1e-6)), F.lit(1e-6))
    odds = F.log(e / (1 - e)) + F.log(others / (1 - others)) - F.lit(float(np.log(prior / (1 - prior))))
    joined = own.join(sites, ["host", "path"]).withColumn("host_share", host_share)
    joined = joined.withColumn("path_share", (F.col("s") + F.lit(by_path) * F.col("host_share")) / (F.col("n") + F.lit(by_path))).withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return joined.select("doc_id", "host", "path", "evidence", "host_share", "path_share", "posterior", ((F.col("posterior") >= keep_at) & (F.col("chars") > 0)).alias("keep"))
