"""Exact duplicates by composable polynomial fingerprints.

A text's UTF-8 bytes are read as the coefficients of a polynomial, evaluated at
``BASE`` modulo a 62-bit prime.  Fingerprints of consecutive pieces compose:
``H(ab) = H(a) * BASE**len(b) + H(b)``.  A huge document is therefore cut into
chunks that are hashed by different tasks and combined afterwards; only the
chunk hashes of one document ever meet.

Documents of equal length and fingerprint are then compared by content, chunk
by chunk: a group whose chunks at some position differ is a collision, and its
texts are told apart by the names of their chunks.

Defined results: a null text equals nothing, an empty text equals other empty
texts.  A row without ``doc_id`` can't be named: it is never reported and always
kept.  Of rows with equal text the lowest ``doc_id`` stays; of repeated rows
(same ``doc_id``, same text) one stays.  Other columns are carried untouched by
:func:`drop_duplicates` and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import durable, id_bitmap, mapped, maybe_in, small, without_ids

PRIME = 4611686018427387847  # the largest prime below 2**62
BASE = 256
CHUNK = 1 << 16
HUGE = 1 << 20


def fingerprint(data: bytes) -> int:
    """The polynomial's value; reading the bytes as one big number is the same sum."""
    return int.from_bytes(data, "big") % PRIME


def combine(left: int, right: int, right_length: int) -> int:
    """Fingerprint of a concatenation, from the fingerprints of its parts."""
    return (left * pow(BASE, right_length, PRIME) + right) % PRIME


def of_chunks(data: bytes, chunk: int = CHUNK) -> int:
    if len(data) <= chunk:
        return fingerprint(data)
    whole = 0
    view = memoryview(data)
    for at in range(0, len(data), chunk):
        piece = view[at : at + chunk]
        whole = combine(whole, int.from_bytes(piece, "big") % PRIME, len(piece))
    return whole


def _hash_batches(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b.column("_t")
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pc.cast(pc.binary_length(data), pa.int64()), pa.array([of_chunks(x.as_buffer(), chunk) for x in data], pa.int64())],
                names=["doc_id", "len", "fp"],
            )

    return run


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data = b.column("part")
        yield pa.RecordBatch.from_arrays(
            [b.column(c) for c in ("doc_id", "len", "tag", "no")] + [pc.cast(pc.binary_length(data), pa.int64()), pa.array([fingerprint(x.as_buffer()) for x in data], pa.int64())],
            names=["doc_id", "len", "tag", "no", "part_len", "fp"],
        )


def _combine_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for parts in b.column("parts").to_pylist():
            whole = 0
            for p in parts:
                whole = combine(whole, p["fp"], p["part_len"])
            out.append(whole)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("len"), pa.array(out, pa.int64())], names=["doc_id", "len", "fp"])


def fingerprints(docs: DataFrame, chunk: int = CHUNK, huge: int = HUGE) -> DataFrame:
    """(doc_id, len, fp) of every row with a ``doc_id`` and a text.

    Texts of up to ``huge`` bytes are hashed where they are read.  Longer ones
    are cut into chunks that are spread over all tasks; repeated rows among
    them give one row.
    """
    base = docs.select("doc_id", F.col("text").cast("binary").alias("_t")).where("doc_id is not null and _t is not null")
    kind = dict(base.dtypes)["doc_id"]
    small = mapped(base.where(F.octet_length("_t") <= huge), _hash_batches(chunk), f"doc_id {kind}, len bigint, fp bigint")
    cut = (
        base.where(F.octet_length("_t") > huge)
        .select("doc_id", F.octet_length("_t").cast("bigint").alias("len"), F.xxhash64("_t").alias("tag"), "_t", F.explode(F.expr(f"sequence(0L, (octet_length(_t) - 1) div {chunk})")).alias("no"))
        .select("doc_id", "len", "tag", "no", F.substring("_t", (F.col("no") * chunk + 1).cast("int"), F.lit(chunk)).alias("part"))
        .repartition("doc_id", "no")
    )
    hashed = mapped(cut, _hash_chunks, f"doc_id {kind}, len bigint, tag bigint, no bigint, part_len bigint, fp bigint").dropDuplicates(["doc_id", "len", "tag", "no"])
    whole = hashed.groupBy("doc_id", "len", "tag").agg(F.array_sort(F.collect_list(F.struct("no", "part_len", "fp"))).alias("parts"))
    parts = mapped(whole, _combine_chunks, f"doc_id {kind}, len bigint, fp bigint")
    return small.unionByName(parts)


def _candidates(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """Rows that share length and fingerprint with another document: (doc_id, len, fp, keep_id, copies)."""
    groups = prints.distinct().groupBy("len", "fp").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("copies")).where("copies > 1")
    return prints.distinct().join(groups, ["len", "fp"])


def duplicates(docs: DataFrame, chunk: int = CHUNK, huge: int = HUGE, prints: DataFrame | None = None) -> DataFrame:
    """One row (doc_id, keep_id, copies) for every document that has the text of one with a lower id.

    ``copies`` counts the distinct ids that share the text, ``keep_id`` included.
    """
    prints = durable(fingerprints(docs, chunk, huge)) if prints is None else prints
    members = durable(_candidates(docs, prints))
    pieces = (
        maybe_in(docs.select("doc_id", F.col("text").cast("binary").alias("_t")), id_bitmap(members), "doc_id", "maybe").where("maybe")
        .join(small(members.select("doc_id", "len", "fp")), "doc_id")
        .where(F.octet_length("_t") == F.col("len"))
        .select("len", "fp", F.explode(F.expr(f"sequence(0L, greatest(octet_length(_t) - 1, 0) div {chunk})")).alias("no"), "_t")
        .select("len", "fp", "no", F.substring("_t", (F.col("no") * chunk + 1).cast("int"), F.lit(chunk)).alias("part"))
    )
    # equal chunks merge before the shuffle; a group is sound if each of its positions has one content
    collided = durable(pieces.distinct().groupBy("len", "fp", "no").count().where("count > 1").select("len", "fp").distinct())
    if collided.isEmpty():
        return members.where("doc_id <> keep_id").select("doc_id", "keep_id", "copies").distinct()
    sound = members.join(collided, ["len", "fp"], "left_anti").where("doc_id <> keep_id").select("doc_id", "keep_id", "copies")
    return sound.unionByName(_told_apart(docs, members.join(collided, ["len", "fp"]).select("doc_id", "len", "fp").distinct(), chunk)).distinct()


def _told_apart(docs: DataFrame, members: DataFrame, chunk: int) -> DataFrame:
    """(doc_id, keep_id, copies) within groups of one fingerprint but several texts.

    Each chunk of a text is named by the lowest id that has this chunk at this
    position; texts are equal where all their chunks have the same names.
    """
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("_t")).join(members, "doc_id").where(F.octet_length("_t") == F.col("len"))
    parts = texts.select("doc_id", "len", "fp", F.xxhash64("_t").alias("tag"), F.explode(F.expr(f"sequence(0L, greatest(octet_length(_t) - 1, 0) div {chunk})")).alias("no"), "_t")
    parts = parts.select("doc_id", "len", "fp", "tag", "no", F.substring("_t", (F.col("no") * chunk + 1).cast("int"), F.lit(chunk)).alias("part"))
    names = parts.groupBy("len", "fp", "no", "part").agg(F.min("doc_id").alias("name"))
    named = parts.join(names, ["len", "fp", "no", "part"]).select("doc_id", "len", "fp", "tag", "no", "name").distinct()
    spelled = named.groupBy("doc_id", "len", "fp", "tag").agg(F.array_sort(F.collect_list(F.struct("no", "name"))).alias("names")).select("doc_id", "len", "fp", "names").distinct()
    leaders = spelled.groupBy("len", "fp", "names").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("copies")).where("copies > 1")
    return spelled.join(leaders, ["len", "fp", "names"]).where("doc_id <> keep_id").select("doc_id", "keep_id", "copies")


def drop_duplicates(docs: DataFrame, chunk: int = CHUNK, huge: int = HUGE) -> DataFrame:
    """``docs`` with one row of each text, all columns as they were."""
    prints = durable(fingerprints(docs, chunk, huge))
    gone = durable(duplicates(docs, chunk, huge, prints).select("doc_id"))
    again = durable(prints.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    # a null text equals nothing: such rows stay, whatever becomes of others with their id
    bare, docs = docs.where("text is null"), docs.where("text is not null")
    if again.isEmpty():
        return without_ids(docs, gone).unionByName(bare)
    # ids that occur more than once name several rows: those rows are decided by id and text together
    single = docs.join(gone.unionByName(again).distinct(), "doc_id", "left_anti").select(docs.columns)
    several = docs.join(again, "doc_id", "left_semi").select(docs.columns)
    texts = docs.where("doc_id is not null").select("doc_id", "text").join(
        prints.join(again.join(prints, "doc_id").select("len", "fp").distinct(), ["len", "fp"], "left_semi").select("doc_id").distinct(), "doc_id", "left_semi")
    lowest = texts.groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    kept = several.join(lowest, ["doc_id", "text"], "left_semi").dropDuplicates(["doc_id", "text"])
    return single.unionByName(bare).unionByName(kept.select(docs.columns))


SQL = """
SELECT doc_id, keep_id, copies FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS copies
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
) WHERE doc_id <> keep_id
"""
