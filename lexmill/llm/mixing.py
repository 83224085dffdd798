"""Mixing sources to target weights by Pareto order sampling.

A source with share ``w`` of a mixture of ``size`` rows owes each of its ``n``
documents ``size * w / n`` copies.  The whole part is allocated for certain;
what remains is a probability ``p`` per document, the same within a source and
different between sources.  The remaining places, a fixed number, go to the
documents of lowest rank ``[u / (1 - u)] / [p / (1 - p)]`` (Rosén's Pareto
sampling), ``u`` being a uniform number hashed from ``doc_id`` and a seed.

No global sort: the cut-off is found by two histograms of the ranks, and only
the documents of one of some 16 million bins are ordered.

Defined results: a null source is a source of its own; sources without a given
weight get none; a null ``doc_id`` hashes as an empty one, and rows that tie in
rank are ordered by ``doc_id`` and text, so repeated rows are placed one by one.
An empty table gives an empty mixture.  All columns are carried, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import durable, unused

SEED = "mix-1"
TEMPERATURE = 0.5
RATE = 0.8
BINS = 4096
BROADCAST_SOURCES = 100_000
NO_SOURCE = "\u0000"


def allocation(docs: DataFrame, weights: dict[str, float] | None = None, rate: float = RATE, temperature: float = TEMPERATURE) -> tuple[DataFrame, int, int]:
    """(source, due, whole, p) per source: copies due, whole copies, remaining probability; the number of sources and of remaining places.

    The mixture holds ``rate`` times the rows of ``docs``.  Without ``weights``
    a source's share is proportional to ``rows ** temperature``.
    """
    counts = docs.groupBy(F.coalesce("source", F.lit(NO_SOURCE)).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        counts = counts.withColumn("share", F.pow(F.col("n").cast("double"), F.lit(float(temperature))))
    else:
        given = F.create_map(*(F.lit(x) for s, w in weights.items() for x in (s, float(w)))) if weights else F.lit(None).cast("map<string,double>")
        counts = counts.withColumn("share", F.coalesce(given[F.col("source")], F.lit(0.0)))
    counts = durable(counts)
    t = counts.agg(F.count("*").alias("sources"), F.sum("n").alias("n"), F.sum("share").alias("share")).first()
    size, whole = round(rate * (t["n"] or 0)), t["share"] or 0.0
    due = F.lit(float(size)) * F.col("share") / F.lit(whole) / F.col("n") if whole > 0 else F.lit(0.0)
    rest = F.col("due") - F.floor("due")
    sure = (rest < 1e-9) | (rest > 1 - 1e-9)
    shares = counts.withColumn("due", due).select(
        "source", "n", "due", F.when(sure, F.round("due")).otherwise(F.floor("due")).cast("int").alias("whole"), F.when(sure, 0.0).otherwise(rest).alias("p"))
    places = shares.agg(F.sum(F.col("p") * F.col("n"))).first()[0] or 0.0
    return shares.drop("n"), t["sources"], round(places)


def _odds(doc_id: Column, p: Column, seed: str) -> Column:
    """The rank of a document: random odds over those of its inclusion; null where nothing is left to chance."""
    bits = F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":" + seed))), 1, 13), 16, 10).cast("bigint")
    u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.when(p > 0, (u / (F.lit(1.0) - u)) / (p / (F.lit(1.0) - p)))


def _unit(odds: Column) -> Column:
    return F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + odds)


def _bin(unit: Column, low: float, width: float) -> Column:
    return F.least(F.greatest(F.floor((unit - F.lit(low)) / F.lit(width)), F.lit(0)), F.lit(BINS - 1))


def _cut(narrow: DataFrame, places: int) -> tuple[float, float, int, int, int]:
    """Where the last place falls: (low, width, coarse bin, fine bin, places left in the fine bin)."""
    low, width, left, bins, unit = 0.0, 1.0 / BINS, places, [], F.col("unit")
    for _ in range(2):
        inside = narrow if not bins else narrow.where(_bin(unit, 0.0, 1.0 / BINS) == bins[0])
        counts = {r["b"]: r["count"] for r in inside.groupBy(_bin(unit, low, width).alias("b")).count().collect()}  # BINS rows at most
        chosen = 0
        for b in sorted(counts):
            chosen = b
            if counts[b] >= left:
                break
            left -= counts[b]
        bins.append(chosen)
        if len(bins) == 1:
            low, width = chosen / BINS, 1.0 / BINS / BINS
    return low, width, bins[0], bins[1], left


def mix_copies(docs: DataFrame, weights: dict[str, float] | None = None, rate: float = RATE, temperature: float = TEMPERATURE, seed: str = SEED, copies: str = "_copies") -> DataFrame:
    """``docs`` with the number of copies of each row in a column ``copies``; rows with none are absent.

    Where ``docs`` has a column of that name it stays as it is, and underscores
    are put before the new one's name.
    """
    shares, sources, places = allocation(docs, weights, rate, temperature)
    columns = docs.columns
    copies, key, whole, p, q, place = unused(columns, copies, "key", "whole", "p", "odds", "place")
    rows = shares.select(F.col("source").alias(key), F.col("whole").alias(whole), F.col("p").alias(p))
    if sources <= BROADCAST_SOURCES:
        rows = F.broadcast(rows)  # as many rows as there are sources

    def ranked(d: DataFrame) -> DataFrame:
        return d.join(rows, F.coalesce(d["source"], F.lit(NO_SOURCE)) == F.col(key)).withColumn(q, _odds(d["doc_id"], F.col(p), seed))

    if places <= 0:
        return ranked(docs).withColumn(copies, F.col(whole)).where(F.col(copies) > 0).select(*columns, copies)
    narrow = ranked(docs.select("doc_id", "source")).where(F.col(q).isNotNull()).select(_unit(F.col(q)).alias("unit"))
    low, width, coarse, fine, left = _cut(narrow, places)
    unit = _unit(F.col(q))
    at = F.struct(_bin(unit, 0.0, 1.0 / BINS).alias("a"), _bin(unit, low, width).alias("b"))
    cut = F.struct(F.lit(coarse).cast("bigint").alias("a"), F.lit(fine).cast("bigint").alias("b"))
    known = F.col(q).isNotNull()
    edge = known & (at == cut)
    plain = ranked(docs).where(~edge).withColumn(copies, F.col(whole) + F.when(known & (at < cut), 1).otherwise(0))
    # one bin of some 16 million; its few rows are ordered exactly
    tie = [F.col(c) for c in (q, "doc_id")] + ([F.col("text")] if "text" in columns else [])
    on_edge = ranked(docs).where(edge).withColumn(place, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*tie)))
    on_edge = on_edge.withColumn(copies, F.col(whole) + F.when(F.col(place) <= left, 1).otherwise(0))
    return plain.select(*columns, copies).unionByName(on_edge.select(*columns, copies)).where(F.col(copies) > 0)


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """The mixture itself: every row of ``docs`` as often as its copies say, columns as they were."""
    copies, copy = unused(docs.columns, "copies", "copy")
    counted = mix_copies(docs, copies=copies, **parameters)
    return counted.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(docs.columns)


SQL = f"""
WITH n AS (SELECT coalesce(source, chr(0)) AS s, count(*) AS n FROM documents GROUP BY 1),
size AS (SELECT round({RATE} * sum(n)) AS m, sum(sqrt(n)) AS w FROM n),
due AS (SELECT s, n, size.m * sqrt(n) / size.w / n AS due FROM n, size),
split AS (SELECT s, n, CASE WHEN due - floor(due) < 1e-9 OR due - floor(due) > 1 - 1e-9 THEN round(due) ELSE floor(due) END AS whole,
          CASE WHEN due - floor(due) < 1e-9 OR due - floor(due) > 1 - 1e-9 THEN 0 ELSE due - floor(due) END AS p FROM due),
places AS (SELECT round(sum(p * n)) AS k FROM split),
u AS (SELECT doc_id, source, whole, p, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{SEED}'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
      FROM documents JOIN split ON coalesce(source, chr(0)) = s),
q AS (SELECT *, CASE WHEN p > 0 THEN row_number() OVER (ORDER BY CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END NULLS LAST, doc_id) END AS place FROM u)
SELECT doc_id, source, (whole + CASE WHEN place <= (SELECT k FROM places) THEN 1 ELSE 0 END)::INTEGER AS copies
FROM q WHERE whole + CASE WHEN place <= (SELECT k FROM places) THEN 1 ELSE 0 END > 0
"""
