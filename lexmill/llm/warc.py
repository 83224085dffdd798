"""Derivative WARC records: metadata and plain-text conversions of responses.

A response (record_id, target_uri, warc_date, http_header, payload) gives two
records that refer to it: ``metadata`` with fields about the capture, and
``conversion`` with the text of its HTML.  Identifiers are made from the
source's, so a rebuilt derivative has the same ones; every record carries
``WARC-Refers-To``, the target and date of its source, and SHA-256 digests of its
own block and of the source's payload.

All of it is column expressions; the only Python is the parser of WARC files.

Defined results: null headers and payloads count as empty ones, a response
without an identifier or target gets records with those fields empty; repeated
rows give repeated records; HTML that ends in mid-tag loses that tag; an empty
payload gives a conversion with an empty block.  Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRAWL_DATE = "2024-01-01T00:00:00Z"
_BLOCKS = "p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|footer|header|main|aside|blockquote|pre|body|html|td|th|form|figure|dl|dt|dd|hr"
#: (pattern, replacement) in order; the same in Java's and RE2's dialect.
STEPS = [
    (r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<head\b.*?</head\s*>", ""),
    (rf"(?i)</?({_BLOCKS})\b[^>]*>", "\n"),
    (r"<[A-Za-z/!?][^>]*>?", ""),
]
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"), ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&laquo;", "«"), ("&raquo;", "»"), ("&bull;", "•"), ("&euro;", "€"), ("&eacute;", "é"), ("&egrave;", "è"), ("&agrave;", "à"), ("&auml;", "ä"), ("&ouml;", "ö"), ("&uuml;", "ü"), ("&szlig;", "ß"), ("&ntilde;", "ñ")]
SPACES = [(r"[ \t\f\r]{2,}|[\t\f\r]", " "), (r" ?\n[ \n]*", "\n")]


def entities(text: Column) -> Column:
    """Named, decimal and hexadecimal references decoded once each; ``&amp;`` last."""
    # only the references that occur are replaced: names, then numbers, so that nothing is decoded twice
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z]{2,8});"), F.lit(0)))
    found = F.sort_array(F.array_except(found, F.array(F.lit("&amp;"))), asc=False)
    names = F.create_map(*(F.lit(x) for pair in ENTITIES for x in pair))

    def point(ref: Column) -> Column:
        inner = F.substring(ref, F.lit(3), F.length(ref) - 3)
        code = F.when(F.lower(F.substring(inner, 1, 1)) == "x", F.conv(F.substring(inner, F.lit(2), F.length(inner)), 16, 10)).otherwise(inner).cast("bigint")
        valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")).otherwise(F.lit("�"))

    value = lambda ref: F.when(F.startswith(ref, F.lit("&#")), point(ref)).otherwise(F.coalesce(names[ref], ref))
    text = F.aggregate(found, text, lambda acc, ref: F.replace(acc, ref, value(ref)))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def with_text(rows: DataFrame, html: str, name: str) -> DataFrame:
    """``rows`` with the readable text of a column of HTML, a line per block.

    Each step that a later one uses more than once is a column, so that it is
    computed once.
    """
    bare = F.col(html)
    for pattern, to in STEPS:
        bare = F.regexp_replace(bare, pattern, to)
    text = entities(F.col("_bare"))
    for pattern, to in SPACES:
        text = F.regexp_replace(text, pattern, to)
    return rows.withColumn("_bare", bare).withColumn(name, F.btrim(text, F.lit(" \n"))).drop("_bare")


def _urn(text: Column) -> Column:
    h = F.md5(text)
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def responses_of_pages(pages: DataFrame, date: str = CRAWL_DATE) -> DataFrame:
    """Response records of (page_id, url, html)."""
    html = F.coalesce("html", F.lit(""))
    return pages.select(
        _urn(F.concat_ws("|", F.lit("response"), F.col("page_id").cast("string"), F.coalesce("url", F.lit("")))).alias("record_id"), F.coalesce("url", F.lit("")).alias("target_uri"), F.lit(date).alias("warc_date"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n")).alias("http_header"), html.alias("payload"),
    )


def derive(responses: DataFrame) -> DataFrame:
    """Two rows per response: (record_type, record_id, refers_to, target_uri, warc_date, content_type, content_length, block_digest, source_payload_digest, header, block)."""
    source = responses.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("record_id", "target_uri", "warc_date", "http_header", "payload")))
    source = source.withColumn("digest", _digest(F.col("payload"))).withColumn("conversion_id", _urn(F.concat(F.lit("conversion|"), "record_id")))
    source = with_text(source, "payload", "_text")
    title = F.regexp_replace(F.regexp_extract("payload", r"(?is)<title[^>]*>([^<]*)", 1), r"[ \t\r\n]+", " ")
    fields = F.concat(
        F.lit("source-status: "), F.regexp_extract("http_header", r"^HTTP/[0-9.]+ ([0-9]{3})", 1), F.lit("\r\nsource-content-type: "), F.regexp_extract("http_header", r"(?i)content-type: *([^\r\n]*)", 1),
        F.lit("\r\nsource-payload-length: "), F.octet_length("payload").cast("string"), F.lit("\r\nsource-payload-digest: "), "digest", F.lit("\r\ntitle: "), title,
        F.lit("\r\nlanguage: "), F.regexp_extract("payload", r"(?i)<html[^>]* lang=\"?([A-Za-z-]+)", 1), F.lit("\r\noutlinks: "), F.regexp_count("payload", F.lit(r"(?i)<a\b[^>]* href")).cast("string"),
        F.lit("\r\nconversion-record: "), "conversion_id", F.lit("\r\n"),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), _urn(F.concat(F.lit("metadata|"), "record_id")).alias("own_id"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.col("conversion_id").alias("own_id"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("_text").alias("block")),
    )
    made = source.select("record_id", "target_uri", "warc_date", "digest", F.explode(kinds).alias("k")).select(
        "k.record_type", F.col("k.own_id").alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri", "warc_date", "k.content_type", F.octet_length("k.block").cast("bigint").alias("content_length"),
        _digest(F.col("k.block")).alias("block_digest"), F.col("digest").alias("source_payload_digest"), F.col("k.block").alias("block"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), "record_type", F.lit("\r\nWARC-Record-ID: "), "record_id", F.lit("\r\nWARC-Date: "), "warc_date", F.lit("\r\nWARC-Refers-To: "), "refers_to",
        F.lit("\r\nWARC-Refers-To-Target-URI: "), "target_uri", F.lit("\r\nWARC-Refers-To-Date: "), "warc_date", F.lit("\r\nWARC-Target-URI: "), "target_uri", F.lit("\r\nWARC-Block-Digest: "), "block_digest",
        F.lit("\r\nContent-Type: "), "content_type", F.lit("\r\nContent-Length: "), F.col("content_length").cast("string"), F.lit("\r\n\r\n"),
    )
    return made.withColumn("header", header)


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Record files under ``path``: header and block of each record, then the two line ends that close it."""
    records.select(F.concat("header", "block").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def parse_warc(data: bytes) -> Iterator[dict]:
    """Records of a WARC file, plain or gzipped (by record or whole); a record cut short ends the file."""
    stream = io.BytesIO(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        block = stream.read(int(head.get("content-length") or 0))
        yield {"head": head, "block": block}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_type, record_id, refers_to, target_uri, warc_date, http_header, payload) of all records of the files under ``path``."""
    names = ["record_type", "record_id", "refers_to", "target_uri", "warc_date", "http_header", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content"):
                rows = []
                for r in parse_warc(data.as_py() or b""):
                    h, block = r["head"], r["block"]
                    http, body = b"", block
                    if h.get("content-type", "").startswith("application/http"):
                        http, gap, body = block.partition(b"\r\n\r\n")
                        http += gap
                    rows.append((h.get("warc-type"), h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), http.decode("utf-8", "replace"), body.decode("utf-8", "replace")))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")
    return files.mapInArrow(run, ", ".join(f"{n} string" for n in names))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    text = "payload"
    for pattern, to in STEPS:
        text = f"regexp_replace({text}, {quote(pattern)}, {'chr(10)' if to else quote('')}, 'g')"
    for name, letter in [*ENTITIES, ("&amp;", "&")]:
        text = f"replace({text}, {quote(name)}, {quote(letter)})"
    for pattern, to in SPACES:
        text = f"regexp_replace({text}, {quote(pattern)}, {'chr(10)' if to == chr(10) else quote(to)}, 'g')"
    text = f"trim({text}, ' ' || chr(10))"
    urn = lambda x: f"(SELECT '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' FROM (SELECT md5({x}) AS h))"
    crlf = "chr(13) || chr(10)"
    fields = f""" || {crlf} || """.join([
        "'source-status: 200'", "'source-content-type: text/html; charset=utf-8'", "'source-payload-length: ' || strlen(payload)", "'source-payload-digest: ' || digest",
        r"'title: ' || regexp_replace(regexp_extract(payload, '(?is)<title[^>]*>([^<]*)', 1), '[ \t\r\n]+', ' ', 'g')",
        """'language: ' || regexp_extract(payload, '(?i)<html[^>]* lang="?([A-Za-z-]+)', 1)""",
        r"'outlinks: ' || len(regexp_extract_all(payload, '(?i)<a\b[^>]* href'))", "'conversion-record: ' || conversion_id", "''",
    ])
    header = f" || {crlf} || ".join([
        "'WARC/1.1'", "'WARC-Type: ' || record_type", "'WARC-Record-ID: ' || record_id", "'WARC-Date: ' || warc_date", "'WARC-Refers-To: ' || refers_to", "'WARC-Refers-To-Target-URI: ' || target_uri",
        "'WARC-Refers-To-Date: ' || warc_date", "'WARC-Target-URI: ' || target_uri", "'WARC-Block-Digest: sha256:' || sha256(block)", "'Content-Type: ' || content_type", "'Content-Length: ' || strlen(block)", "''", "''",
    ])
    return f"""
WITH r AS (SELECT {urn("'response|' || page_id || '|' || coalesce(url, '')")} AS source_id, coalesce(url, '') AS target_uri, '{CRAWL_DATE}' AS warc_date, coalesce(html, '') AS payload FROM pages),
s AS (SELECT *, 'sha256:' || sha256(payload) AS digest, {urn("'conversion|' || source_id")} AS conversion_id, {urn("'metadata|' || source_id")} AS metadata_id FROM r),
k AS (SELECT 'metadata' AS record_type, metadata_id AS record_id, source_id AS refers_to, target_uri, warc_date, 'application/warc-fields' AS content_type, digest AS source_payload_digest, {fields} AS block FROM s
UNION ALL SELECT 'conversion', conversion_id, source_id, target_uri, warc_date, 'text/plain; charset=utf-8', digest, {text} FROM s)
SELECT record_type, record_id, refers_to, target_uri, warc_date, content_type, strlen(block)::BIGINT AS content_length, 'sha256:' || sha256(block) AS block_digest, source_payload_digest, block, {header} AS header FROM k
"""


SQL = _sql()
