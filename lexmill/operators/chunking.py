"""Chunkers: code by blocks, prose by sections and overlapping line windows.

A document's packing is a fold over its lines, so it runs per document in Arrow
batches; documents are independent and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import mapped

CHUNK, OVERLAP, LEAST = 512, 64, 10
OUT_CHARS = 2 << 20
_JS = "class const export function import let var"
_CLIKE = "char enum int struct void"
_OO = "class enum interface private protected public"
#: what a line of each language begins with where a block begins, a space following
STARTS = {
    "python": "class def async\\ def", "javascript": _JS, "typescript": _JS + " interface type", "go": "const func package type var", "rust": "enum fn impl mod pub\\ fn struct use",
    "java": _OO, "ruby": "class def module require", "c": _CLIKE + " double float typedef \\#include", "cpp": _CLIKE + " class namespace template \\#include", "csharp": _OO + " namespace using",
}
BLOCKS = {lang: re.compile("(?:" + "|".join(re.split(r"(?<!\\) ", words)) + ") " + ("|@" if lang == "python" else "")) for lang, words in STARTS.items()}
_UNDERLINE = re.compile(r"[=-]{3,}$")
SCHEMA = "chunk_id string, content string, document_path string, language string, start_line int, end_line int, chunk_type string"


def approximate_tokens(text: str) -> int:
    return -(-len(text) // 4)


def _id(path: str, start: int, end: int) -> str:
    return hashlib.sha256(f"{path}:{start}:{end}".encode()).hexdigest()[:16]


def sections(lines: list[str]) -> list[tuple[int, int]]:
    """Line ranges that begin at a ``#`` heading, or at an underline below a line of text."""
    starts = [0] + [i for i in range(1, len(lines)) if lines[i].strip().startswith("#") or (lines[i - 1].strip() and _UNDERLINE.match(lines[i].strip()))]
    return list(zip(starts, starts[1:] + [len(lines)]))


def prose(path: str, text: str, count: Callable[[str], int] = approximate_tokens, size: int = CHUNK, overlap: int = OVERLAP, least: int = LEAST) -> Iterator[tuple]:
    """(id, content, first line, last line) of the chunks of a text."""
    lines = text.split("\n")
    for begin, end in sections(lines):
        whole = "\n".join(lines[begin:end])
        tokens = count(whole)
        if tokens <= size:
            if tokens >= least:
                yield _id(path, begin, end), whole, begin + 1, end
            continue
        first = begin
        for at in range(begin, end):
            if count("\n".join(lines[first : at + 1])) < size:
                continue
            yield _id(path, first, at), "\n".join(lines[first : at + 1]), first + 1, at + 1
            held, k = 0, at
            while k >= first:
                held += count(lines[k])
                if held >= overlap:
                    break
                k -= 1
            first = k if held >= overlap else at + 1
        rest = "\n".join(lines[first:end])
        if first < end and count(rest) >= least:
            yield _id(path, first, end), rest, first + 1, end


def code(path: str, text: str, language: str, count: Callable[[str], int] = approximate_tokens, size: int = CHUNK, least: int = LEAST) -> Iterator[tuple]:
    """Blocks of a source file packed greedily; one block larger than a chunk stays whole."""
    lines = text.split("\n")
    pattern = BLOCKS[language]
    edges = [0] + [i for i in range(1, len(lines)) if pattern.match(lines[i].strip())] + [len(lines)]
    first = 0
    for lo, hi in zip(edges, edges[1:]):
        if lo > first and count("\n".join(lines[first:lo])) + count("\n".join(lines[lo:hi])) > size:
            held = "\n".join(lines[first:lo])
            if count(held) >= least:
                yield _id(path, first, lo - 1), held, first + 1, lo
            first = lo
    held = "\n".join(lines[first:])
    if count(held) >= least:
        yield _id(path, first, len(lines)), held, first + 1, len(lines)


def chunks_of(path: str, text: str, language: str, count: Callable[[str], int] = approximate_tokens, **sizes) -> Iterator[tuple]:
    if language in BLOCKS:
        sizes.pop("overlap", None)
        yield from ((*c, "code") for c in code(path, text, language, count, **sizes))
    else:
        yield from ((*c, "prose") for c in prose(path, text, count, **sizes))


def chunk(docs: DataFrame, count: Callable[[str], int] = approximate_tokens, **sizes) -> DataFrame:
    """Chunks of (content, filepath, language); blank documents have none.

    A worker holds a batch of some megabytes, one text of it as a string, and
    chunks of ``OUT_CHARS`` characters or so.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def made_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n.endswith("_line") else pa.string()) for n, c in zip(names, zip(*rows))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held = [], 0
            for row in range(b.num_rows):
                text, path, lang = (b.column(c)[row].as_py() for c in ("content", "filepath", "language"))
                if not text or not text.strip():
                    continue
                for i, content, lo, hi, kind in chunks_of(path or "", text, lang or "text", count, **sizes):
                    out.append((i, content, path, lang, lo, hi, kind))
                    held += len(content)
                    if held >= OUT_CHARS:
                        yield made_of(out)
                        out, held = [], 0
            if out:
                yield made_of(out)

    made = mapped(docs.select("content", "filepath", "language"), run, SCHEMA)
    return made.withColumn("source", F.format_string("%s:%d-%d", "document_path", "start_line", "end_line"))
