"""Text functions as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
STOPWORDS = sorted("with or on by at as of to in is are be for and an a the".split())
UNITS = "seconds percent minutes hours secs mins days sec min hrs ms kb mb gb tb s d %".split()
_KEY = r"([a-z][\w /-]{2,60})"
KEYVAL = rf"(?i){_KEY}\s*(?:should be|must be|are|is|:|=)\s*([^.\n]{{1,80}})"
BOOL = rf"(?i){_KEY}\s+(should not|must not|should|must)\b"
NUMVAL = rf"(?i)\b([0-9]{{1,6}}(?:\.[0-9]{{1,3}})?\b)\s*({'|'.join(UNITS)})?\b"


def tokens(text: Column) -> Column:
    """Words of two letters or more, lower-cased."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: F.length(w) > 1)


def approximate_tokens(text: Column) -> Column:
    """The default token counter: a token per four characters, begun ones included."""
    return F.ceil(F.length(text) / 4).cast("int")


def chunk_id(path: Column, start: Column, end: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", path, start.cast("string"), end.cast("string")), 256), 1, 16)


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def snippet(text: Column, most: int = 240) -> Column:
    """White space collapsed; longer texts cut, with an ellipsis as last character."""
    flat = squeeze(F.coalesce(text, F.lit("")))
    return F.when(F.length(flat) > most, F.concat(F.left(flat, F.lit(most - 1)), F.lit("…"))).otherwise(flat)


def norm_key(text: Column) -> Column:
    """The first eight words that aren't stopwords, in lower case without punctuation."""
    words = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " "), " +")
    return F.array_join(F.slice(F.filter(words, lambda w: (w != "") & ~w.isin(STOPWORDS)), 1, 8), " ")


def norm_value(text: Column) -> Column:
    """The first number with its unit, else the text in lower case, cut to 40 characters."""
    number, unit = F.regexp_extract(text, NUMVAL, 1), F.regexp_extract(text, NUMVAL, 2)
    return F.when(number != "", F.concat(number, F.lower(unit))).otherwise(F.left(F.lower(squeeze(text)), F.lit(40)))


def normal_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(normal_path(path), "/"), -1)


def suffix(path: Column) -> Column:
    """The last extension in lower case, empty for names such as ``.env``."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def parent_dir(path: Column, root: str = ".") -> Column:
    inside = F.regexp_extract(normal_path(path), r"^(.*)/[^/]*$", 1)
    return F.when(inside == "", root).otherwise(inside)


def stem_title(path: Column) -> Column:
    return F.initcap(F.regexp_replace(F.regexp_replace(base_name(path), r"\.[^.]+$", ""), "[_-]+", " "))


def head_and_tail(text: Column, most: int = 800) -> Column:
    """Texts of more than ``most`` characters as their first and last halves."""
    half = most // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(half)), F.lit("\n...\n"), F.right(text, F.lit(half))))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def local_summary(text: Column, least: int = 20, count: int = 2, most: int = 200) -> Column:
    """The first sentences of more than ``least`` characters, cut with three dots."""
    kept = F.slice(F.filter(F.transform(sentences(squeeze(text)), lambda s: F.trim(s)), lambda s: F.length(s) > least), 1, count)
    joined = F.array_join(kept, " ")
    return F.when(F.length(joined) > most, F.concat(F.left(joined, F.lit(most - 3)), F.lit("..."))).otherwise(joined)


def letter_share(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", "")) / F.greatest(F.length(text), F.lit(1))


def first_title(text: Column, longest: int = 80, share: float = 0.5) -> Column:
    """The first of the first five lines that reads like a title, or null."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    fit = F.filter(F.slice(lines, 1, 5), lambda s: (F.length(s) >= 5) & (F.length(s) <= longest) & (letter_share(s) > share))
    return F.get(fit, F.lit(0))


def cut(text: Column, most: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(mark))).otherwise(text)


def contains_any(text: Column, needles: list[str]) -> Column:
    """Whether the lower-cased text holds any of the needles."""
    low = F.lower(text)
    found = F.lit(False)
    for n in needles:
        found = found | F.contains(low, F.lit(n))
    return found


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays, in double precision; 0 where either is all zeros."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, e: acc + e)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def similarity(cos: Column) -> Column:
    """Cosine on the scale from 0 to 1."""
    return (F.lit(1.0) + cos) / 2


def fenced_json(text: Column) -> Column:
    """A model's reply without code fences; where that is no JSON, its first flat object."""
    bare = F.btrim(F.regexp_replace(text, r"(?m)^\s*```[A-Za-z]*\s*$", ""), F.lit(" \t\r\n"))
    flat = F.regexp_extract(bare, r"\{[^{}]*\}", 0)
    return F.coalesce(F.when(F.try_parse_json(bare).isNotNull(), bare), F.when(flat != "", flat))


def memory_type(kind: Column) -> Column:
    known = F.create_map(*(F.lit(x) for x in ("preference", "pref", "learned", "insight", "conversation_summary", "summary")))
    return F.coalesce(known[kind], kind)
