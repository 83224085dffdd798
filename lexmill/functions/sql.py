"""Fragments of DuckDB SQL that say what :mod:`lexmill.functions.text` says."""

from .text import NUMVAL, STOPWORDS

WORDS = "list_filter(regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 1)"
SQUEEZE = "trim(regexp_replace({t}, '\\s+', ' ', 'g'))"
SNIPPET = "(CASE WHEN length({s}) > 240 THEN left({s}, 239) || '…' ELSE {s} END)"
STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
NORM_KEY = "array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower({t}), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda w: w <> '' AND w NOT IN (" + STOP + "))[1:8], ' ')"

def words(t: str) -> str:
    return WORDS.format(t=t)


def squeeze(t: str) -> str:
    return SQUEEZE.format(t=t)


def snippet(t: str) -> str:
    return SNIPPET.format(s=squeeze(t))


def norm_key(t: str) -> str:
    return NORM_KEY.format(t=t)


def norm_value(t: str) -> str:
    return f"(CASE WHEN regexp_extract({t}, '{NUMVAL}', 1) <> '' THEN regexp_extract({t}, '{NUMVAL}', 1) || lower(regexp_extract({t}, '{NUMVAL}', 2)) ELSE left(lower({squeeze(t)}), 40) END)"
