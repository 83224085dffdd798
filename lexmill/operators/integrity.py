"""Corpus audits: contradictions, blind spots, resilience gaps, drift, health."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import BOOL, KEYVAL, STOPWORDS, norm_value, snippet
from .batches import mapped
from .spread import spread

MOST_ISSUES = 50
MOST_CHUNKS = 1200
WEIGHTS = {"low": 3, "medium": 7, "high": 12, "critical": 18}
ISSUE_TYPES = ["blind_spot", "contradiction", "drift", "resilience_gap"]
#: topic, severity where it is missing, what documents about it hold
TOPICS = [
    ("backups & restore", "high", "snapshot|retention|restore|backup"),
    ("disaster recovery", "high", "region failover|failover region|drp|dr plan|disaster recovery"),
    ("encryption", "medium", "at rest|https|tls|encryption"),
    ("monitoring & alerting", "high", "escalation|on-call|pager|alert|metrics|monitoring"),
    ("rate limiting", "medium", "quota|throttle|rate limit"),
    ("rollbacks", "medium", "canary|feature flag|revert|roll back|rollback"),
    ("security access control", "medium", "authz|permission|least privilege|rbac|access control"),
    ("timeouts & retries", "medium", "circuit breaker|backoff|retry|timeout"),
]
DEPENDENCIES = [
    ("cache", "high", "cache|memcached|redis"),
    ("database", "high", "rds|database|mysql|postgres"),
    ("object storage", "medium", "object storage|blob storage|gcs|s3"),
    ("queue", "medium", "queue|sqs|rabbitmq|kafka"),
]
MITIGATIONS = "timeout|retry|rate limit|circuit breaker|degraded|fallback|failover|multi-az|cluster|replication|replica"
_SUFFIXES = "(ms|sec|seconds|min|mins|hours|days|s|%)$"
RULES = [f"{verb}{negated}" for negated in ("", "_not") for verb in ("should", "must")]
NO_RISK = "No major risks were found; repeat the scan after changes."


#: of each kind of claim: what it begins to be found by, in lower case, and its pattern
_CLAIM = (("should be", "must be", "are", "is", ":", "="), re.compile(KEYVAL, re.A))
_RULE = (("must", "should"), re.compile(BOOL, re.A))
_UP_TO_OTHER, _LETTER = re.compile(r".*[^\w /-]", re.S | re.A), re.compile("[a-z]", re.I | re.A)
_KEY_LENGTH = 61
_TO_SPACE, _STOPWORDS = str.maketrans(dict.fromkeys("_/-", " ")), frozenset(STOPWORDS)


def _lower(text: str) -> str:
    low = text.lower()
    # a letter that becomes two: places wouldn't be the same
    return low if len(low) == len(text) else re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def _matches(text: str, verbs: tuple[str, ...], whole: re.Pattern, low: str | None = None) -> Iterator[re.Match]:
    """What ``whole.finditer(text)`` gives, in time linear in the text.

    A match begins at most ``_KEY_LENGTH`` characters and white space before a
    verb, at the first letter of what may be a key: one attempt a verb replaces
    one from every letter.
    """
    low, places = _lower(text) if low is None else low, []
    for verb in verbs:
        at = low.find(verb)
        while at >= 0:
            places.append(at)
            at = low.find(verb, at + 1)
    end = 0
    for verb in sorted(places):
        if verb < end + 3:
            continue
        at = verb
        while at > end and text[at - 1] in " \t\n\v\f\r":
            at -= 1
        before = max(end, at - _KEY_LENGTH)
        other = _UP_TO_OTHER.match(text[before:at])
        first = _LETTER.search(text, before + other.end() if other else before, verb)
        match = whole.match(text, first.start()) if first else None
        if match:
            yield match
            end = match.end()


def _texts(b: pa.RecordBatch) -> Iterator[str]:
    return (x.as_py().decode(errors="replace") for x in b.column(1).cast(pa.binary()))


def _norm_key(named: str) -> str:
    """What :func:`lexmill.functions.text.norm_key` makes of a key, which is ASCII."""
    return " ".join([w for w in named.lower().translate(_TO_SPACE).split() if w not in _STOPWORDS][:8])


def _claimed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for i, text in enumerate(_texts(b)):
            low = _lower(text)
            for rule, kind in enumerate((_CLAIM, _RULE)):
                for m in _matches(text, *kind, low):
                    named, value = m.groups()
                    if key := _norm_key(named):
                        for values, x in zip(out, (i, rule > 0, key, value)):
                            values.append(x)
        at, rule, key, value = out
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(rule, pa.bool_()), pa.array(key, pa.string()), pa.array(value, pa.string())], names=[b.schema.names[0], "_rule", "claim_key", "_value"])


def claims(chunks: DataFrame, key: str = "doc_id", text: str = "text", distinct: bool = True) -> DataFrame:
    """(key, claim_key, claim_value) distinct per document, unless repetitions do no harm: what is said to be what, and what must or should be."""
    named = _claims(_body(chunks, key, text), key)
    return named.distinct() if distinct else named


def _body(chunks: DataFrame, key: str, text: str) -> DataFrame:
    return spread(chunks.select(key, F.coalesce(F.col(text), F.lit("")).alias("t")))


def _claims(body: DataFrame, key: str) -> DataFrame:
    schema = T.StructType([body.schema[key], T.StructField("_rule", T.BooleanType()), T.StructField("claim_key", T.StringType()), T.StructField("_value", T.StringType())])
    found = mapped(body, _claimed, schema)
    value = F.when(F.col("_rule"), F.replace(F.lower("_value"), F.lit(" "), F.lit("_"))).otherwise(norm_value(F.trim("_value")))
    return found.select(key, "claim_key", value.alias("claim_value"))


def severe(value: Column) -> Column:
    """Whether a claimed value is a quantity or a rule."""
    plain = value.rlike(r"^[0-9]*\.?[0-9]*$") & value.rlike("[0-9]")
    return value.rlike(_SUFFIXES) | plain | value.isin(RULES)


def contradictions(claimed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(claim_key, distinct_values, first_values, severity, first_doc): topics with two values or more."""
    per_value = claimed.groupBy("claim_key", "claim_value").agg(F.min(key).alias("at"))
    return (
        per_value.groupBy("claim_key")
        .agg(
            F.count("*").alias("distinct_values"), F.max(severe(F.col("claim_value"))).alias("severe"), F.min("at").alias("first_doc"),
            F.transform(F.slice(F.array_sort(F.collect_list(F.struct("at", "claim_value"))), 1, 4), lambda x: x["claim_value"]).alias("first_values"),
        )
        .where("distinct_values >= 2")
        .select("claim_key", "distinct_values", F.array_join("first_values", ", ").alias("first_values"), F.when(F.col("severe"), "high").otherwise("medium").alias("severity"), "first_doc")
    )


def _named(body: DataFrame, lists: list[str]) -> DataFrame:
    """One row (h0, h1, ...): for each list of needles, whether any text of ``body`` (key, t), lower-cased, holds one of them.

    One expression for all lists, in time linear in the texts, finds those that
    are looked at.  A list of which a partition holds a needle isn't searched
    there again.
    """
    needles = [n.split("|") for n in lists]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = dict(enumerate(needles))
        for b in batches:
            if not left:
                continue
            # İ becomes i and a dot, which the expression doesn't know
            some = "|".join(["İ", *(re.escape(w) for n in left.values() for w in n)])
            for text in _texts(b.filter(pc.match_substring_regex(b.column(1), some, ignore_case=True))):
                low = text.lower()
                for i in [i for i, n in left.items() if any(w in low for w in n)]:
                    del left[i]
        yield pa.RecordBatch.from_arrays([pa.array([i not in left]) for i in range(len(needles))], names=names)

    names = [f"h{i}" for i in range(len(needles))]
    each = mapped(body, run, ", ".join(f"{n} boolean" for n in names))
    return each.agg(*(F.coalesce(F.bool_or(n), F.lit(False)).alias(n) for n in names))


def _topics(at: int = 0) -> Column:
    return F.array(*(F.struct(F.lit(t).alias("topic"), F.lit(s).alias("severity"), F.col(f"h{at + i}").alias("covered")) for i, (t, s, _) in enumerate(TOPICS)))


def _dependencies(at: int = 0) -> Column:
    mitigated = F.col(f"h{at + len(DEPENDENCIES)}")
    return F.array(*(F.struct(F.lit(d).alias("dependency"), F.lit(s).alias("severity"), F.col(f"h{at + i}").alias("mentioned"), mitigated.alias("mitigated"), (F.col(f"h{at + i}") & ~mitigated).alias("gap")) for i, (d, s, _) in enumerate(DEPENDENCIES)))


_TOPIC_NEEDLES, _DEPENDENCY_NEEDLES = [n for *_, n in TOPICS], [*(n for *_, n in DEPENDENCIES), MITIGATIONS]


def _alone(texts: DataFrame, text: str) -> DataFrame:
    return _body(texts.withColumn("_k", F.lit(0)), "_k", text)


def blind_spots(texts: DataFrame, text: str = "text") -> DataFrame:
    """(topic, severity, covered): whether any text is about each topic; one pass for all of them."""
    return _named(_alone(texts, text), _TOPIC_NEEDLES).select(F.explode(_topics()).alias("r")).select("r.*")


def resilience_gaps(texts: DataFrame, text: str = "text") -> DataFrame:
    """(dependency, severity, mentioned, mitigated, gap): mitigation anywhere in the corpus counts for all."""
    return _named(_alone(texts, text), _DEPENDENCY_NEEDLES).select(F.explode(_dependencies()).alias("r")).select("r.*")


def fingerprints(chunks: DataFrame, file: str = "source", order: str = "doc_id", text: str = "text") -> DataFrame:
    """(file, fingerprint): a hash of each file's name, number of chunks, and the first 400 characters of its first ten."""
    name = F.coalesce(F.when(F.col(file) != "", F.col(file)), F.lit("unknown"))
    rows = chunks.select(name.alias("file"), F.col(order).alias("_o"), F.left(F.coalesce(F.col(text), F.lit("")), F.lit(400)).alias("_t"))
    # the bound on the rank lets each partition pass on ten texts of a file, however large the file
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy("_o", "_t"))).where("_n <= 10")
    first = ranked.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("_n", "_t"))).alias("first"))
    per_file = rows.groupBy("file").agg(F.count("*").alias("n")).join(first, "file")
    body = F.array_join(F.transform("first", lambda x: x["_t"]), "\n")
    return per_file.select("file", F.sha2(F.concat(F.col("file"), F.lit("|"), F.col("n").cast("string"), F.lit("|"), body), 256).alias("fingerprint"))


def drift(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(file, fingerprint, previous): files whose fingerprint is another than before; new and deleted ones aren't drift."""
    before = previous.select("file", F.col("fingerprint").alias("previous"))
    return current.join(before, "file").where((F.col("previous") != "") & (F.col("previous") != F.col("fingerprint")))


def issues(chunks: DataFrame, previous: DataFrame | None = None, file: str = "source", order: str = "doc_id", text: str = "text") -> DataFrame:
    """(type, severity, title, recommendation, ord) of all detectors, each capped, in order of severity, type and title."""
    body = _body(chunks, order, text)  # one plan in both parts, so that a spread table is shuffled once
    said = contradictions(_claims(body, order), order).orderBy("first_doc", "claim_key").limit(MOST_ISSUES)
    made = lambda kind, severity, title, name, advice: F.struct(F.lit(kind).alias("type"), severity.alias("severity"), F.concat(F.lit(title), name).alias("title"), F.concat(F.lit(advice), name).alias("recommendation"))
    spots = F.transform(F.filter(_topics(), lambda x: ~x["covered"]), lambda x: made("blind_spot", x["severity"], "Not documented: ", x["topic"], "Write down who does what about "))
    gaps = F.transform(F.filter(_dependencies(len(TOPICS)), lambda x: x["gap"]), lambda x: made("resilience_gap", x["severity"], "No mitigation: ", x["dependency"], "Describe what happens when this fails: "))
    parts = [
        said.select(F.lit("contradiction").alias("type"), "severity", F.concat(F.lit("Conflicting statements: "), "claim_key").alias("title"), F.lit("Settle this topic in one place and point the others to it.").alias("recommendation")),
        _named(body, [*_TOPIC_NEEDLES, *_DEPENDENCY_NEEDLES]).select(F.explode(F.concat(spots, gaps)).alias("r")).select("r.*"),
    ]
    if previous is not None:
        moved = drift(fingerprints(chunks, file, order, text), previous).orderBy("file").limit(MOST_ISSUES)
        parts.append(moved.select(F.lit("drift").alias("type"), F.lit("medium").alias("severity"), F.concat(F.lit("Changed: "), "file").alias("title"), F.lit("Check what refers to the changed documents.").alias("recommendation")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # at most a few hundred rows: the window needs no partition
    return out.withColumn("ord", F.row_number().over(Window.orderBy(severity_rank(F.col("severity")), "type", "title")))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 0).when(severity == "high", 1).when(severity == "medium", 2).when(severity == "low", 3).otherwise(9)


def health(found: DataFrame) -> DataFrame:
    """One row (score, band, penalty, and a count per type) of issues (type, severity)."""
    weight = F.lit(WEIGHTS["medium"])
    for name, w in WEIGHTS.items():
        weight = F.when(F.col("severity") == name, w).otherwise(weight)
    total = found.agg(F.coalesce(F.sum(weight), F.lit(0)).cast("long").alias("penalty"), *(F.coalesce(F.sum(F.when(F.col("type") == t, 1).otherwise(0)), F.lit(0)).cast("long").alias(f"n_{t}") for t in ISSUE_TYPES))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - F.col("penalty"))).cast("long")
    return total.withColumn("score", score).withColumn("band", F.when(F.col("score") >= 90, "excellent").when(F.col("score") >= 75, "good").when(F.col("score") >= 55, "fair").otherwise("poor"))


def recommendations(found: DataFrame, most: int = 6) -> DataFrame:
    """(place, recommendation): the first ``most`` distinct ones in order of the issues, or a sentence that there are none."""
    firsts = found.where("recommendation <> ''").groupBy("recommendation").agg(F.min("ord").alias("ord")).orderBy("ord").limit(most)
    # one row, so that the issues are found once and not again to see whether there are any
    all_ = firsts.agg(F.array_sort(F.collect_list(F.struct("ord", "recommendation"))).alias("r"))
    shown = F.when(F.size("r") > 0, F.transform("r", lambda x: x["recommendation"])).otherwise(F.array(F.lit(NO_RISK)))
    return all_.select(F.posexplode(shown).alias("place", "recommendation")).select((F.col("place") + 1).alias("place"), "recommendation")


def evidence(claimed: DataFrame, chunks: DataFrame, key: str = "doc_id", text: str = "text", most: int = 3) -> DataFrame:
    """(claim_key, claim_value, key, snippet): the first document of each of a contradiction's first values."""
    firsts = claimed.groupBy("claim_key", "claim_value").agg(F.min(key).alias(key))
    order = Window.partitionBy("claim_key").orderBy(key, "claim_value")
    shown = firsts.withColumn("_n", F.row_number().over(order)).withColumn("_all", F.count("*").over(Window.partitionBy("claim_key"))).where((F.col("_all") >= 2) & (F.col("_n") <= min(2, most)))
    return shown.join(chunks.select(key, snippet(F.col(text)).alias("snippet")), key).select("claim_key", "claim_value", key, "snippet")
