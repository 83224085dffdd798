"""Conversation memory: gates, near-duplicates, search, clusters, history."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_any, memory_type
from . import vector

INSERT_SIMILARITY, SEARCH_SIMILARITY, MERGE_COSINE = 0.92, 0.2, 0.72
INTERVAL, LEAST_ANSWER, HISTORY_TURNS = 3, 100, 6
GREETINGS = sorted("bye okay ok thanks hey hi hello".split()) + ["thank you"]
META = "what is this|help me|what can you do|how do you work"


def every_nth_turn(turns: DataFrame, user: str, order: list[str], interval: int = INTERVAL) -> DataFrame:
    """Each user's turns number ``interval``, twice that, and so on."""
    return turns.withColumn("turn_number", F.row_number().over(Window.partitionBy(user).orderBy(*order))).where(F.col("turn_number") % interval == 0)


def worth_extracting(question: Column, answer: Column) -> Column:
    """Whether a turn is more than a greeting, a short answer or a question about the system."""
    q = F.trim(F.lower(question))
    return (F.length(q) >= 8) & ~q.isin(GREETINGS) & (F.length(answer) >= LEAST_ANSWER) & ~contains_any(q, META.split("|"))


def turn_pairs(messages: DataFrame, session: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(session, order, question, answer): each user message with the message that follows it, if an assistant's."""
    w = Window.partitionBy(session).orderBy(order)
    following = messages.select(session, order, role, F.col(text).alias("question"), F.lead(role).over(w).alias("_r"), F.lead(text).over(w).alias("answer"))
    return following.where((F.col(role) == "user") & (F.col("_r") == "assistant")).select(session, order, "question", "answer")


def search(memories: DataFrame, queries: DataFrame, k: int = 5, kind: str | None = None, least_importance: float = 0.0, **columns) -> DataFrame:
    """As :func:`lexmill.operators.vector.search`; kind is filtered before the best ``k``, importance after, so fewer may remain."""
    if kind is not None:
        memories = memories.where(memory_type(F.col("memory_type")) == kind)
    key = columns.get("key", "vec_id")
    hits = vector.search(memories, queries, k, SEARCH_SIMILARITY, **columns)
    if least_importance > 0:
        hits = hits.join(memories.select(key, "importance"), key).where(F.col("importance") >= least_importance).drop("importance")
    return hits


def format_memories(hits: DataFrame, query_key: str = "query_id") -> DataFrame:
    """(query_key, formatted): a line per memory with its similarity in whole per cent."""
    line = F.concat(F.lit("- "), "content", F.lit(" ("), F.floor(F.col("score") * 100).cast("string"), F.lit("%)"))
    return hits.groupBy(query_key).agg(F.concat(F.lit("[Memory] Known from earlier chats:\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n")).alias("formatted"))


def _greedy(rows: pd.DataFrame, limit: float, strict: bool) -> np.ndarray:
    """For each row in order the position of the leader it joins, its own if it leads."""
    x = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(norm > 0, norm, 1)
    leader = np.full(len(x), -1)
    for i in range(len(x)):
        if leader[i] >= 0:
            continue
        leader[i] = i
        cos = np.round(x[i + 1 :] @ x[i], 9)
        joins = (cos > limit) if strict else (cos >= limit)
        open_ = leader[i + 1 :] < 0
        leader[i + 1 :][joins & open_] = i
    return leader


def insert_new(memories: DataFrame, user: str, order: str, limit: float = INSERT_SIMILARITY) -> DataFrame:
    """(user, order, kept): memories inserted one after the other, left out where one kept before is too similar.

    A row is left out exactly if some kept earlier row is within the limit, so
    the kept rows are the leaders of one pass in order.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable").reset_index(drop=True)
        leader = _greedy(rows, round(2 * limit - 1, 9), True)
        return pd.DataFrame({user: rows[user], order: rows[order], "kept": leader == np.arange(len(rows))})

    types = dict(memories.dtypes)
    return memories.select(user, order, F.col("embedding")).where("embedding is not null").groupBy(user).applyInPandas(run, f"{user} {types[user]}, {order} {types[order]}, kept boolean")


def leader_clusters(memories: DataFrame, user: str, order: str, cosine: float = MERGE_COSINE) -> DataFrame:
    """(user, order, leader, members): leader clusters of two or more, each row joining the first leader near enough."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable").reset_index(drop=True)
        leader = _greedy(rows, cosine, False) if len(rows) >= 3 else np.arange(len(rows))
        size = np.bincount(leader, minlength=len(rows))
        out = pd.DataFrame({user: rows[user], order: rows[order], "leader": rows[order].to_numpy()[leader], "members": size[leader].astype(np.int64)})
        return out[out["members"] >= 2]

    types = dict(memories.dtypes)
    return memories.select(user, order, F.col("embedding")).where("embedding is not null").groupBy(user).applyInPandas(run, f"{user} {types[user]}, {order} {types[order]}, leader {types[order]}, members bigint")


def consolidate(memories: DataFrame, user: str, order: str, merge: Callable[[Column], Column] | None = None, cosine: float = MERGE_COSINE) -> DataFrame:
    """(user, order, content, importance): clusters merged into their leader's row, all else as it was.

    ``merge`` makes one text of an array of texts; by default they are joined.
    A merged row has its members' highest importance, 1 at most.
    """
    merge = merge or (lambda texts: F.array_join(F.array_distinct(texts), " "))
    found = leader_clusters(memories, user, order, cosine)
    marked = memories.select(user, order, "content", "importance").join(found.select(user, order, "leader"), [user, order], "left")
    grouped = marked.groupBy(user, F.coalesce("leader", order).alias(order)).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "content"))).alias("c"), F.least(F.lit(1.0), F.max("importance")).alias("importance"))
    return grouped.select(user, order, F.when(F.size("c") > 1, merge(F.transform("c", lambda x: x["content"]))).otherwise(F.col("c")[0]["content"]).alias("content"), "importance")


def history_tail(messages: DataFrame, n: int, session: str = "conv_id", order: str = "turn", text: str = "text", most: int = 600) -> DataFrame:
    """The last ``n`` messages of each session, longer ones cut with three dots."""
    w = Window.partitionBy(session).orderBy(F.desc(order))
    cut = F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(F.col(text))
    return messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).withColumn(text, cut).drop("_n")


def compact_history(messages: DataFrame, turns: int = HISTORY_TURNS, session: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(session, ord, role, content): the last ``2 * turns`` messages, before them a list of what older ones were about."""
    keep = 2 * turns
    ranked = messages.withColumn("_n", F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order))))
    recent = ranked.where(F.col("_n") <= keep).select(session, (F.lit(keep + 2) - F.col("_n")).alias("ord"), role, F.left(text, F.lit(600)).alias("content"))
    old = ranked.where(F.col("_n") > keep)
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: (F.length(w) > 4) & w.rlike(r"^\p{L}+$"))
    topics = old.select(session, F.explode_outer(F.when(F.col(role) == "user", words)).alias("w")).groupBy(session).agg(F.slice(F.array_sort(F.collect_set("w")), 1, 15).alias("w"))
    preamble = topics.select(session, F.explode(F.array(
        F.struct(F.lit(0).alias("ord"), F.lit("user").alias("role"), F.concat(F.lit("[Discussed before: "), F.array_join("w", ", "), F.lit("]")).alias("content")),
        F.struct(F.lit(1).alias("ord"), F.lit("assistant").alias("role"), F.lit("Noted; I know what came before.").alias("content")))).alias("r"))
    return preamble.select(session, "r.ord", F.col("r.role").alias(role), "r.content").unionByName(recent)
