"""Memories made by a language model from turns and sessions; the model is a plug point."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.models import no_model, per_text
from ..functions.text import head_and_tail, memory_type
from . import memory

MOST_PER_TURN, MOST_TAGS, LEAST_CONTENT = 3, 2, 10
_REPLY = "array<struct<c:string,content:string,t:string,memory_type:string,i:double,importance:double,g:array<string>,tags:array<string>>>"
_SUMMARY = "struct<s:string,summary:string,i:double,importance:double,g:array<string>,topics:array<string>>"


def _unfenced(reply: Column) -> Column:
    return F.regexp_replace(reply, r"(?m)^\s*```[A-Za-z]*\s*$", "")


def _share(first: Column, second: Column, default: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(first, second, F.lit(default))))


def extract(turns: DataFrame, llm: Callable[[str], str] = no_model, user: str = "user_id", order: str = "turn", interval: int = memory.INTERVAL, novel: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(user, order, content, memory_type, importance, tags, source_query) from (user, order, question, answer).

    Only every ``interval``-th turn of a user, and of those only what passes the
    gates, is shown to the model; replies that aren't JSON lists give nothing.
    """
    due = memory.every_nth_turn(turns, user, [order], interval).where(memory.worth_extracting(F.col("question"), F.col("answer")))
    if novel is not None:
        due = due.where(novel(F.col("question"), F.col("answer")))
    prompt = F.concat(F.lit("List what is worth remembering, as JSON.\nQ: "), head_and_tail(F.col("question"), 400), F.lit("\nA: "), head_and_tail(F.col("answer"), 800))
    asked = due.select(user, order, "question", per_text(llm)(prompt).alias("reply"))
    parts = asked.select(user, order, "question", F.posexplode(F.slice(F.from_json(_unfenced(F.col("reply")), _REPLY), 1, MOST_PER_TURN)).alias("n", "m"))
    content = F.coalesce("m.c", "m.content")
    made = parts.select(
        user, order, "n", content.alias("content"), memory_type(F.coalesce("m.t", "m.memory_type", F.lit("fact"))).alias("memory_type"), _share(F.col("m.i"), F.col("m.importance"), 0.5).alias("importance"),
        F.slice(F.coalesce("m.g", "m.tags", F.array().cast("array<string>")), 1, MOST_TAGS).alias("tags"), F.left("question", F.lit(100)).alias("source_query"))
    return made.where(F.length("content") >= LEAST_CONTENT)


def summarise(messages: DataFrame, llm: Callable[[str], str] = no_model, session: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(session, content, memory_type, importance, tags) of sessions of four messages or more, from their first twenty."""
    ranked = messages.withColumn("_n", F.row_number().over(Window.partitionBy(session).orderBy(order)))
    line = F.concat(F.upper(F.left(role, F.lit(1))), F.lit(": "), F.left(text, F.lit(200)))
    joined = ranked.groupBy(session).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= 20, F.struct("_n", line.alias("l"))))), lambda x: x["l"]), "\n").alias("body")).where("n >= 4")
    replied = joined.select(session, F.from_json(_unfenced(per_text(llm)(F.concat(F.lit("Sum up this conversation, as JSON.\n"), "body"))), _SUMMARY).alias("r"))
    made = replied.select(session, F.coalesce("r.s", "r.summary").alias("content"), F.lit("summary").alias("memory_type"), _share(F.col("r.i"), F.col("r.importance"), 0.6).alias("importance"), F.slice(F.coalesce("r.g", "r.topics", F.array().cast("array<string>")), 1, 3).alias("tags"))
    return made.where("content <> ''")
