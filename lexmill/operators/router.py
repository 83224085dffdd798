"""Rule-based routing of questions, as one conditional expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import contains_any

#: category, strategy, depth, confidence, what the question holds; the first that applies counts.
RULES = [
    ("code_lookup", "focused", 4, 0.7, "get the class|what is the function|where is|find the|show me"),
    ("debugging", "broad", 8, 0.7, "broken|not working|exception|crash|fail|bug|error"),
    ("architecture", "broad", 8, 0.7, "project|layout|organized|overview|architecture|structure"),
    ("configuration", "focused", 4, 0.7, "option|env|environment|setting|config"),
    ("comparison", "multi", 6, 0.6, "between|versus|vs |compare|difference"),
    ("explanation", "broad", 6, 0.6, "how to|why does|what does|explain|how does"),
]


def route(question: Column) -> Column:
    """A struct (category, retrieval_strategy, suggested_top_k, confidence)."""
    text = F.trim(F.lower(F.coalesce(question, F.lit(""))))
    row = lambda c, s, k, p: F.struct(F.lit(c).alias("category"), F.lit(s).alias("retrieval_strategy"), F.lit(k).alias("suggested_top_k"), F.lit(p).alias("confidence"))
    out = None
    for category, strategy, depth, confidence, needles in RULES:
        test = contains_any(text, needles.split("|"))
        out = F.when(test, row(category, strategy, depth, confidence)) if out is None else out.when(test, row(category, strategy, depth, confidence))
    return out.otherwise(row("general", "broad", 5, 0.3))


def sql(question: str) -> str:
    """The category as DuckDB SQL."""
    cases = " ".join("WHEN " + " OR ".join(f"contains(trim(lower({question})), '{n}')" for n in needles.split("|")) + f" THEN '{c}'" for c, _, _, _, needles in RULES)
    return f"CASE {cases} ELSE 'general' END"
