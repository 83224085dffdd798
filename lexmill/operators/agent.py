"""The search loop: a model picks a tool each step, the tools are DataFrame operators."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

MOST_STEPS = 5


@dataclass
class Result:
    answer: str = ""
    steps: list[tuple[int, str, str]] = field(default_factory=list)
    sources: list[tuple] = field(default_factory=list)


def parse_call(reply: str) -> dict:
    """The first JSON object of a reply; an answer in plain words where there is none."""
    at, to = reply.find("{"), reply.rfind("}")
    try:
        call = json.loads(reply[at : to + 1]) if at >= 0 else None
    except ValueError:
        call = None
    return call if isinstance(call, dict) and "tool" in call else {"tool": "answer", "input": reply}


def run(query: str, search: Callable[[str], DataFrame], get_file: Callable[[str], DataFrame], llm: Callable[[str], str], most_steps: int = MOST_STEPS) -> Result:
    """Up to ``most_steps`` calls of search, get_file or answer; an unknown tool ends the loop.  Six hits of each search are shown to the model."""
    out, seen = Result(), ""
    for step in range(1, most_steps + 1):
        call = parse_call(llm(f"Question: {query}\nFound so far:\n{seen}\nCall search, get_file or answer, as JSON with tool and input."))
        tool, value = call["tool"], str(call.get("input", ""))
        out.steps.append((step, tool, value))
        if tool == "answer":
            out.answer = value
            return out
        if tool not in ("search", "get_file"):
            break
        for row in (search if tool == "search" else get_file)(value).limit(6).collect():
            key = (row["source"], row["place"])
            if key not in out.sources:
                out.sources.append(key)
            seen += f"[{row['source']}] {row['text'][:800]}\n"
    out.answer = f"Found {len(out.sources)} passages about: {query}"
    return out
