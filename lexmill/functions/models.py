"""Plug points for models, with deterministic defaults that need none.

The defaults make results reproducible; they don't stand for any real model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 64


def hashing_embedder(dimensions: int = DIMENSIONS) -> Callable[[Column], Column]:
    """Unit vectors of signed word counts, each word hashed to a dimension."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import re
        import zlib

        words = re.compile(r"\w+")
        for texts in batches:
            out = []
            for t in texts:
                v = np.zeros(dimensions)
                for w in words.findall((t or "").lower()):
                    h = zlib.crc32(w.encode())
                    v[h % dimensions] += 1 - 2 * (h >> 31)
                norm = np.linalg.norm(v)
                out.append((v / norm if norm else v).astype(np.float32))
            yield pd.Series(out)

    return embed


def per_text(reply: Callable[[str], str]) -> Callable[[Column], Column]:
    """A language model ``reply`` as a column function, called once per prompt and never by the optimiser's whim."""

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            yield pd.Series([None if p is None else reply(p) for p in prompts])

    return ask.asNondeterministic()


def no_model(prompt: str) -> str:
    """The default language model: it answers with an empty JSON object."""
    return "{}"
