"""A whole integrity scan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import integrity, sampling


def scan(chunks: DataFrame, previous: DataFrame | None = None, most_chunks: int = integrity.MOST_CHUNKS) -> dict[str, DataFrame]:
    """Issues, health, recommendations and fingerprints of a stratified sample of the corpus."""
    sample = sampling.stratified(chunks, most_chunks)
    found = integrity.issues(sample, previous)
    return {
        "issues": found.where(f"ord <= {integrity.MOST_ISSUES}"), "health": integrity.health(found), "recommendations": integrity.recommendations(found), "fingerprints": integrity.fingerprints(sample),
    }
