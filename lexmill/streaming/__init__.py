"""Incremental and stateful variants."""
