"""Readers, and the Parquet store."""
