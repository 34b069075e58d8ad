"""Readers, writers and the Parquet decision store."""
