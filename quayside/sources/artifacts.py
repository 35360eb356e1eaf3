"""Stored page bodies, addressed by content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Larger bodies are never read.
MAX_BYTES = 32 * 1024 * 1024


def scan(artifacts: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """Bodies of at most ``most`` bytes, with their hash and size."""
    return artifacts.where(F.octet_length("body") <= most).withColumns({"content_hash": F.sha2("body", 256), "bytes": F.octet_length("body").cast("long")})


def store(new: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row per content: first and last id, references and bytes. ``stored`` rows have the
    same columns and are merged; the result replaces them (copy on write)."""
    rows = scan(new).groupBy("content_hash").agg(
        F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("reference_count"), F.max("bytes").alias("bytes")
    )
    if stored is None:
        return rows
    return rows.unionByName(stored).groupBy("content_hash").agg(
        F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"), F.sum("reference_count").alias("reference_count"), F.max("bytes").alias("bytes")
    )
