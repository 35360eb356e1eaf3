"""Declared state against stored state: differences, merges and exact replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _hash(df: DataFrame, key: list[str]) -> DataFrame:
    rest = sorted(c for c in df.columns if c not in key)
    return df.select(*key, F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256).alias("h"))


def diff(want: DataFrame, have: DataFrame, key: list[str]) -> DataFrame:
    """insert, update, unchanged or orphaned for every key of either side."""
    a, b = _hash(want, key).withColumnRenamed("h", "w"), _hash(have, key).withColumnRenamed("h", "o")
    action = F.when(F.col("o").isNull(), "insert").when(F.col("w").isNull(), "orphaned").when(F.col("w") == F.col("o"), "unchanged").otherwise("update")
    return a.join(b, key, "full_outer").select(*key, action.alias("action"))


def merge(want: DataFrame, have: DataFrame, key: list[str], declared: list[str], observed: list[str], kept_unless: dict[str, str]) -> DataFrame:
    """Upsert: declared columns come from ``want``, observed ones from ``have``; a column of
    ``kept_unless`` keeps its stored value unless that is the named one or missing."""
    h = have.select(*key, *[F.col(c).alias(f"_{c}") for c in (*declared, *observed, *kept_unless)], F.lit(True).alias("_stored"))
    w = want.select(*key, *declared, *kept_unless, F.lit(True).alias("_wanted"))
    both = w.join(h, key, "full_outer")
    pick = lambda c: F.when(F.col("_wanted"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
    keep = lambda c, v: F.coalesce(F.nullif(F.col(f"_{c}"), F.lit(v)), F.col(c), F.col(f"_{c}")).alias(c)
    return both.select(*key, *[pick(c) for c in declared], *[F.col(f"_{c}").alias(c) for c in observed], *[keep(c, v) for c, v in kept_unless.items()])


def exact_replace(stored: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Rows of every parent in ``new`` are exactly those of ``new``; other parents keep theirs."""
    return stored.join(new.select(parent).distinct(), parent, "left_anti").select(stored.columns).union(new.select(stored.columns)).distinct()
