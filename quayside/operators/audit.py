"""Row rules, uniqueness and references checked over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per row and rule that it breaks; a rule that is null for a row is kept."""
    codes = F.array_compact(F.array(*[F.when(broken, F.lit(code)) for code, broken in rules.items()]))
    return rows.withColumn("code", F.explode(codes))


def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(*key).agg(F.count("*").alias("copies")).where("copies > 1")


def unknown(rows: DataFrame, column: str, known: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose reference is not null and not in ``known``."""
    return rows.where(F.col(column).isNotNull()).join(known.select(F.col(key).alias(column)), column, "left_anti")
