"""Registry of the release-catalogue queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import conflicts, latest
from . import joins, pipeline, rollups, scalars, streams, texts, windows
from .bindings import Model
from .registry import ORACLES, QUERIES, query

__all__ = ["flagship", "joins", "oracle_sql", "pipeline", "queries", "rollups", "scalars", "streams", "texts", "windows"]


@query(
    "serveable_latest",
    f"WITH {windows.VERDICTS} SELECT l.product_id, l.channel, l.id, l.version, d.product_id IS NOT NULL AS disputed FROM "
    f"(SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY {windows.NEWEST}) AS n FROM ({windows.LIVE})) l "
    "LEFT JOIN (SELECT DISTINCT product_id FROM verdicts WHERE status = 'unresolved') d ON d.product_id = l.product_id WHERE n = 1",
)
def serveable_latest(m: Model) -> DataFrame:
    """The latest serveable release of each product, and whether any sources dispute the product."""
    newest = latest.latest_release(m.releases, m.mappings, by_channel=False).select("product_id", "channel", "id", "version")
    verdicts = conflicts.detect_conflicts(m.observations, m.sources)
    hot = verdicts.where("status = 'unresolved'").select("product_id", F.lit(True).alias("disputed")).distinct()
    return newest.join(hot, "product_id", "left").withColumn("disputed", F.coalesce("disputed", F.lit(False)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serveable_latest(Model(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES
