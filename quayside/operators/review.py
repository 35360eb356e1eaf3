"""Review items: priority, service level, queue and detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from .frames import left_by

# Points of a review's priority, and the popularity that makes an item urgent.
BASE, CONFIDENCE, POPULARITY_CAP, SECURITY, CONFLICT, SECURITY_TYPE, HIGH_POPULARITY = 100, 100, 100, 150, 100, 50, 75


def score_review(rows: DataFrame) -> DataFrame:
    """priority, reasons and sla. ``rows``: quality_class, confidence, popularity,
    security_critical, conflicted, release_type; missing product facts count as none."""
    rank, secure = rules.authority_rank(F.col("quality_class")), F.coalesce("security_critical", F.lit(False))
    popular, hot = F.coalesce("popularity", F.lit(0)), F.coalesce("conflicted", F.lit(False))
    security_type = F.col("release_type").isin("security_update", "advisory")
    parts = {
        "base priority": F.lit(BASE),
        "source authority": rank,
        "extraction confidence": F.floor(F.greatest(F.lit(0), F.least(F.lit(1), F.col("confidence"))) * CONFIDENCE).cast("int"),
        "product popularity": F.greatest(F.lit(0), F.least(popular, F.lit(POPULARITY_CAP))),
        "security-critical product": F.when(secure, SECURITY).otherwise(0),
        "unresolved multi-source conflict": F.when(hot, CONFLICT).otherwise(0),
        "security-related release type": F.when(security_type, SECURITY_TYPE).otherwise(0),
    }
    reasons = F.array_compact(F.array(*[F.when(v > 0, F.concat(F.lit(f"{k} (+"), v.cast("string"), F.lit(")"))) for k, v in parts.items()]))
    sla = (
        F.when(secure & (hot | (popular >= HIGH_POPULARITY)), "urgent").when(hot | secure, "high")
        .when(rank >= rules.AUTHORITY["authorized_portal"], "standard").otherwise("low")
    )
    return rows.withColumns({"priority": sum(parts.values(), F.lit(0)), "reasons": reasons, "sla": sla})


def scored(candidates: DataFrame, sources: DataFrame, products: DataFrame) -> DataFrame:
    s = sources.select(F.col("id").alias("source_id"), "quality_class")
    p = products.select(F.col("id").alias("product_id"), "popularity", "security_critical")
    rows = left_by(candidates.join(s, "source_id"), p, "product_id").withColumn("conflicted", F.lit(False))
    return score_review(rows)


def queue(items: DataFrame, today: Column) -> DataFrame:
    """Items with their age and a payload for the reviewer."""
    payload = F.create_map(F.lit("source_id"), F.col("source_id").cast("string"), F.lit("hint"), F.col("hint"), F.lit("version"), F.trim("raw_version"))
    return items.withColumn("age_days", F.datediff(today, "discovered_on")).withColumn("payload", payload)


def filtered(items: DataFrame, **allowed: list) -> DataFrame:
    """Rows whose columns are in the given lists; an empty list restricts nothing."""
    for column, values in allowed.items():
        if values:
            items = items.where(F.col(column).isin(values))
    return items


def breaches(items: DataFrame, days: dict[str, int]) -> DataFrame:
    from ..functions.text import lookup

    return items.where(F.col("age_days") > lookup(days, F.col("sla"), None))


def detail(items: DataFrame, evidence: DataFrame, sources: DataFrame, observations: DataFrame) -> DataFrame:
    """An item with its evidence, source and how many sources claim something on its subject."""
    e = evidence.select(F.col("id").alias("evidence_id"), "n_chars")
    s = sources.select(F.col("id").alias("source_id"), F.col("slug").alias("source"))
    claims = observations.groupBy("product_id", "channel").agg(F.countDistinct("source_id").alias("claims"))
    out = items.join(e, "evidence_id", "left").join(s, "source_id", "left")
    out = left_by(out, claims, "product_id", "channel")
    return out.withColumn("claims", F.coalesce("claims", F.lit(0)))
