"""Snapshots: one nested record per release, written as JSON lines and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def records(releases: DataFrame, vendors: DataFrame, products: DataFrame, mappings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Releases with their vendor, the slugs of their products in order, and their evidence."""
    v = vendors.select(F.col("id").alias("vendor_id"), F.col("slug").alias("vendor"))
    p = mappings.join(products.select(F.col("id").alias("product_id"), "slug"), "product_id").groupBy(F.col("release_id").alias("id")).agg(F.sort_array(F.collect_list("slug")).alias("products"))
    e = evidence.select(F.col("id").alias("evidence_id"), F.struct(F.col("source_id"), F.col("n_chars")).alias("evidence"))
    rows = releases.join(v, "vendor_id").join(p, "id", "left").join(e, "evidence_id", "left")
    return rows.withColumn("products", F.coalesce("products", F.array().cast("array<string>")))


def write(rows: DataFrame, path: str) -> None:
    rows.sort("vendor", "id").write.mode("overwrite").json(path)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def manifest(rows: DataFrame) -> DataFrame:
    """One row: how many releases, and the slugs of vendors and products that appear."""
    names = rows.select(F.explode("products").alias("slug")).distinct().agg(F.sort_array(F.collect_list("slug")).alias("products"))
    vendors = rows.select("vendor").distinct().agg(F.sort_array(F.collect_list("vendor")).alias("vendors"))
    return rows.agg(F.count("*").alias("release_count")).crossJoin(vendors).crossJoin(names)


def plan_import(rows: DataFrame, vendors: DataFrame, products: DataFrame, stored: DataFrame) -> DataFrame:
    """What an import does with each record: unknown (a vendor or product that is not
    registered, on which the import fails), skipped (already stored) or imported."""
    bad_vendor = rows.join(vendors.select(F.col("slug").alias("vendor")), "vendor", "left_anti").select("id")
    named = rows.select("id", F.explode("products").alias("slug"))
    bad = bad_vendor.union(named.join(products.select("slug"), "slug", "left_anti").select("id")).distinct().withColumn("bad", F.lit(True))
    have = stored.select("id", F.lit(True).alias("have"))
    action = F.when(F.col("bad"), "unknown").when(F.col("have"), "skipped").otherwise("imported")
    return rows.select("id").join(bad, "id", "left").join(have, "id", "left").select("id", action.alias("action"))
