"""Runs, rates and rollups over check, usage and event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def consecutive(checks: DataFrame, counts: Column, key: str = "source_id") -> DataFrame:
    """``run``: how many checks in a row, up to and with this one, meet ``counts``."""
    order = Window.partitionBy(key).orderBy("started_at", "id")
    breaks = F.sum(F.when(counts, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = checks.withColumn("island", breaks).withColumn("hit", counts.cast("int"))
    inside = Window.partitionBy(key, "island").orderBy("started_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("run", F.when(F.col("hit") == 1, F.sum("hit").over(inside)).otherwise(0))


def rolling_counts(records: DataFrame, by: str, spans: dict[str, int], block: int = 3600) -> DataFrame:
    """Per record, how many of the same ``by`` fell in the seconds before it, itself included.

    A span's count is the difference of two counts from the beginning. Such a count is that of
    the whole blocks of ``block`` seconds before, summed over blocks, and that inside one block,
    so no window takes more than one block of seconds of a key, however many records it has.
    """
    timed = records.withColumn("second", F.unix_seconds(F.col("occurred_at").cast("timestamp")))
    seconds = timed.groupBy(by, "second").agg(F.count("*").alias("n"))
    points = [F.struct(F.lit("").alias("span"), F.col("second").alias("t"), F.col("n").alias("n"))]
    points += [F.struct(F.lit(name).alias("span"), (F.col("second") - span - 1).alias("t"), F.lit(0).cast("long").alias("n")) for name, span in spans.items()]
    asked = seconds.select(by, "second", F.explode(F.array(*points)).alias("p")).select(by, "second", "p.*", F.floor(F.col("p.t") / block).alias("block"))
    inside = Window.partitionBy(by, "block").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    blocks = asked.groupBy(by, "block").agg(F.sum("n").alias("here"))
    before = blocks.select(F.col(by).alias("_by"), F.col("block").alias("_block"), (F.sum("here").over(Window.partitionBy(by).orderBy("block")) - F.col("here")).alias("before"))
    counted = asked.withColumn("within", F.sum("n").over(inside)).join(before, F.col(by).eqNullSafe(F.col("_by")) & (F.col("block") == F.col("_block")))
    upto = lambda span: F.max(F.when(F.col("span") == span, F.col("within") + F.col("before")))
    told = counted.groupBy(F.col(by).alias("_by"), F.col("second").alias("_second")).agg(*[(upto("") - upto(name)).alias(name) for name in spans])
    return timed.join(told, F.col(by).eqNullSafe(F.col("_by")) & (F.col("second") == F.col("_second"))).drop("_by", "_second")


def rollup(records: DataFrame) -> DataFrame:
    """Counters of every consumer per day and per month, in one pass over the records."""
    grain = F.explode(F.array(F.lit("day"), F.lit("month"))).alias("grain")
    rows = records.select("*", grain).withColumn(
        "period", F.when(F.col("grain") == "day", F.to_date("occurred_at")).otherwise(F.trunc("occurred_at", "month"))
    )
    return rows.groupBy("consumer_id", "grain", "period").agg(
        F.count("*").alias("requests"), F.count_if(F.col("status_code") >= 400).alias("errors"),
        F.count_if(F.col("status_code") == 429).alias("rate_limited"), F.sum("bytes_out").alias("bytes_out"),
        F.sum(F.when(F.col("status_code") != 429, 1).otherwise(0)).alias("quota_units"),
    )


def quota_status(records: DataFrame, consumers: DataFrame, month: str) -> DataFrame:
    """Each consumer's use of its monthly quota."""
    used = rollup(records).where((F.col("grain") == "month") & (F.col("period") == month)).select("consumer_id", F.col("quota_units").alias("used"))
    rows = consumers.join(used, consumers.id == used.consumer_id, "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return rows.select(
        "id", "used", (F.col("used") < F.col("monthly_quota")).alias("allowed"),
        F.greatest(F.col("monthly_quota") - F.col("used"), F.lit(0)).alias("remaining"),
    )
