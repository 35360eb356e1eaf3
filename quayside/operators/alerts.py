"""Alert rules as a table, evaluated over samples of metrics on a time grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Rule, metric, comparison, threshold, seconds that a breach must last, severity, and
# whether a step of the grid without a sample is a breach.
RULES = [
    ("APIErrorRateHigh", "api_error_ratio", ">", 0.05, 300, "page", False),
    ("APILatencyHigh", "api_latency_p95_s", ">", 1.0, 600, "page", False),
    ("QueueDepthHigh", "queue_depth", ">", 500.0, 900, "ticket", False),
    ("QueueDepthCritical", "queue_depth", ">", 2000.0, 900, "page", False),
    ("QueueOldestMessageAgeHigh", "queue_oldest_message_s", ">", 900.0, 300, "page", False),
    ("QueueDeadLetterArrivals", "dead_letters_15m", ">", 0.0, 60, "ticket", False),
    ("QueueDeadLetterArrivalsCritical", "dead_letters_15m", ">", 10.0, 60, "page", False),
    ("CollectorFailureRateByVendor", "collector_failure_ratio", ">", 0.5, 3600, "ticket", False),
    ("SourcesNewlyBroken", "collector_failures_15m", ">=", 3.0, 300, "ticket", False),
    ("PublicationRateZero", "publications_while_checked", "=", 0.0, 1800, "page", False),
    ("AIBudgetThreshold", "ai_budget_share", ">", 0.8, 900, "ticket", False),
    ("AIBudgetExceeded", "ai_budget_share", ">", 1.0, 900, "page", False),
    ("DBConnectionSaturation", "db_pool_share", ">", 0.9, 300, "page", False),
]
SCHEMA = "rule string, metric string, comparison string, threshold double, hold_s int, severity string, on_gap boolean"


def rule_table(spark: SparkSession, rules: list[tuple] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, SCHEMA)


def breached(value: Column, comparison: Column, threshold: Column) -> Column:
    """Whether a sample meets its rule's condition; one without a value does not."""
    told = (
        F.when(comparison == ">", value > threshold).when(comparison == ">=", value >= threshold).when(comparison == "<", value < threshold)
        .when(comparison == "<=", value <= threshold).when(comparison == "=", value == threshold)
    )
    return F.coalesce(told, F.lit(False))


def stretches(samples: DataFrame, rules: DataFrame, step: int, until: Column | None = None) -> DataFrame:
    """rule, severity, series, pending_at, firing_at and resolved_at of every stretch of breaches.

    ``samples``: metric, series, ``at`` (on a grid of ``step`` seconds) and value, one row for each
    of them. A rule fires once a stretch has lasted for its ``hold_s``, and is resolved at the
    first step of the grid without a breach, no later than ``until`` (the last sample of all): a
    gap ends a stretch, or is one for rules with ``on_gap``. Null times: not so far. Windows go
    over a series' steps, never over records; the grid of silent steps is only made for such rules.
    """
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    timed = samples.select("metric", "series", seconds("at").alias("t"), "value")
    ends = until.cast("timestamp") if until is not None else F.lit(None).cast("timestamp")
    last = timed.agg(F.coalesce(F.floor(F.unix_seconds(ends) / step) * step, F.max("t")).alias("until"))
    seen = timed.join(rules, "metric").withColumn("breached", breached(F.col("value"), F.col("comparison"), F.col("threshold")))
    gaps = rules.where("on_gap")
    spans = timed.join(gaps.select("metric").distinct(), "metric", "left_semi").groupBy("metric", "series").agg(F.min("t").alias("first")).join(F.broadcast(last))  # one row
    grid = spans.select("metric", "series", F.explode(F.sequence(F.col("first"), F.greatest("first", "until"), F.lit(step))).alias("t"))
    silent = grid.join(timed, ["metric", "series", "t"], "left_anti").join(gaps, "metric").withColumn("breached", F.lit(True))
    keep = ["rule", "severity", "series", "hold_s", "t"]
    hot = seen.where("breached").select(*keep).union(silent.select(*keep))
    w = Window.partitionBy("rule", "series").orderBy("t")
    islands = hot.withColumn("island", F.col("t") - step * F.row_number().over(w))
    out = islands.groupBy("rule", "severity", "series", "hold_s", "island").agg(F.min("t").alias("since"), F.max("t").alias("last")).join(F.broadcast(last))  # one row
    fires, over = F.col("since") + F.ceil(F.col("hold_s") / step) * step, F.col("last") + step
    at = lambda c: F.timestamp_seconds(c)
    return out.where(F.col("since") <= F.col("until")).select(
        "rule", "severity", "series", at(F.col("since")).alias("pending_at"), F.when(fires <= F.least("last", "until"), at(fires)).alias("firing_at"), F.when(over <= F.col("until"), at(over)).alias("resolved_at")
    )


def events(spans: DataFrame) -> DataFrame:
    """The changes of state that ``stretches`` are made of: rule, series, event and at."""
    ended = F.when(F.col("firing_at").isNotNull(), "resolved").otherwise("cleared")
    each = F.explode(F.array(*[F.struct(n.alias("event"), F.col(c).alias("at")) for n, c in ((F.lit("pending"), "pending_at"), (F.lit("firing"), "firing_at"), (ended, "resolved_at"))]))
    return spans.select("rule", "series", each.alias("e")).select("rule", "series", "e.event", "e.at").where("at is not null")
