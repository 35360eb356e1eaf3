"""Structured Streaming jobs over checks, usage and events.

Every job takes a streaming frame and gives a streaming frame; ``drain`` runs one to the end
of what is there and gives the result as a batch frame, for tests and for backfills.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.checks import FAILURES, in_order, step_health


def source(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files as a stream; the schema is that of the files now there."""
    schema = spark.read.parquet(path).schema
    head, _, name = path.rpartition("/")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{head}/[{name[0]}]{name[1:]}")
    # watermarks need instants; the session's time zone is UTC
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.simpleString() == "timestamp_ntz"})


def shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    base = base or tempfile.mkdtemp(prefix="quayside-stream-")
    return f"{base}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame, mode: str = "append", latest_by: list[str] | None = None) -> DataFrame:
    """Run to the end of the input; ``latest_by``: of each key only what the last batch said."""
    spark = stream.sparkSession
    folder = shared_folder(spark)
    schema = stream.schema

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/number={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    out = spark.read.schema(StructType([*schema, StructField("batch", IntegerType())])).parquet(f"{folder}/out/number=*")
    if latest_by:
        w = Window.partitionBy(*latest_by).orderBy(F.desc("batch"))
        out = out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return out.drop("batch")


def replay(steps: list[DataFrame], job: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """``step`` and what ``job`` said after it. The rows of each step arrive as files together and
    are a run of their own, which takes up the checkpoint where the run before left it."""
    spark, folder = steps[0].sparkSession, shared_folder(steps[0].sparkSession)
    out = None
    for k, rows in enumerate(steps):
        rows.write.parquet(f"{folder}/in/s{k}")

        def put(batch: DataFrame, number: int, k: int = k) -> None:
            batch.withColumn("step", F.lit(k)).write.mode("overwrite").parquet(f"{folder}/out/number={number}")

        out = job(spark.readStream.schema(rows.schema).parquet(f"{folder}/in/*"))
        q = out.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(put).start()
        q.awaitTermination()
    return spark.read.schema(StructType([*out.schema, StructField("step", IntegerType())])).parquet(f"{folder}/out/number=*")


def usage_dedupe(records: DataFrame, late: str = "1 day") -> DataFrame:
    """Each idempotency key once, however often a record is sent."""
    return records.withWatermark("occurred_at", late).dropDuplicatesWithinWatermark(["id"])


def usage_rollup(records: DataFrame, late: str = "1 day") -> DataFrame:
    """Counters per consumer and day, brought up to date as records come in."""
    rows = records.withWatermark("occurred_at", late).groupBy("consumer_id", F.window("occurred_at", "1 day"))
    return rows.agg(F.count("*").alias("requests"), F.count_if(F.col("status_code") >= 400).alias("errors")).select("consumer_id", F.to_date("window.start").alias("day"), "requests", "errors")


def observations(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The claim that stands for each source, product and channel, whatever order claims come in.

    Keeping the largest by the order of claims is an aggregate, so the state is one row a key.
    """
    best = F.max(F.struct(*order, F.col("version").alias("v"), F.col("release_date").alias("d"), F.col("observed_on").alias("o"))).alias("best")
    out = rows.groupBy("source_id", "product_id", "channel").agg(best, F.min("observed_on").alias("first_observed_on"))
    return out.select("source_id", "product_id", "channel", F.col("best.v").alias("version"), F.col("best.d").alias("release_date"), F.col("best.o").alias("observed_on"), "first_observed_on")


def periods(days: DataFrame) -> DataFrame:
    """The counters of ``usage_rollup`` by day and by month. Months are sums over days, so the stream keeps
    only days that can still change."""
    month = days.groupBy("consumer_id", F.trunc("day", "month").alias("period")).agg(F.sum("requests").alias("requests"), F.sum("errors").alias("errors"))
    both = days.select("consumer_id", F.lit("day").alias("grain"), F.col("day").alias("period"), "requests", "errors")
    return both.union(month.select("consumer_id", F.lit("month"), "period", "requests", "errors"))


def source_health(checks: DataFrame, start: str = "active", late: str = "1 hour") -> DataFrame:
    """Checks so far, failures and unchanged checks in a row, health, the last outcome and its second of each
    source, in order of time inside a batch. ``next_check`` of a source follows from these."""
    schema = "checks long, failures long, unchanged long, health string, outcome string, now_s long"

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, failures, unchanged, health, outcome, now = state.get if state.exists else (0, 0, 0, start, "", 0)
        rows = pd.concat(list(batches)).sort_values(["started_at", "id"])
        for outcome in rows["outcome"]:
            failures = failures + 1 if outcome in FAILURES else 0
            unchanged = unchanged + 1 if outcome == "unchanged" else 0
            health = step_health(health, outcome, failures)
            n += 1
        now = max(now, int(rows["started_at"].iloc[-1].timestamp()))
        state.update((n, failures, unchanged, health, outcome, now))
        yield pd.DataFrame({"source_id": [key[0]], "checks": [n], "failures": [failures], "unchanged": [unchanged], "health": [health], "outcome": [outcome], "now_s": [now]})

    return checks.withWatermark("started_at", late).groupBy("source_id").applyInPandasWithState(fold, f"source_id long, {schema}", schema, "update", GroupStateTimeout.NoTimeout)


def traffic(records: DataFrame, late: str = "10 minutes", span: str = "2 hours", step: str = "1 hour") -> DataFrame:
    """Requests and their share of errors in sliding windows of each endpoint, when these are over."""
    rows = records.withWatermark("occurred_at", late).groupBy(F.window("occurred_at", span, step), F.col("endpoint").alias("series"))
    out = rows.agg(F.count("*").cast("double").alias("requests"), (F.count_if(F.col("status_code") >= 500) / F.count("*")).alias("error_ratio"))
    return out.select("series", F.window_time("window").alias("at"), "requests", "error_ratio")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "30 minutes") -> DataFrame:
    """Sessions that are over: searches that found something and were not followed by a view."""
    rows = events.withWatermark("occurred_at", late).groupBy("session_bucket", F.session_window("occurred_at", gap))
    out = rows.agg(F.count("*").alias("events"), F.bool_or((F.col("event_name") == "SearchExecuted") & (F.col("result_count") > 0)).alias("found"), F.bool_or(F.col("event_name") == "ProductViewed").alias("viewed"))
    return out.select("session_bucket", F.col("session_window.start").alias("started_at"), "events", (F.col("found") & ~F.col("viewed")).alias("abandoned"))


def search_views(events: DataFrame, within: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Searches with the views of the same session that followed in time; none: null."""
    searches = events.where("event_name = 'SearchExecuted'").select(F.col("session_bucket").alias("s"), F.col("occurred_at").alias("searched_at"), F.col("id").alias("search_id")).withWatermark("searched_at", late)
    views = events.where("event_name = 'ProductViewed'").select(F.col("session_bucket").alias("v"), F.col("occurred_at").alias("viewed_at"), F.col("id").alias("view_id")).withWatermark("viewed_at", late)
    near = F.expr(f"s = v AND viewed_at > searched_at AND viewed_at <= searched_at + INTERVAL {within}")
    return searches.join(views, near, "left_outer").select("search_id", "view_id", "searched_at", "viewed_at")


def take_tokens(times: list[float], tokens: float, seen: float | None, burst: int, per_minute: float) -> tuple[list[bool], float, float | None]:
    """Requests in order of time against one bucket: which pass, and the bucket after them."""
    passed = []
    for t in times:
        if seen is not None and t > seen:
            tokens = min(burst, tokens + (t - seen) * per_minute / 60)
        seen = t
        passed.append(tokens >= 1)
        tokens -= passed[-1]
    return passed, tokens, seen


def token_buckets(records: DataFrame, burst: int = 3, per_minute: float = 0.01, late: str = "10 minutes") -> DataFrame:
    """How many requests of each consumer pass and how many are throttled."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, seen, allowed, denied = state.get if state.exists else (float(burst), None, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["second", "id"])
        passed, tokens, seen = take_tokens(rows["second"].tolist(), tokens, seen, burst, per_minute)
        allowed, denied = allowed + sum(passed), denied + len(passed) - sum(passed)
        state.update((float(tokens), float(seen), allowed, denied))
        yield pd.DataFrame({"consumer_id": [key[0]], "allowed": [allowed], "denied": [denied]})

    timed = records.withWatermark("occurred_at", late).withColumn("second", F.unix_micros(F.col("occurred_at").cast("timestamp")) / 1e6)
    return timed.groupBy("consumer_id").applyInPandasWithState(
        fold, "consumer_id long, allowed long, denied long", "tokens double, seen double, allowed long, denied long", "update", GroupStateTimeout.NoTimeout
    )


def throttle_audit(records: DataFrame, burst: int = 3, per_minute: float = 0.01) -> DataFrame:
    """The same decisions over a log: every request with whether its consumer's bucket let it pass.

    A bucket's level depends on every request before, so one task goes through a consumer's
    requests; it holds the bucket and one batch of them.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, tokens, seen = None, float(burst), None
        for rows in batches:
            allowed = []
            for _, run in rows.groupby((rows["key"] != rows["key"].shift()).cumsum(), sort=False):
                if run["key"].iloc[0] != last:
                    last, tokens, seen = run["key"].iloc[0], float(burst), None
                passed, tokens, seen = take_tokens(run["second"].tolist(), tokens, seen, burst, per_minute)
                allowed += passed
            yield rows.assign(allowed=allowed)[["id", "consumer_id", "allowed"]]

    second = F.unix_micros(F.col("occurred_at").cast("timestamp")) / 1e6
    timed = records.select("id", "consumer_id", second.alias("second"), F.coalesce(F.col("consumer_id").cast("string"), F.lit("")).alias("key"))
    return in_order(timed, "key", "second", "id").mapInPandas(fold, "id long, consumer_id long, allowed boolean")


def each_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run batch operators over every micro-batch and give all that they made. A batch that is
    run again overwrites its own folder, so its rows count once."""
    spark = stream.sparkSession
    folder = shared_folder(spark)

    def put(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{folder}/out/number={number}")

    q = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out/number=*")


def late_data(records: DataFrame, arrived: str, event: str, late: str) -> DataFrame:
    """Rows that came after the watermark had passed them, by the largest event time before them."""
    hours = records.groupBy(F.date_trunc("hour", arrived).alias("h")).agg(F.max(event).alias("top"))
    # the running maximum goes over one row an hour; inside an hour the hour before it counts
    before = hours.withColumn("mark", F.max("top").over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1)) - F.expr(f"INTERVAL {late}"))
    return records.withColumn("h", F.date_trunc("hour", arrived)).join(before.select("h", "mark"), "h").where(F.col(event) < F.col("mark")).drop("h")
