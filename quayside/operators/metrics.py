"""Rollups, quantiles, windows, alerts and sessions over usage and event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import checkpoint

from ..functions.text import PRIVATE_CHARS, lookup
from .usage import consecutive


def per_day(rows: DataFrame, *by: Column, name: str) -> DataFrame:
    return rows.groupBy(F.to_date("occurred_at").alias("day"), *by).agg(F.count("*").alias(name))


def api_usage(records: DataFrame, consumers: DataFrame) -> DataFrame:
    """Usage records with their day and their consumer's plan."""
    plans = consumers.select(F.col("id").alias("consumer_id"), "plan")
    return records.join(plans, "consumer_id").withColumn("day", F.to_date("occurred_at"))


def shares(rows: DataFrame, key: str, kind: str, name: str) -> DataFrame:
    """Rows per kind and their share of the key's rows; the window runs over the counts."""
    counts = rows.groupBy(key, kind).agg(F.count("*").alias(name))
    return counts.withColumn("share", F.round(F.col(name) / F.sum(name).over(Window.partitionBy(key)), 6))


def cost_rollup(runs: DataFrame, by: list[str]) -> DataFrame:
    return runs.groupBy(*by).agg(
        F.count("*").alias("runs"), F.sum("cost").alias("cost"), F.sum("tokens").alias("tokens"),
        F.try_divide(F.count_if("ok"), F.count("*")).alias("success"),
    )


def unit_costs(volumes: DataFrame, key: str, rates: dict[str, float]) -> DataFrame:
    """``volumes`` has a row per unit used; the rates are a stated table."""
    counts = volumes.groupBy(key, "unit").agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.sum(F.col("n") * lookup(rates, F.col("unit"), 0.0)).alias("cost"))


def checks_per_change(checks: DataFrame) -> DataFrame:
    """How many checks a source took up to its last change, per change."""
    w = Window.partitionBy("source_id").orderBy("started_at", "id")
    rows = checks.withColumn("n", F.row_number().over(w)).where("outcome = 'changed'")
    return rows.groupBy("source_id").agg(F.count("*").alias("changes"), (F.max("n") / F.count("*")).alias("checks_per_release"))


def repair_times(checks: DataFrame) -> DataFrame:
    """Mean seconds from the first failure in a row to the next check that worked."""
    w = Window.partitionBy("source_id").orderBy("started_at", "id")
    rows = consecutive(checks.withColumn("next_at", F.lead("started_at").over(w)), F.col("outcome") == "unavailable").where("run > 0")
    outages = rows.groupBy("source_id", "island").agg(F.min("started_at").alias("down"), F.max("next_at").alias("up")).where("up is not null")
    seconds = (F.unix_micros(F.col("up").cast("timestamp")) - F.unix_micros(F.col("down").cast("timestamp"))) / 1e6
    return outages.groupBy("source_id").agg(F.count("*").alias("outages"), F.avg(seconds).alias("mean_s"))


def top(rows: DataFrame, key: Column, name: str, n: int) -> DataFrame:
    """The ``n`` most frequent keys; ties by key."""
    counts = rows.groupBy(key).agg(F.count("*").alias(name))
    return counts.orderBy(F.desc(name), counts.columns[0]).limit(n)


# The names of events, by what they are about.
EVENTS = {
    "source": ["SourceChecked", "SourceChanged", "SourceUnchanged", "SourceFailed", "SourceBroken", "SourceRecovered", "SourceRelocated", "CollectorFailed", "CollectorRecovered", "AIRepairRequested", "AIRepairCompleted"],
    "candidate": ["CandidateReleaseCreated", "CandidateValidated", "CandidateRejected", "HumanReviewRequested"],
    "release": ["ReleasePublished", "ReleaseWithdrawn", "CorrectionSubmitted"],
    "product": ["SourceConflictDetected", "SourceConflictResolved", "ProductViewed"],
    "review_item": ["ReviewItemResolved"],
    "vendor": ["VendorViewed"],
    "search": ["SearchExecuted", "SearchReturnedNoResults"],
    "consumer": ["APIRequestCompleted", "APIQuotaExceeded", "APIKeyCreated"],
}


def event_counts(events: DataFrame, subject: str) -> DataFrame:
    """Events of every day and name, what the name is about, and of how many of those (``subject``) they
    were. Every name is counted; one that is not listed is about ``unknown``."""
    about = F.create_map(*[F.lit(x) for kind, names in EVENTS.items() for n in names for x in (n, kind)])
    # first by subject, so that counting subjects shuffles no event
    each = events.groupBy(F.to_date("occurred_at").alias("day"), "event_name", F.col(subject).alias("subject")).agg(F.count("*").alias("n"))
    out = each.groupBy("day", "event_name").agg(F.sum("n").alias("events"), F.count("subject").alias("subjects"))
    return out.select("day", "event_name", F.coalesce(F.try_element_at(about, F.col("event_name")), F.lit("unknown")).alias("about"), "events", "subjects")


def validated(events: DataFrame, required: dict[str, list[str]]) -> DataFrame:
    """``valid``: every property that the event's name requires is there."""
    need = F.coalesce(F.create_map(*[x for k, v in required.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("event_name")], F.array().cast("array<string>"))
    return events.withColumn("valid", F.forall(need, lambda p: F.col("properties")[p].isNotNull()))


def private(properties: Column) -> Column:
    """Without addresses and keys; texts cut to 48 characters in lower case."""
    kept = F.map_filter(properties, lambda k, _: ~k.isin("ip", "api_key", "authorization", "email"))
    return F.transform_values(kept, lambda _, v: F.left(F.lower(v), F.lit(PRIVATE_CHARS)))


def quantiles(rows: DataFrame, by: list[str], value: str, wanted: dict[str, float], bins: int = 4096, broadcast_spans: int = 100_000) -> DataFrame:
    """Exact quantiles of each group by linear interpolation, to six places; nulls do not count.

    No task holds a group's values. The values between the bounds of a rank are counted in
    ``bins`` ranges, prefix sums say which range holds the rank, and its own least and greatest
    values are the next bounds, until they are one value. Each round reads the values once more,
    and leaves about one in ``bins`` of what was between the bounds.
    """
    v = F.col(value).cast("double")
    rows = rows.select(*by, v.alias("v")).where("v is not null")
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by]
    whole = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    position = lambda q: F.lit(q) * (F.col("n") - 1)
    each = [F.struct(F.lit(name).alias("name"), f(position(q)).cast("long").alias("rank")) for name, q in wanted.items() for f in (F.floor, F.ceil)]
    ranks = whole.select(*by, "n", "low", "high", F.lit(0).cast("long").alias("before"), F.explode(F.array_distinct(F.array(*each))).alias("r")).select(*by, "n", "low", "high", "before", "r.*")
    ranks = checkpoint(ranks)
    while left := ranks.where("low < high").count():
        spans = ranks.where("low < high").select(*by, "low", "high").distinct()
        spans = F.broadcast(spans) if left <= broadcast_spans else spans
        inside = rows.alias("a").join(spans.alias("b"), [*same("a", "b"), F.col("v").between(F.col("low"), F.col("high"))])
        part = F.least(F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * bins), F.lit(bins - 1))
        found = inside.select(*[F.col(f"a.{c}").alias(c) for c in by], "low", "high", "v", part.alias("bin"))
        counts = found.groupBy(*by, "low", "high", "bin").agg(F.count("*").alias("here"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = F.sum("here").over(Window.partitionBy(*by, "low", "high").orderBy("bin"))
        counts = counts.withColumn("under", upto - F.col("here"))
        at = [*same("r", "c"), F.col("r.low") == F.col("c.low"), F.col("r.high") == F.col("c.high"), F.expr("r.rank - r.before between c.under and c.under + c.here - 1")]
        names = [F.col(f"r.{c}").alias(c) for c in (*by, "n")]
        next_ones = ranks.where("low < high").alias("r").join(counts.alias("c"), at).select(*names, F.col("least").alias("low"), F.col("most").alias("high"), (F.col("r.before") + F.col("under")).alias("before"), "name", "rank")
        ranks = checkpoint(ranks.where("low = high").unionByName(next_ones))
    of = lambda name, f: F.max(F.when((F.col("name") == name) & (F.col("rank") == f(position(wanted[name])).cast("long")), F.col("low")))
    share = lambda q: F.max(position(q) - F.floor(position(q)))
    out = [F.round(of(n, F.floor) + (of(n, F.ceil) - of(n, F.floor)) * share(q), 6).alias(n) for n, q in wanted.items()]
    return ranks.groupBy(*by).agg(*out)


def cumulative(rows: DataFrame, by: str, value: str, bounds: list[float]) -> DataFrame:
    """Counts at or under each bound, and in all, in one pass."""
    wide = rows.groupBy(by).agg(F.count("*").alias("total"), *[F.count_if(F.col(value) <= b).alias(str(b)) for b in bounds])
    each = F.explode(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"`{b}`").alias("c")) for b in bounds])).alias("x")
    return wide.select(by, "total", each).select(by, "total", "x.le", "x.c")


def histogram_quantile(counts: DataFrame, by: str, q: float) -> DataFrame:
    """Linear interpolation inside the first bucket that holds the quantile."""
    w = Window.partitionBy(by).orderBy("le")
    rows = counts.withColumn("below", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("before", F.coalesce(F.lag("c").over(w), F.lit(0)))
    at = F.col("below") + (F.col("le") - F.col("below")) * (q * F.col("total") - F.col("before")) / (F.col("c") - F.col("before"))
    return rows.where(F.col("c") >= q * F.col("total")).groupBy(by).agg(F.min_by(at, "le").alias("q"))


def windowed(rows: DataFrame, span: str, *by: str):
    return rows.groupBy(F.window("occurred_at", span), *by)


def counter_increase(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Growth of a counter that starts again at zero when its process does."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    step = F.when(before.isNull(), 0.0).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    return rows.withColumn("step", step).groupBy(key).agg(F.sum("step").alias("increase"))


def scraping(records: DataFrame, expensive: str, share: float) -> DataFrame:
    """Consumers of which more than ``share`` of the requests go to an expensive endpoint."""
    rows = records.groupBy("consumer_id").agg(
        F.count("*").alias("requests"), (F.count_if(F.col("endpoint") == expensive) / F.count("*")).alias("part"), F.count_if(F.col("status_code") == 429).alias("throttled")
    )
    return rows.where(F.col("part") > share).select("consumer_id", "requests", F.round("part", 6).alias("expensive_share"), "throttled")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each bucket, split at pauses of ``gap``, with what happened in them."""
    search, view = F.col("event_name") == "SearchExecuted", F.col("event_name") == "ProductViewed"
    rows = events.groupBy("session_bucket", F.session_window("occurred_at", gap).alias("span")).agg(
        F.min("occurred_at").alias("started_at"), F.bool_or(search).alias("searched"), F.bool_or(search & (F.col("result_count") > 0)).alias("found"), F.bool_or(view).alias("viewed"),
        F.coalesce(F.min(F.when(search, F.col("occurred_at"))) < F.max(F.when(view, F.col("occurred_at"))), F.lit(False)).alias("converted"),
    )
    return rows.withColumn("abandoned", F.col("found") & ~F.col("viewed"))


def ranked(totals: DataFrame, key: str, value: str, tiles: int, buckets: int = 1024) -> DataFrame:
    """``totals`` (one row a whole-number ``key``) with place, the rank by ``value`` downwards, and
    decile, the tile of ``tiles`` by value and then key.

    No window takes all rows. Rows are counted by value and by range of keys; prefix sums over
    these counts say how many rows come before each range, and a row's place in its range is
    its own window.
    """
    low, high, n = totals.agg(F.min(key), F.max(key), F.count("*")).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // buckets))
    rows = totals.withColumn("bucket", F.floor((F.col(key) - F.lit(low)) / width))
    counts = rows.groupBy(value, "bucket").agg(F.count("*").alias("here"))
    above = counts.groupBy(value).agg(F.sum("here").alias("same"))
    # one row a different value
    above = above.withColumn("above", F.sum("same").over(Window.orderBy(F.desc(value))) - F.col("same"))
    before = F.sum("here").over(Window.partitionBy(value).orderBy("bucket")) - F.col("here")
    starts = counts.select(value, "bucket", before.alias("before")).join(above.select(value, "above"), value)
    nth = F.row_number().over(Window.partitionBy(value, "bucket").orderBy(key))
    placed = rows.join(starts, [value, "bucket"]).withColumn("nth", F.col("above") + F.col("before") + nth)
    size, longer = n // tiles, n % tiles  # the first tiles have one more
    in_longer = F.ceil(F.col("nth") / (size + 1))
    tile = F.when(F.col("nth") <= longer * (size + 1), in_longer).otherwise(longer + F.ceil((F.col("nth") - longer * (size + 1)) / max(1, size)))
    return placed.withColumns({"place": (F.col("above") + 1).cast("int"), "decile": tile.cast("int")}).drop("bucket", "before", "above", "nth")
