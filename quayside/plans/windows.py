"""Queries on windows and history (latest, recommended, previous, runs, ranks)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import conflicts, latest, metrics, usage
from .registry import query

LIVE = "SELECT m.product_id, r.* FROM releases r JOIN mappings m ON m.release_id = r.id WHERE NOT r.withdrawn"
NEWEST = "release_date DESC NULLS LAST, first_observed_on DESC, id DESC"
CURRENT = (
    "current AS (SELECT * FROM (SELECT *, min(observed_on) OVER (PARTITION BY source_id, product_id, channel) AS first_observed_on, "
    "row_number() OVER (PARTITION BY source_id, product_id, channel ORDER BY release_date DESC NULLS LAST, observed_on DESC, version DESC, order_id DESC, line_no DESC) AS place FROM observations) WHERE place = 1)"
)
RANKS = "CASE quality_class WHEN 'official_manufacturer' THEN 50 WHEN 'authorized_portal' THEN 40 WHEN 'vendor_repository' THEN 30 WHEN 'trusted_community' THEN 20 WHEN 'unknown_third_party' THEN 10 ELSE 0 END"
ELIGIBLE = "(enabled AND health IN ('active', 'degraded') AND robots IN ('allowed', 'not_applicable') AND terms IN ('approved', 'restricted'))"
CLAIMS = f"{CURRENT}, claims AS (SELECT c.*, {RANKS} AS rank FROM current c JOIN sources s ON s.id = c.source_id WHERE {ELIGIBLE})"
VERDICTS = (
    CLAIMS + ", pairs AS (SELECT a.product_id, a.channel, a.source_id, a.version, a.rank, b.version AS other_version, b.source_id AS other_source, b.rank AS other_rank "
    "FROM claims a LEFT JOIN claims b ON a.product_id = b.product_id AND a.channel = b.channel AND a.version <> b.version AND a.source_id <> b.source_id), "
    "verdicts AS (SELECT product_id, channel, source_id, version, rank, "
    "coalesce(string_agg(DISTINCT CASE WHEN other_rank >= rank THEN other_version END, ',' ORDER BY CASE WHEN other_rank >= rank THEN other_version END), '') AS conflicting_versions, "
    "coalesce(string_agg(DISTINCT CASE WHEN other_rank < rank THEN other_version END, ',' ORDER BY CASE WHEN other_rank < rank THEN other_version END), '') AS outranked_versions, "
    "max(CASE WHEN other_rank >= rank THEN other_rank END) AS authority_rank, "
    "CASE WHEN count(CASE WHEN other_rank >= rank THEN 1 END) > 0 THEN 'unresolved' WHEN count(CASE WHEN other_rank < rank THEN 1 END) > 0 THEN 'outranked' ELSE 'none' END AS status "
    "FROM pairs GROUP BY product_id, channel, source_id, version, rank)"
)


@query("latest_release", f"SELECT product_id, channel, id, version FROM (SELECT *, row_number() OVER (PARTITION BY product_id, channel ORDER BY {NEWEST}) AS n FROM ({LIVE})) WHERE n = 1")
def latest_release(m):
    return latest.latest_release(m.releases, m.mappings).select("product_id", "channel", "id", "version")


@query("latest_release_any_channel", f"SELECT product_id, channel, id, version FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY {NEWEST}) AS n FROM ({LIVE})) WHERE n = 1")
def latest_any(m):
    return latest.latest_release(m.releases, m.mappings, by_channel=False).select("product_id", "channel", "id", "version")


@query("latest_flag", "SELECT product_id, channel, id, ok AND row_number() OVER (PARTITION BY product_id, channel, ok ORDER BY release_date DESC NULLS LAST, first_observed_on DESC, id) = 1 AS is_latest FROM (SELECT *, NOT withdrawn AND release_type <> 'advisory' AS ok FROM releases r JOIN mappings m ON m.release_id = r.id)")
def latest_flag(m):
    return latest.latest_flag(m.releases, m.mappings).select("product_id", "channel", "id", "is_latest")


@query("recommended_release", f"SELECT p.id AS product_id, x.id AS recommended_release_id FROM products p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY {NEWEST}) AS n FROM ({LIVE} AND r.recommended)) x ON x.product_id = p.id AND n = 1")
def recommended(m):
    best = latest.recommended_release(m.releases, m.mappings).select("product_id", F.col("id").alias("recommended_release_id"))
    return m.products.select(F.col("id").alias("product_id")).join(best, "product_id", "left")


@query("current_observation", f"WITH {CURRENT} SELECT source_id, product_id, channel, version, release_date, observed_on, first_observed_on FROM current")
def current_observation(m):
    return conflicts.current_observation(m.observations).select("source_id", "product_id", "channel", "version", "release_date", "observed_on", "first_observed_on")


TRANSITION = """CASE WHEN previous IS NULL THEN 'plausible' WHEN previous = version THEN 'identical'
  WHEN regexp_replace(regexp_replace(previous, '[0-9]+', '#', 'g'), '[^#a-z]', '', 'g') <> regexp_replace(regexp_replace(version, '[0-9]+', '#', 'g'), '[^#a-z]', '', 'g') THEN 'uncomparable'
  WHEN CAST(regexp_extract(version, '[0-9]+') AS BIGINT) < CAST(regexp_extract(previous, '[0-9]+') AS BIGINT) OR CAST(regexp_extract(version, '[0-9]+') AS BIGINT) > CAST(regexp_extract(previous, '[0-9]+') AS BIGINT) + 5 THEN 'suspicious' ELSE 'plausible' END"""


@query("previous_version", f"SELECT product_id, channel, id, version, previous, {TRANSITION} AS transition FROM (SELECT *, lag(version) OVER (PARTITION BY product_id, channel ORDER BY release_date ASC NULLS FIRST, first_observed_on, id) AS previous FROM ({LIVE}))")
def previous_version(m):
    return latest.previous_version(m.releases, m.mappings).select("product_id", "channel", "id", "version", "previous", "transition")


@query("latest_as_of", "SELECT day, product_id, id FROM (SELECT d.day, m.product_id, r.id, row_number() OVER (PARTITION BY d.day, m.product_id ORDER BY release_date DESC NULLS LAST, first_observed_on DESC, id DESC) AS n FROM releases r JOIN mappings m ON m.release_id = r.id JOIN (SELECT DISTINCT CAST(date_trunc('year', o_orderdate) AS DATE) AS day FROM orders) d ON r.first_observed_on <= d.day AND NOT (r.withdrawn AND r.last_verified_on <= d.day)) WHERE n = 1")
def latest_as_of(m):
    days = m.orders.select(F.trunc("o_orderdate", "year").alias("day")).distinct()
    rel = m.releases.withColumn("withdrawn_on", F.when(F.col("withdrawn"), F.col("last_verified_on")))
    return latest.latest_as_of(rel, m.dealt_mappings, days).select("day", "product_id", "id")


@query("history_window", "SELECT c.plan, count(*) AS visible, min(r.id) AS first_id FROM (SELECT DISTINCT plan, CASE WHEN plan IN ('anonymous', 'free') THEN DATE '1997-06-15' END AS since FROM consumers) c JOIN releases r ON c.since IS NULL OR CASE WHEN release_date IS NOT NULL THEN CASE release_date_precision WHEN 'month_only' THEN last_day(release_date) WHEN 'year_only' THEN make_date(year(release_date), 12, 31) ELSE release_date END >= c.since ELSE first_observed_on >= c.since END GROUP BY c.plan")
def history(m):
    plans = m.consumers.select("plan").distinct().withColumn("since", dates.window_start(F.col("plan"), F.lit("1998-06-15").cast("date")))
    rows = m.releases.crossJoin(F.broadcast(plans))  # four plans
    return latest.history_window(rows, F.col("since")).groupBy("plan").agg(F.count("*").alias("visible"), F.min("id").alias("first_id"))


@query("plan_window_start", "SELECT id, CASE WHEN plan IN ('anonymous', 'free') THEN DATE '2023-02-01' END AS since FROM consumers")
def plan_window_start(m):
    return m.consumers.select("id", dates.window_start(F.col("plan"), F.lit("2024-02-01").cast("date")).alias("since"))


@query("latest_outside_window", f"SELECT product_id, id, release_date IS NOT NULL AND CASE release_date_precision WHEN 'month_only' THEN last_day(release_date) WHEN 'year_only' THEN make_date(year(release_date), 12, 31) ELSE release_date END < DATE '1998-01-01' AS outside FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY {NEWEST}) AS n FROM ({LIVE})) WHERE n = 1")
def latest_outside_window(m):
    out = F.coalesce(dates.period_end(F.col("release_date"), F.col("release_date_precision")) < F.lit("1998-01-01").cast("date"), F.lit(False))
    return latest.latest_release(m.releases, m.mappings, by_channel=False).select("product_id", "id", out.alias("outside"))


@query("duplicate_semi", f"SELECT c.id, c.product_id, min_by(r.id, (r.first_observed_on, r.id)) AS duplicate_id FROM (SELECT id, product_id, (id % 12) || '.' || (line_no % 5) AS version, CASE line_no % 3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '5-LOW' ELSE '2-HIGH' END AS channel FROM candidates WHERE product_id IS NOT NULL) c LEFT JOIN ({LIVE}) r ON r.product_id = c.product_id AND r.version = c.version AND r.channel = c.channel GROUP BY c.id, c.product_id")
def duplicate_semi(m):
    wanted = m.candidates.where("product_id is not null").select(
        F.col("id").alias("candidate_id"), "product_id", F.concat_ws(".", F.col("id") % 12, F.col("line_no") % 5).alias("version"),
        F.expr("CASE line_no % 3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '5-LOW' ELSE '2-HIGH' END").alias("channel"),
    )
    return latest.duplicates(m.releases, m.mappings, wanted).select(F.col("candidate_id").alias("id"), "product_id", "duplicate_id")


@query("consecutive_runs", "SELECT id, source_id, outcome, CASE WHEN outcome = 'unavailable' THEN row_number() OVER (PARTITION BY source_id, island ORDER BY started_at, id) - CASE WHEN first_fail THEN 0 ELSE 1 END ELSE 0 END AS failures FROM (SELECT *, first_value(outcome) OVER (PARTITION BY source_id, island ORDER BY started_at, id) = 'unavailable' AS first_fail FROM (SELECT *, sum(CASE WHEN outcome <> 'unavailable' THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY started_at, id ROWS UNBOUNDED PRECEDING) AS island FROM checks))")
def consecutive_runs(m):
    return usage.consecutive(m.checks, F.col("outcome") == "unavailable").select("id", "source_id", "outcome", F.col("run").alias("failures"))


@query("rolling_rate", "SELECT id, endpoint, count(*) OVER (PARTITION BY endpoint ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS last_hour, count(*) OVER (PARTITION BY endpoint ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS last_day FROM (SELECT *, CAST(floor(epoch(occurred_at)) AS BIGINT) AS s FROM usage_records)")
def rolling_rate(m):
    return usage.rolling_counts(m.usage_records, "endpoint", {"last_hour": 3600, "last_day": 86400}).select("id", "endpoint", "last_hour", "last_day")


@query("stalest_sources", "SELECT id, last_success_s FROM sources ORDER BY last_success_s ASC NULLS FIRST, id LIMIT 20")
def stalest_sources(m):
    return m.sources.select("id", "last_success_s").orderBy(F.col("last_success_s").asc_nulls_first(), "id").limit(20)


@query("month_over_month", "SELECT month, releases, releases - lag(releases) OVER (ORDER BY month) AS change FROM (SELECT CAST(date_trunc('month', first_observed_on) AS DATE) AS month, count(*) AS releases FROM releases GROUP BY 1)")
def month_over_month(m):
    by = m.releases.groupBy(F.trunc("first_observed_on", "month").alias("month")).agg(F.count("*").alias("releases"))
    # one row per month: the window without partitions sees only those
    return by.withColumn("change", F.col("releases") - F.lag("releases").over(Window.orderBy("month")))


@query("popularity_rank", "SELECT product_id, views, rank() OVER (ORDER BY views DESC) AS place, ntile(10) OVER (ORDER BY views DESC, product_id) AS decile FROM (SELECT k AS product_id, count(*) AS views FROM analytics WHERE event_name = 'ProductViewed' GROUP BY k)")
def popularity_rank(m):
    by = m.analytics.where("event_name = 'ProductViewed'").groupBy(F.col("k").alias("product_id")).agg(F.count("*").alias("views"))
    return metrics.ranked(by, "product_id", "views", 10).select("product_id", "views", "place", "decile")


@query("newest_open_conflict", f"WITH {VERDICTS} SELECT product_id, max(channel) AS channel, count(DISTINCT channel) AS open_conflicts FROM verdicts WHERE status = 'unresolved' GROUP BY product_id")
def newest_open_conflict(m):
    found = conflicts.open_conflicts(conflicts.detect_conflicts(m.observations, m.sources))
    return found.groupBy("product_id").agg(F.max_by("channel", "channel").alias("channel"), F.count("*").alias("open_conflicts"))


@query("detect_conflicts", f"WITH {VERDICTS} SELECT product_id, channel, source_id, version, conflicting_versions, outranked_versions, authority_rank, status FROM verdicts")
def detect_conflicts(m):
    v = conflicts.detect_conflicts(m.observations, m.sources)
    return v.select("product_id", "channel", "source_id", "version", F.array_join("conflicting_versions", ",").alias("conflicting_versions"), F.array_join("outranked_versions", ",").alias("outranked_versions"), "authority_rank", "status")


@query("open_conflicts", f"WITH {VERDICTS} SELECT product_id, channel, count(DISTINCT version) AS versions, count(DISTINCT source_id) AS sources FROM (SELECT product_id, channel, version, source_id FROM verdicts WHERE status = 'unresolved' UNION ALL SELECT p.product_id, p.channel, other_version, other_source FROM pairs p WHERE other_rank >= rank) GROUP BY product_id, channel ORDER BY product_id DESC, channel LIMIT 500")
def open_conflicts(m):
    found = conflicts.open_conflicts(conflicts.detect_conflicts(m.observations, m.sources))
    out = found.select("product_id", "channel", F.size("versions").cast("long").alias("versions"), F.size("source_ids").cast("long").alias("sources"))
    return out.orderBy(F.desc("product_id"), "channel").limit(500)


@query("reconcile_conflicts", f"WITH {VERDICTS}, per AS (SELECT product_id, channel, bool_or(status = 'unresolved') AS hot, bool_or(status = 'outranked') AS ranked FROM verdicts GROUP BY 1, 2), stored AS (SELECT DISTINCT product_id, channel FROM observations WHERE product_id % 3 = 0) SELECT coalesce(s.product_id, p.product_id) AS product_id, coalesce(s.channel, p.channel) AS channel, CASE WHEN coalesce(hot, false) AND s.product_id IS NOT NULL THEN 'refresh' WHEN coalesce(hot, false) THEN 'open' WHEN s.product_id IS NOT NULL AND hot IS NOT NULL THEN 'close' ELSE 'keep' END AS action, CASE WHEN s.product_id IS NOT NULL AND NOT hot THEN CASE WHEN ranked THEN 'resolved by source authority' ELSE 'sources agree' END END AS resolution FROM per p FULL OUTER JOIN stored s ON p.product_id = s.product_id AND p.channel = s.channel")
def reconcile_conflicts(m):
    stored = m.observations.where("product_id % 3 = 0").select("product_id", "channel").distinct()
    return conflicts.reconcile(stored, conflicts.detect_conflicts(m.observations, m.sources))
