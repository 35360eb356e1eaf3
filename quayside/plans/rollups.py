"""Queries on aggregations, top lists, metrics and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts, metrics, usage
from .registry import query
from .windows import LIVE

DAY = "CAST(occurred_at AS DATE)"


@query("usage_rollup", f"SELECT consumer_id, grain, CASE grain WHEN 'day' THEN {DAY} ELSE CAST(date_trunc('month', occurred_at) AS DATE) END AS period, count(*) AS requests, count(CASE WHEN status_code >= 400 THEN 1 END) AS errors, count(CASE WHEN status_code = 429 THEN 1 END) AS rate_limited, sum(bytes_out) AS bytes_out, count(CASE WHEN status_code <> 429 THEN 1 END) AS quota_units FROM usage_records, (VALUES ('day'), ('month')) g(grain) GROUP BY 1, 2, 3")
def usage_rollup(m):
    return usage.rollup(m.usage_records)


@query("quota_status", "SELECT c.id, coalesce(u.used, 0) AS used, coalesce(u.used, 0) < monthly_quota AS allowed, greatest(monthly_quota - coalesce(u.used, 0), 0) AS remaining FROM consumers c LEFT JOIN (SELECT consumer_id, count(*) AS used FROM usage_records WHERE status_code <> 429 AND date_trunc('month', occurred_at) = DATE '2024-01-01' GROUP BY 1) u ON u.consumer_id = c.id")
def quota_status(m):
    return usage.quota_status(m.usage_records, m.consumers, "2024-01-01")


@query("search_query_rollup", f"SELECT {DAY} AS day, k % 10 AS term, count(*) AS searches, count(CASE WHEN result_count = 0 THEN 1 END) AS zero_results, round(avg(latency_ms), 4) AS avg_latency FROM analytics WHERE event_name = 'SearchExecuted' GROUP BY 1, 2")
def search_query_rollup(m):
    rows = m.analytics.where("event_name = 'SearchExecuted'").groupBy(F.to_date("occurred_at").alias("day"), (F.col("k") % 10).alias("term"))
    return rows.agg(F.count("*").alias("searches"), F.count_if(F.col("result_count") == 0).alias("zero_results"), F.round(F.avg("latency_ms"), 4).alias("avg_latency"))


@query("product_view_rollup", f"SELECT {DAY} AS day, k AS product_id, count(*) AS views FROM analytics WHERE event_name = 'ProductViewed' GROUP BY 1, 2")
def product_view_rollup(m):
    return metrics.per_day(m.analytics.where("event_name = 'ProductViewed'"), F.col("k").alias("product_id"), name="views")


@query("vendor_view_rollup", f"SELECT {DAY} AS day, vendor_id, count(*) AS views FROM analytics a JOIN products p ON p.id = a.k WHERE event_name = 'ProductViewed' GROUP BY 1, 2")
def vendor_view_rollup(m):
    rows = m.analytics.where("event_name = 'ProductViewed'").join(m.products.select(F.col("id").alias("k"), "vendor_id"), "k")
    return metrics.per_day(rows, F.col("vendor_id"), name="views")


@query("api_usage_rollup", f"SELECT {DAY} AS day, plan, endpoint, count(*) AS requests, count(CASE WHEN status_code = 429 THEN 1 END) AS quota_exceeded FROM usage_records u JOIN consumers c ON c.id = u.consumer_id GROUP BY 1, 2, 3")
def api_usage_rollup(m):
    return metrics.api_usage(m.usage_records, m.consumers).groupBy("day", "plan", "endpoint").agg(F.count("*").alias("requests"), F.count_if(F.col("status_code") == 429).alias("quota_exceeded"))


@query("api_usage_cube", f"SELECT day, plan, endpoint, count(*) AS requests, grouping(plan) * 2 + grouping(endpoint) AS level FROM (SELECT {DAY} AS day, plan, endpoint FROM usage_records u JOIN consumers c ON c.id = u.consumer_id) GROUP BY GROUPING SETS ((day, plan, endpoint), (day, plan), (day, endpoint), (day))")
def api_usage_cube(m):
    rows = metrics.api_usage(m.usage_records, m.consumers)
    sets = [[F.col("day"), F.col("plan"), F.col("endpoint")], [F.col("day"), F.col("plan")], [F.col("day"), F.col("endpoint")], [F.col("day")]]
    return rows.groupingSets(sets, "day", "plan", "endpoint").agg(F.count("*").alias("requests"), (F.grouping("plan") * 2 + F.grouping("endpoint")).cast("long").alias("level"))


@query("zero_result_rate", f"SELECT {DAY} AS day, round(count(CASE WHEN result_count = 0 THEN 1 END) / count(*), 6) AS rate FROM analytics WHERE event_name = 'SearchExecuted' GROUP BY 1")
def zero_result_rate(m):
    rows = m.analytics.where("event_name = 'SearchExecuted'").groupBy(F.to_date("occurred_at").alias("day"))
    return rows.agg(F.round(F.try_divide(F.count_if(F.col("result_count") == 0), F.count("*")), 6).alias("rate"))


@query("search_to_view_conversion", "SELECT round(count(CASE WHEN event_name = 'ProductViewed' THEN 1 END) / count(CASE WHEN event_name = 'SearchExecuted' THEN 1 END), 6) AS conversion FROM analytics WHERE occurred_at >= TIMESTAMP '2024-01-24'")
def search_to_view_conversion(m):
    rows = m.analytics.where("occurred_at >= timestamp'2024-01-24'")
    return rows.agg(F.round(F.try_divide(F.count_if(F.col("event_name") == "ProductViewed"), F.count_if(F.col("event_name") == "SearchExecuted")), 6).alias("conversion"))


@query("source_health_counts", "SELECT health, count(*) AS sources FROM sources GROUP BY health")
def source_health_counts(m):
    return m.sources.groupBy("health").agg(F.count("*").alias("sources"))


@query("platform_totals", "SELECT (SELECT count(*) FROM vendors) AS vendors, (SELECT count(*) FROM products) AS products, (SELECT count(*) FROM sources WHERE health = 'active') AS active_sources, (SELECT count(*) FROM releases WHERE NOT withdrawn) AS live_releases")
def platform_totals(m):
    one = lambda df, name: df.agg(F.count("*").alias(name))  # noqa: E731  each is one row
    return one(m.vendors, "vendors").crossJoin(one(m.products, "products")).crossJoin(one(m.sources.where("health = 'active'"), "active_sources")).crossJoin(one(m.releases.where("not withdrawn"), "live_releases"))


@query("active_consumers", "SELECT count(DISTINCT consumer_id) AS active FROM usage_records WHERE occurred_at >= TIMESTAMP '2024-01-30'")
def active_consumers(m):
    return m.usage_records.where("occurred_at >= timestamp'2024-01-30'").agg(F.countDistinct("consumer_id").alias("active"))


@query("checks_by_outcome", "SELECT source_id, outcome, count(*) AS checks, round(count(*) / sum(count(*)) OVER (PARTITION BY source_id), 6) AS share FROM checks GROUP BY source_id, outcome")
def checks_by_outcome(m):
    return metrics.shares(m.checks, "source_id", "outcome", "checks")


@query("duplicates_by_vendor", f"SELECT vendor_id, count(*) AS duplicates FROM (SELECT *, count(*) OVER (PARTITION BY product_id, version, channel) AS n FROM ({LIVE})) WHERE n > 1 GROUP BY vendor_id")
def duplicates_by_vendor(m):
    from ..operators import latest

    rows = latest.mapped(m.releases.where("not withdrawn"), m.mappings)
    per = rows.groupBy("product_id", "version", "channel", "vendor_id").agg(F.count("*").alias("n"))
    total = rows.groupBy("product_id", "version", "channel").agg(F.count("*").alias("all"))
    return per.join(total, ["product_id", "version", "channel"]).where(F.col("all") > 1).groupBy("vendor_id").agg(F.sum("n").alias("duplicates"))


@query("extraction_failures_by_reason", "SELECT outcome AS reason, count(*) AS failures FROM checks WHERE outcome IN ('unavailable', 'rate_limited') GROUP BY outcome")
def extraction_failures_by_reason(m):
    return m.checks.where(F.col("outcome").isin("unavailable", "rate_limited")).groupBy(F.col("outcome").alias("reason")).agg(F.count("*").alias("failures"))


RUNS = "(SELECT l_orderkey AS id, CASE l_linenumber % 3 WHEN 0 THEN 'extractor' WHEN 1 THEN 'reviewer' ELSE 'mapper' END AS agent, l_returnflag AS model, l_suppkey AS vendor_id, CAST(l_extendedprice / 100000 AS DECIMAL(10,6)) AS cost, CAST(l_quantity AS BIGINT) * 100 AS tokens, l_linestatus = 'F' AS ok FROM lineitem)"


def _ai_runs(m):
    return m.lineitem.select(
        F.col("l_orderkey").alias("id"), F.element_at(F.array(F.lit("extractor"), F.lit("reviewer"), F.lit("mapper")), F.col("l_linenumber") % 3 + 1).alias("agent"), F.col("l_returnflag").alias("model"),
        F.col("l_suppkey").alias("vendor_id"), (F.col("l_extendedprice") / 100000).cast("decimal(10,6)").alias("cost"), (F.col("l_quantity").cast("long") * 100).alias("tokens"), (F.col("l_linestatus") == "F").alias("ok"),
    )


@query("ai_cost_rollup", f"SELECT agent, model, count(*) AS runs, round(CAST(sum(cost) AS DOUBLE), 3) AS cost, sum(tokens) AS tokens, round(count(CASE WHEN ok THEN 1 END) / count(*), 6) AS success FROM {RUNS} GROUP BY 1, 2")
def ai_cost_rollup(m):
    rows = metrics.cost_rollup(_ai_runs(m), ["agent", "model"])
    return rows.select("agent", "model", "runs", F.round(F.col("cost").cast("double"), 3).alias("cost"), "tokens", F.round("success", 6).alias("success"))


@query("unit_cost_rollup", "SELECT vendor_id, round(checks * 0.00012 + releases * 0.004, 6) AS cost FROM (SELECT v.id AS vendor_id, (SELECT count(*) FROM checks c WHERE c.source_id = v.id) AS checks, (SELECT count(*) FROM releases r WHERE r.vendor_id = v.id) AS releases FROM vendors v)")
def unit_cost_rollup(m):
    volumes = m.checks.select(F.col("source_id").alias("vendor_id"), F.lit("check").alias("unit")).union(m.releases.select("vendor_id", F.lit("release").alias("unit")))
    cost = metrics.unit_costs(volumes, "vendor_id", {"check": 0.00012, "release": 0.004})
    return m.vendors.select(F.col("id").alias("vendor_id")).join(cost, "vendor_id", "left").select("vendor_id", F.round(F.coalesce("cost", F.lit(0.0)), 6).alias("cost"))


@query("ai_savings", f"SELECT agent, round(CAST(count(*) AS DOUBLE) * 0.9 - CAST(sum(cost) AS DOUBLE), 3) AS saved FROM {RUNS} GROUP BY agent")
def ai_savings(m):
    rows = metrics.cost_rollup(_ai_runs(m), ["agent"])
    return rows.select("agent", F.round(F.col("runs") * 0.9 - F.col("cost").cast("double"), 3).alias("saved"))


@query("checks_per_release", "SELECT source_id, count(*) AS changes, round(max(n) / count(*), 6) AS checks_per_release FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at, id) AS n FROM checks) WHERE outcome = 'changed' GROUP BY source_id")
def checks_per_release(m):
    return metrics.checks_per_change(m.checks).select("source_id", "changes", F.round("checks_per_release", 6).alias("checks_per_release"))


@query("evidence_lag", "SELECT vendor_id, quantile_disc(lag, 0.5) AS median_lag, max(lag) AS longest FROM (SELECT vendor_id, CAST(last_verified_on - release_date AS INT) AS lag FROM releases WHERE release_date_precision = 'exact_day') GROUP BY vendor_id")
def evidence_lag(m):
    rows = m.releases.where("release_date_precision = 'exact_day'").withColumn("lag", F.datediff("last_verified_on", "release_date"))
    return rows.groupBy("vendor_id").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY lag)").cast("int").alias("median_lag"), F.max("lag").alias("longest"))


@query("mean_time_to_repair", "SELECT source_id, count(*) AS outages, round(avg(epoch(up) - epoch(down)), 3) AS mean_s FROM (SELECT source_id, min(started_at) AS down, max(next_ok) AS up FROM (SELECT *, sum(CASE WHEN outcome <> 'unavailable' THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY started_at, id ROWS UNBOUNDED PRECEDING) AS island, lead(started_at) OVER (PARTITION BY source_id ORDER BY started_at, id) AS next_ok FROM checks) WHERE outcome = 'unavailable' GROUP BY source_id, island HAVING max(next_ok) IS NOT NULL) GROUP BY source_id")
def mean_time_to_repair(m):
    return metrics.repair_times(m.checks).select("source_id", "outages", F.round("mean_s", 3).alias("mean_s"))


@query("key_activation_funnel", "SELECT plan, count(*) AS keys, count(CASE WHEN EXISTS (SELECT 1 FROM usage_records u WHERE u.consumer_id = c.id) THEN 1 END) AS activated FROM consumers c GROUP BY plan")
def key_activation_funnel(m):
    used = m.usage_records.select(F.col("consumer_id").alias("id"), F.lit(1).alias("used")).distinct()
    return m.consumers.join(used, "id", "left").groupBy("plan").agg(F.count("*").alias("keys"), F.count("used").alias("activated"))


@query("vendor_product_counts", "SELECT v.id, count(p.id) AS products FROM vendors v LEFT JOIN products p ON p.vendor_id = v.id GROUP BY v.id")
def vendor_product_counts(m):
    per = m.products.groupBy(F.col("vendor_id").alias("id")).agg(F.count("*").alias("products"))
    return m.vendors.select("id").join(per, "id", "left").fillna(0, ["products"])


@query("correction_density", "SELECT m.product_id, r.release_type, count(*) AS corrections FROM releases r JOIN mappings m ON m.release_id = r.id WHERE r.withdrawn GROUP BY 1, 2")
def correction_density(m):
    from ..operators import latest

    return latest.mapped(m.releases.where("withdrawn"), m.mappings).groupBy("product_id", "release_type").agg(F.count("*").alias("corrections"))


@query("withdrawal_rate", "SELECT vendor_id, round(count(CASE WHEN withdrawn THEN 1 END) / count(*), 6) AS rate FROM releases GROUP BY vendor_id")
def withdrawal_rate(m):
    return m.releases.groupBy("vendor_id").agg(F.round(F.count_if("withdrawn") / F.count("*"), 6).alias("rate"))


@query("confidence_distribution", "SELECT source_id, CAST(floor(confidence * 20) AS BIGINT) AS bucket, count(*) AS candidates FROM candidates GROUP BY 1, 2")
def confidence_distribution(m):
    return m.candidates.groupBy("source_id", F.floor(F.col("confidence") * 20).cast("long").alias("bucket")).agg(F.count("*").alias("candidates"))


@query("artifact_dedupe_ratio", "SELECT count(*) AS refs, count(DISTINCT sha256(body)) AS hashes, CAST(sum(strlen(body)) AS BIGINT) - (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT min(strlen(body)) AS n FROM artifacts GROUP BY sha256(body))) AS bytes_saved FROM artifacts")
def artifact_dedupe_ratio(m):
    stored = _stored(m)
    return stored.agg(F.sum("reference_count").alias("refs"), F.count("*").alias("hashes"), F.sum((F.col("reference_count") - 1) * F.col("bytes")).alias("bytes_saved"))


def _stored(m):
    from ..sources.artifacts import store

    return store(m.artifacts)


@query("top_queries", "SELECT k AS term, count(*) AS searches FROM analytics WHERE event_name = 'SearchExecuted' GROUP BY k ORDER BY 2 DESC, 1 LIMIT 20")
def top_queries(m):
    return metrics.top(m.analytics.where("event_name = 'SearchExecuted'"), F.col("k").alias("term"), "searches", 20)


@query("top_products", "SELECT k AS product_id, count(*) AS views FROM analytics WHERE event_name = 'ProductViewed' GROUP BY k ORDER BY 2 DESC, 1 LIMIT 20")
def top_products(m):
    return metrics.top(m.analytics.where("event_name = 'ProductViewed'"), F.col("k").alias("product_id"), "views", 20)


@query("top_vendors", "SELECT vendor_id, count(*) AS views FROM analytics a JOIN products p ON p.id = a.k WHERE event_name = 'ProductViewed' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_vendors(m):
    rows = m.analytics.where("event_name = 'ProductViewed'").join(m.products.select(F.col("id").alias("k"), "vendor_id"), "k")
    return metrics.top(rows, F.col("vendor_id"), "views", 20)


@query("zero_result_top", "SELECT k AS term, count(*) AS searches FROM analytics WHERE event_name = 'SearchExecuted' AND result_count = 0 GROUP BY k ORDER BY 2 DESC, 1 LIMIT 20")
def zero_result_top(m):
    return metrics.top(m.analytics.where("event_name = 'SearchExecuted' and result_count = 0"), F.col("k").alias("term"), "searches", 20)


@query("top_api_keys", "SELECT consumer_id, count(*) AS requests FROM usage_records WHERE occurred_at >= TIMESTAMP '2024-01-30 23:00:00' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_api_keys(m):
    return metrics.top(m.usage_records.where("occurred_at >= timestamp'2024-01-30 23:00:00'"), F.col("consumer_id"), "requests", 20)


@query("recently_broken", "SELECT id, last_success_s FROM sources WHERE health = 'broken' ORDER BY last_success_s DESC NULLS LAST, id LIMIT 20")
def recently_broken(m):
    return m.sources.where("health = 'broken'").select("id", "last_success_s").orderBy(F.col("last_success_s").desc_nulls_last(), "id").limit(20)


@query("event_validation", "SELECT event_name, count(*) AS events, count(CASE WHEN (event_name = 'SearchExecuted' AND k % 10 = 3) OR (event_name = 'ProductViewed' AND k > 95) THEN 1 END) AS rejected FROM analytics GROUP BY 1")
def event_validation(m):
    props = F.create_map(F.lit("product_id"), F.when(F.col("k") <= 95, F.col("k").cast("string")), F.lit("result_count"), F.when(F.col("k") % 10 != 3, F.col("result_count").cast("string")))
    rows = metrics.validated(m.analytics.withColumn("properties", props), {"SearchExecuted": ["result_count"], "ProductViewed": ["product_id"]})
    return rows.groupBy("event_name").agg(F.count("*").alias("events"), F.count_if(~F.col("valid")).alias("rejected"))


@query("privacy_filter", "SELECT doc_id AS id, left(lower(text), 48) AS q, doc_id % 64 AS session_bucket FROM documents")
def privacy_filter(m):
    props = F.create_map(F.lit("ip"), F.lit("10.0.0.1"), F.lit("query"), F.col("text"))
    rows = m.documents.select(F.col("doc_id").alias("id"), metrics.private(props).alias("p"), (F.col("doc_id") % 64).alias("session_bucket"))
    return rows.select("id", F.col("p")["query"].alias("q"), "session_bucket")


@query("latency_quantiles", "SELECT endpoint, round(quantile_cont(duration_ms, 0.5), 6) AS p50, round(quantile_cont(duration_ms, 0.95), 6) AS p95, round(quantile_cont(duration_ms, 0.99), 6) AS p99 FROM usage_records GROUP BY endpoint")
def latency_quantiles(m):
    return metrics.quantiles(m.usage_records, ["endpoint"], "duration_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("duration_by_stage", "SELECT outcome, round(quantile_cont(duration_ms, 0.95), 6) AS p95 FROM checks GROUP BY outcome")
def duration_by_stage(m):
    return metrics.quantiles(m.checks, ["outcome"], "duration_ms", {"p95": 0.95})


BUCKETS = [1, 5, 10, 25, 50, 100, 250, 500]


@query("histogram_quantile", "WITH b AS (SELECT endpoint, CAST(le AS DOUBLE) AS le, count(CASE WHEN duration_ms <= le THEN 1 END) AS c, count(*) AS total FROM usage_records, (VALUES (1), (5), (10), (25), (50), (100), (250), (500)) v(le) GROUP BY 1, 2), x AS (SELECT *, lag(le, 1, 0.0) OVER w AS below, lag(c, 1, 0) OVER w AS before FROM b WINDOW w AS (PARTITION BY endpoint ORDER BY le)) SELECT endpoint, round(min_by(below + (le - below) * (0.9 * total - before) / (c - before), le), 6) AS q FROM x WHERE c >= 0.9 * total GROUP BY endpoint")
def histogram_quantile(m):
    counts = metrics.cumulative(m.usage_records, "endpoint", "duration_ms", BUCKETS)
    return metrics.histogram_quantile(counts, "endpoint", 0.9).select("endpoint", F.round("q", 6).alias("q"))


@query("payload_histogram", f"SELECT {DAY} AS day, CASE WHEN bytes_out < 1000 THEN 'small' WHEN bytes_out < 8000 THEN 'medium' ELSE 'large' END AS size, count(*) AS responses FROM usage_records GROUP BY 1, 2")
def payload_histogram(m):
    size = F.when(F.col("bytes_out") < 1000, "small").when(F.col("bytes_out") < 8000, "medium").otherwise("large")
    return metrics.per_day(m.usage_records, size.alias("size"), name="responses")


WINDOW5 = "time_bucket(INTERVAL '5 minutes', occurred_at)"


@query("request_rate", f"SELECT {WINDOW5} AS at, endpoint, count(*) / 300.0 AS rate FROM usage_records GROUP BY 1, 2")
def request_rate(m):
    return metrics.windowed(m.usage_records, "5 minutes", "endpoint").agg((F.count("*") / 300).alias("rate")).select(F.col("window.start").alias("at"), "endpoint", "rate")


@query("status_rate", f"SELECT {WINDOW5} AS at, status_code, count(*) AS n FROM usage_records GROUP BY 1, 2")
def status_rate(m):
    return metrics.windowed(m.usage_records, "5 minutes", "status_code").agg(F.count("*").alias("n")).select(F.col("window.start").alias("at"), "status_code", "n")


@query("error_ratio", f"SELECT {WINDOW5} AS at, round(count(CASE WHEN status_code >= 500 THEN 1 END) / count(*), 6) AS ratio FROM usage_records GROUP BY 1")
def error_ratio(m):
    return metrics.windowed(m.usage_records, "5 minutes").agg(F.round(F.count_if(F.col("status_code") >= 500) / F.count("*"), 6).alias("ratio")).select(F.col("window.start").alias("at"), "ratio")


@query("cache_hit_ratio", f"SELECT {WINDOW5} AS at, round(count(CASE WHEN bytes_out % 3 = 0 THEN 1 END) / count(*), 6) AS ratio FROM usage_records GROUP BY 1")
def cache_hit_ratio(m):
    return metrics.windowed(m.usage_records, "5 minutes").agg(F.round(F.count_if(F.col("bytes_out") % 3 == 0) / F.count("*"), 6).alias("ratio")).select(F.col("window.start").alias("at"), "ratio")


@query("rate_limit_rate", f"SELECT {WINDOW5} AS at, count(*) AS limited FROM usage_records WHERE status_code = 429 GROUP BY 1")
def rate_limit_rate(m):
    return metrics.windowed(m.usage_records.where("status_code = 429"), "5 minutes").agg(F.count("*").alias("limited")).select(F.col("window.start").alias("at"), "limited")


@query("quota_violations", f"SELECT {DAY} AS day, plan, count(*) AS violations FROM usage_records u JOIN consumers c ON c.id = u.consumer_id WHERE status_code = 429 GROUP BY 1, 2")
def quota_violations(m):
    return metrics.api_usage(m.usage_records, m.consumers).where("status_code = 429").groupBy("day", "plan").agg(F.count("*").alias("violations"))


# metrics by hour that the tables have; queue, budget and pool, which they do not, are stood in for by sums of events
OF_API = {"api_error_ratio": "errors / requests", "queue_depth": "k * 4.0", "queue_oldest_message_s": "slowest * 4.0", "dead_letters_15m": "throttled * 1.0", "ai_budget_share": "k / 400.0", "db_pool_share": "slowest / 260.0"}
OF_VENDOR = {"collector_failure_ratio": "failed / checks", "collector_failures_15m": "failed * 1.0"}
RULE_ROWS = ", ".join(f"('{n}', '{m}', '{c}', {t}, {-(-s // 3600)}, '{v}')" for n, m, c, t, s, v, _ in alerts.RULES)


def _unpivot(source: str, series: str, metrics_of: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS metric, {series} AS series, h, CAST({e} AS DOUBLE) AS value FROM {source}" for n, e in metrics_of.items())


@query("alert_evaluation", f"""WITH api AS (SELECT endpoint, date_trunc('hour', occurred_at) AS h, count(*) AS requests, count(CASE WHEN status_code >= 500 THEN 1 END) AS errors, count(CASE WHEN status_code = 429 THEN 1 END) AS throttled, sum(k) AS k, max(duration_ms) AS slowest FROM usage_records GROUP BY ALL),
vend AS (SELECT v.slug, date_trunc('hour', started_at) AS h, count(*) AS checks, count(CASE WHEN outcome = 'unavailable' THEN 1 END) AS failed FROM checks c JOIN sources s ON s.id = c.source_id JOIN vendors v ON v.id = s.vendor_id GROUP BY ALL),
smp AS ({_unpivot("api", "endpoint", OF_API)} UNION ALL {_unpivot("vend", "slug", OF_VENDOR)}
 UNION ALL SELECT 'publications_while_checked', '', date_trunc('hour', occurred_at), CAST(count(CASE WHEN event_name = 'ReleasePublished' THEN 1 END) AS DOUBLE) FROM analytics GROUP BY ALL
 UNION ALL SELECT 'api_latency_p95_s', '', date_trunc('hour', occurred_at), round(quantile_cont(duration_ms, 0.95), 6) / 200 FROM usage_records GROUP BY ALL),
r(rule, metric, cmp, threshold, hold, severity) AS (VALUES {RULE_ROWS}), u AS (SELECT max(h) AS until FROM smp),
hot AS (SELECT rule, severity, hold, series, h FROM smp JOIN r USING (metric) WHERE CASE cmp WHEN '>' THEN value > threshold WHEN '>=' THEN value >= threshold ELSE value = threshold END),
isl AS (SELECT *, h - INTERVAL '1 hour' * row_number() OVER (PARTITION BY rule, series ORDER BY h) AS island FROM hot),
st AS (SELECT rule, severity, hold, series, min(h) AS since, max(h) AS last FROM isl GROUP BY rule, severity, hold, series, island)
SELECT rule, severity, series, since AS pending_at, CASE WHEN since + INTERVAL '1 hour' * hold <= last THEN since + INTERVAL '1 hour' * hold END AS firing_at, CASE WHEN last + INTERVAL '1 hour' <= until THEN last + INTERVAL '1 hour' END AS resolved_at FROM st, u""")
def alert_evaluation(m):
    hour = lambda c: F.date_trunc("hour", c).alias("at")
    count = lambda c: F.count_if(c)
    told = lambda of, series: F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(series).alias("series"), F.expr(e).cast("double").alias("value")) for n, e in of.items()])).alias("x")
    api = m.usage_records.groupBy("endpoint", hour("occurred_at")).agg(
        F.count("*").alias("requests"), count(F.col("status_code") >= 500).alias("errors"), count(F.col("status_code") == 429).alias("throttled"), F.sum("k").alias("k"), F.max("duration_ms").alias("slowest")
    )
    vendor = m.sources.select(F.col("id").alias("source_id"), "vendor_id").join(m.vendors.select(F.col("id").alias("vendor_id"), "slug"), "vendor_id")
    vend = m.checks.join(vendor, "source_id").groupBy("slug", hour("started_at")).agg(F.count("*").alias("checks"), count(F.col("outcome") == "unavailable").alias("failed"))
    published = m.analytics.groupBy(hour("occurred_at")).agg(count(F.col("event_name") == "ReleasePublished").cast("double").alias("value"))
    slow = metrics.quantiles(m.usage_records.withColumn("at", F.date_trunc("hour", "occurred_at")), ["at"], "duration_ms", {"p95": 0.95})
    cols = ["metric", "series", "at", "value"]
    samples = api.select("at", told(OF_API, "endpoint")).select("at", "x.*").select(*cols).union(vend.select("at", told(OF_VENDOR, "slug")).select("at", "x.*").select(*cols))
    samples = samples.union(published.select(F.lit("publications_while_checked"), F.lit(""), "at", "value")).union(slow.select(F.lit("api_latency_p95_s"), F.lit(""), "at", F.col("p95") / 200))
    return alerts.stretches(samples, alerts.rule_table(m.spark), 3600)


@query("counter_increase", "SELECT user_id AS source_id, round(sum(CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END), 4) AS increase FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) GROUP BY 1")
def counter_increase(m):
    return metrics.counter_increase(m.events, "user_id", ["ts", "event_id"], "value").select(F.col("user_id").alias("source_id"), F.round("increase", 4).alias("increase"))


@query("scraping_signals", "SELECT consumer_id, count(*) AS requests, round(count(CASE WHEN endpoint = '/v1/search' THEN 1 END) / count(*), 6) AS expensive_share, count(CASE WHEN status_code = 429 THEN 1 END) AS throttled FROM usage_records GROUP BY 1 HAVING count(CASE WHEN endpoint = '/v1/search' THEN 1 END) / count(*) > 0.2")
def scraping_signals(m):
    return metrics.scraping(m.usage_records, "/v1/search", 0.2)


SESSIONS = "s AS (SELECT *, sum(CASE WHEN prev IS NULL OR occurred_at - prev >= INTERVAL '30 minutes' THEN 1 ELSE 0 END) OVER (PARTITION BY session_bucket ORDER BY occurred_at, id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, lag(occurred_at) OVER (PARTITION BY session_bucket ORDER BY occurred_at, id) AS prev FROM analytics))"


@query("search_abandonment", f"WITH {SESSIONS} SELECT session_bucket, min(occurred_at) AS started_at, bool_or(event_name = 'SearchExecuted' AND result_count > 0) AND NOT bool_or(event_name = 'ProductViewed') AS abandoned FROM s GROUP BY session_bucket, session")
def search_abandonment(m):
    return metrics.sessions(m.analytics).select("session_bucket", "started_at", "abandoned")


@query("search_funnel", f"WITH {SESSIONS} SELECT count(*) AS sessions, count(CASE WHEN searched THEN 1 END) AS searched, count(CASE WHEN converted THEN 1 END) AS converted FROM (SELECT bool_or(event_name = 'SearchExecuted') AS searched, coalesce(min(CASE WHEN event_name = 'SearchExecuted' THEN occurred_at END) < max(CASE WHEN event_name = 'ProductViewed' THEN occurred_at END), false) AS converted FROM s GROUP BY session_bucket, session)")
def search_funnel(m):
    rows = metrics.sessions(m.analytics)
    return rows.agg(F.count("*").alias("sessions"), F.count_if("searched").alias("searched"), F.count_if("converted").alias("converted"))


@query("breakage_trend", "SELECT CAST(date_trunc('week', occurred_at) AS DATE) AS week, session_bucket AS vendor_id, count(*) AS broken FROM analytics WHERE event_name = 'SourceBroken' GROUP BY 1, 2")
def breakage_trend(m):
    rows = m.analytics.where("event_name = 'SourceBroken'")
    return rows.groupBy(F.to_date(F.date_trunc("week", "occurred_at")).alias("week"), F.col("session_bucket").alias("vendor_id")).agg(F.count("*").alias("broken"))


KINDS = " ".join(f"WHEN event_name IN ({', '.join(repr(n) for n in names)}) THEN '{kind}'" for kind, names in metrics.EVENTS.items())


@query("event_counts", f"SELECT {DAY} AS day, event_name, CASE {KINDS} ELSE 'unknown' END AS about, count(*) AS events, count(DISTINCT k) AS subjects FROM analytics GROUP BY 1, 2")
def event_counts(m):
    return metrics.event_counts(m.analytics, "k")
