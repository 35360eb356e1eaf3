"""Streams run to their end, against the batch form of the same question."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import checks
from ..streaming import ingest, jobs, stateful
from .bindings import VIEWS
from .registry import query
from .pipeline import HEALTH, OK
from .windows import CURRENT, ELIGIBLE, RANKS

BUCKET = (
    "reqs AS MATERIALIZED (SELECT id, consumer_id, epoch_us(occurred_at) / 1000000 AS t, row_number() OVER (PARTITION BY consumer_id ORDER BY occurred_at, id) AS n FROM usage_records), "
    "bucket(consumer_id, n, id, tokens, seen, allowed) AS (SELECT DISTINCT consumer_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(3 AS DOUBLE), CAST(NULL AS DOUBLE), false FROM reqs "
    "UNION ALL SELECT consumer_id, n, id, CASE WHEN now >= 1 THEN now - 1 ELSE now END, t, now >= 1 FROM (SELECT reqs.consumer_id, reqs.n, reqs.id, reqs.t, CASE WHEN seen IS NOT NULL AND t > seen THEN least(CAST(3 AS DOUBLE), tokens + (t - seen) * CAST(0.01 AS DOUBLE) / 60) ELSE tokens END AS now "
    "FROM bucket JOIN reqs ON reqs.consumer_id = bucket.consumer_id AND reqs.n = bucket.n + 1))"
)


def _stream(m, view: str, table: str):
    return m.spark.sql(VIEWS[view].replace(f"FROM {table}", "FROM {t}"), t=jobs.source(m.spark, f"{m.sf_dir}/{table}.parquet"))


@query("stream_usage_dedupe", "SELECT id, consumer_id, status_code FROM usage_records")
def stream_usage_dedupe(m):
    twice = _stream(m, "usage_records", "events").select("id", "consumer_id", "status_code", "occurred_at", F.explode(F.array(F.lit(1), F.lit(2))).alias("sent"))
    return jobs.drain(jobs.usage_dedupe(twice)).select("id", "consumer_id", "status_code")


@query("stream_usage_rollup", "SELECT consumer_id, grain, CASE grain WHEN 'day' THEN CAST(occurred_at AS DATE) ELSE CAST(date_trunc('month', occurred_at) AS DATE) END AS period, count(*) AS requests, count(CASE WHEN status_code >= 400 THEN 1 END) AS errors FROM usage_records, (VALUES ('day'), ('month')) g(grain) GROUP BY 1, 2, 3")
def stream_usage_rollup(m):
    return jobs.periods(jobs.drain(jobs.usage_rollup(_stream(m, "usage_records", "events")), "update", ["consumer_id", "day"]))


@query("stream_observations", f"WITH {CURRENT} SELECT source_id, product_id, channel, version, release_date, observed_on, first_observed_on FROM current")
def stream_observations(m):
    order = [F.col("release_date").isNotNull().alias("k"), F.col("release_date").alias("a"), F.col("observed_on").alias("b"), F.col("version").alias("c"), F.col("order_id").alias("e"), F.col("line_no").alias("f")]
    return jobs.drain(jobs.observations(_stream(m, "observations", "lineitem"), order), "update", ["source_id", "product_id", "channel"])


# claims come in three runs, each of which takes up the state of the one before
@query("stream_conflicts", f"""WITH st AS (SELECT unnest([0, 1, 2]) AS step), o AS (SELECT st.step, ob.* FROM observations ob JOIN sources s ON s.id = ob.source_id JOIN st ON ob.order_id % 3 <= st.step WHERE {ELIGIBLE}),
cur AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY step, source_id, product_id, channel ORDER BY release_date DESC NULLS LAST, observed_on DESC, version DESC, order_id DESC, line_no DESC) = 1),
d AS (SELECT step, product_id, channel, count(DISTINCT version) > 1 AS disputed, string_agg(DISTINCT version, ',' ORDER BY version) AS versions FROM cur GROUP BY ALL),
e AS (SELECT *, coalesce(lag(disputed) OVER (PARTITION BY product_id, channel ORDER BY step), false) AS was FROM d)
SELECT step, product_id, channel, CASE WHEN disputed THEN 'opened' ELSE 'resolved' END AS event, versions FROM e WHERE disputed <> was""")
def stream_conflicts(m):
    ok = m.sources.where(rules.source_eligible(F.col("enabled"), F.col("health"), F.col("robots"), F.col("terms"))).select(F.col("id").alias("source_id"))
    claims = m.observations.join(ok, "source_id", "left_semi")
    log = jobs.replay([claims.where(F.col("order_id") % 3 == k) for k in range(3)], stateful.conflict_events)
    return log.select("step", "product_id", "channel", "event", F.array_join("versions", ",").alias("versions"))


@query("stream_source_health", f"""WITH {HEALTH}, z AS (SELECT source_id, max(n) AS checks, max_by(failures, n) AS failures, max_by(health, n) AS health, max_by(outcome, n) AS outcome, max(n) - coalesce(max(CASE WHEN outcome <> 'unchanged' THEN n END), 0) AS unchanged, max_by(id, n) AS id, CAST(3600 * (1 + source_id % 24) AS DOUBLE) AS base FROM log JOIN walk USING (source_id, n) GROUP BY source_id),
j AS (SELECT z.*, epoch_us(started_at) // 1000000 AS now_s, CASE WHEN z.outcome IN ('unavailable', 'rate_limited') OR health = 'broken' THEN base * pow(2.0, least(greatest(failures, 1), 24)) WHEN z.outcome = 'changed' THEN 21600 WHEN unchanged > 0 THEN base * pow(1.35, least(unchanged, 24)) ELSE base END AS step FROM z JOIN checks c ON c.id = z.id)
SELECT source_id, checks, failures, health, CAST(floor(now_s + greatest(900, least(2592000, step)) * 1.05) AS BIGINT) AS next_s FROM j""")
def stream_source_health(m):
    state = jobs.drain(jobs.source_health(_stream(m, "checks", "events")), "update", ["source_id"]).withColumns({
        "base_s": 3600 * (1 + F.col("source_id") % 24), "retry_after_s": F.lit(0), "last_changed_s": F.lit(None).cast("long"), "end_of_life": F.lit(False), "security_critical": F.lit(False), "popular": F.lit(False),
    })
    return checks.next_check(state).select("source_id", "checks", "failures", "health", "next_s")


ALERTS = [("errors", "error_ratio", ">", 0.25, 7200, "page", False), ("busy", "requests", ">=", 8.0, 3600, "ticket", False), ("silent", "requests", "<", 2.0, 3600, "page", True)]


# the grid goes on from a series' first window to the watermark; a stretch is a run of breaches on it
@query("stream_alerts", """WITH w AS (SELECT endpoint AS series, status_code, unnest([time_bucket(INTERVAL '1 hour', occurred_at) + INTERVAL '1 hour', time_bucket(INTERVAL '1 hour', occurred_at) + INTERVAL '2 hours']) AS happened_at FROM usage_records),
mark AS (SELECT time_bucket(INTERVAL '1 hour', max(occurred_at) - INTERVAL '10 minutes') AS until FROM usage_records),
v AS (SELECT series, happened_at, count(*) AS requests, count(CASE WHEN status_code >= 500 THEN 1 END) / count(*) AS ratio FROM w WHERE happened_at <= (SELECT until FROM mark) GROUP BY ALL),
g AS (SELECT series, unnest(generate_series(first, (SELECT until FROM mark), INTERVAL '1 hour')) AS happened_at FROM (SELECT series, min(happened_at) AS first FROM v GROUP BY 1)),
b AS (SELECT 'errors' AS rule, 2 AS hold, series, happened_at FROM v WHERE ratio > 0.25 UNION ALL SELECT 'busy', 1, series, happened_at FROM v WHERE requests >= 8 UNION ALL SELECT 'silent', 1, series, happened_at FROM g LEFT JOIN v USING (series, happened_at) WHERE coalesce(requests, 0) < 2),
i AS (SELECT *, happened_at - INTERVAL '1 hour' * row_number() OVER (PARTITION BY rule, series ORDER BY happened_at) AS island FROM b),
s AS (SELECT rule, hold, series, min(happened_at) AS since, max(happened_at) AS last FROM i GROUP BY rule, hold, series, island)
SELECT rule, series, 'pending' AS event, since AS happened_at FROM s UNION ALL SELECT rule, series, 'firing', since + INTERVAL '1 hour' * hold FROM s WHERE since + INTERVAL '1 hour' * hold <= last
UNION ALL SELECT rule, series, CASE WHEN since + INTERVAL '1 hour' * hold <= last THEN 'resolved' ELSE 'cleared' END, last + INTERVAL '1 hour' FROM s WHERE last + INTERVAL '1 hour' <= (SELECT until FROM mark)""")
def stream_alerts(m):
    samples = jobs.traffic(_stream(m, "usage_records", "events"))
    return jobs.drain(stateful.alert_events(samples, ALERTS, 3600)).withColumnRenamed("at", "happened_at")


# a session comes out when the watermark, half an hour behind the last event, has passed its end
@query("stream_sessions", """WITH e AS (SELECT *, CASE WHEN occurred_at <= lag(occurred_at) OVER (PARTITION BY session_bucket ORDER BY occurred_at, id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM analytics), k AS (SELECT *, sum(starts) OVER (PARTITION BY session_bucket ORDER BY occurred_at, id) AS nth FROM e)
SELECT session_bucket, min(occurred_at) AS started_at, count(*) AS events, bool_or(event_name = 'SearchExecuted' AND result_count > 0) AND NOT bool_or(event_name = 'ProductViewed') AS abandoned FROM k GROUP BY session_bucket, nth HAVING max(occurred_at) + INTERVAL 30 MINUTE <= (SELECT max(occurred_at) - INTERVAL 30 MINUTE FROM analytics)""")
def stream_sessions(m):
    return jobs.drain(jobs.sessions(_stream(m, "analytics", "events")))


# a search without a view comes out when no view in time can follow any more
@query("stream_search_view_join", """WITH s AS (SELECT * FROM analytics WHERE event_name = 'SearchExecuted'), v AS (SELECT * FROM analytics WHERE event_name = 'ProductViewed'), mark AS (SELECT least((SELECT max(occurred_at) FROM s), (SELECT max(occurred_at) FROM v)) - INTERVAL 1 HOUR AS mark_at)
SELECT s.id AS search_id, v.id AS view_id, s.occurred_at AS searched_at, v.occurred_at AS viewed_at FROM s LEFT JOIN v ON v.session_bucket = s.session_bucket AND v.occurred_at > s.occurred_at AND v.occurred_at <= s.occurred_at + INTERVAL 1 HOUR WHERE v.id IS NOT NULL OR s.occurred_at + INTERVAL 1 HOUR < (SELECT mark_at FROM mark)""")
def stream_search_view_join(m):
    return jobs.drain(jobs.search_views(_stream(m, "analytics", "events")))


@query("stream_token_bucket", f"WITH {BUCKET} SELECT consumer_id, count(CASE WHEN allowed THEN 1 END) AS allowed, count(CASE WHEN NOT allowed THEN 1 END) AS denied FROM bucket WHERE n > 0 GROUP BY consumer_id")
def stream_token_bucket(m):
    return jobs.drain(jobs.token_buckets(_stream(m, "usage_records", "events")), "update", ["consumer_id"])


@query("throttle_audit", f"WITH {BUCKET} SELECT id, consumer_id, allowed FROM bucket WHERE n > 0")
def throttle_audit(m):
    return jobs.throttle_audit(m.usage_records)


WORDS = {"engine": "text_regex", "container": "(?P<version>[A-Z][a-z]{9,})[ .,]", "channel": "text", "fields": {"version": {"transforms": ["lowercase", ["regex_extract", "^[a-z]"], ["map", {chr(97 + k): f"7.{k % 9}" for k in range(26)}]]}}}
ARTIFACT = "doc_id * 7 % 100 * 1000000 + doc_id"


# a candidate's gates see the candidates before it, of earlier batches and of its own
@query("stream_extract_validate", rf"""WITH src AS (SELECT id AS source_id, {RANKS} AS rank, official AND quality_class = 'official_manufacturer' AS official, {OK} AS able FROM sources),
art AS (SELECT {ARTIFACT} AS id, doc_id % (SELECT count(*) FROM supplier) AS source_id, text FROM documents),
c AS (SELECT id, source_id, generate_subscripts(w, 1) - 1 AS container, '7.' || ((ascii(lower(unnest(w))) - 97) % 9) AS version FROM (SELECT id, source_id, regexp_extract_all(text, '([A-Z][a-z]{{9,}})[ .,]', 1)[1:500] AS w FROM art)),
r AS (SELECT c.*, src.rank, src.official, src.able, source_id % 40 AS subject FROM c JOIN src USING (source_id)),
n AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY id, container) AS n, first_value(id) OVER (PARTITION BY subject, version ORDER BY id, container) AS first_id, row_number() OVER (PARTITION BY subject, version ORDER BY id, container) AS again FROM r),
p AS (SELECT *, max(CASE WHEN again = 1 THEN n END) OVER (PARTITION BY subject ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_n FROM n),
o AS (SELECT a.id, a.container, b.source_id, max_by(b.version, b.n) AS version, any_value(b.rank) AS rank FROM n a JOIN n b ON b.subject = a.subject AND b.source_id <> a.source_id AND b.able AND b.n < a.n GROUP BY ALL),
k AS (SELECT p.id, p.container, count(CASE WHEN o.rank >= p.rank AND o.version <> p.version THEN 1 END) > 0 AS disputed FROM p LEFT JOIN o ON o.id = p.id AND o.container = p.container GROUP BY ALL),
g AS (SELECT p.*, disputed, q.version AS previous FROM p JOIN k ON k.id = p.id AND k.container = p.container LEFT JOIN n q ON q.subject = p.subject AND q.n = p.prev_n),
v AS (SELECT *, CASE WHEN NOT able THEN 'rejected' WHEN again > 1 THEN 'rejected' WHEN NOT official OR disputed THEN 'review_required' ELSE 'passed' END AS decision FROM g)
SELECT id, container, subject AS product_id, version, CASE WHEN again > 1 THEN first_id END AS duplicate_id, previous, disputed, decision, decision = 'passed' AS released FROM v""")
def stream_extract_validate(m):
    n = m.supplier.count()
    pages = m.documents.select(F.expr(ARTIFACT).alias("id"), F.lit("words").alias("collector_id"), (F.col("doc_id") % n).alias("source_id"), F.col("text").alias("body"))
    configs = m.spark.createDataFrame([("words", json.dumps(WORDS))], "collector_id string, spec string")
    sources = m.sources.withColumn("product_id", F.col("id") % 40)
    steps = [pages.where(F.col("id").between(*span)) for span in ((0, 29_999_999), (30_000_000, 69_999_999), (70_000_000, 99_999_999))]
    folder = ingest.ingest(steps, configs, sources, m.products, F.lit("2024-01-01").cast("date"))
    verdicts, releases = m.spark.read.parquet(f"{folder}/verdicts/number=*"), m.spark.read.parquet(f"{folder}/releases/number=*")
    out = verdicts.join(releases.select("id", "container", F.lit(True).alias("released")), ["id", "container"], "left")
    return out.select(
        "id", "container", F.col("subject_id").alias("product_id"), "version", F.col("duplicate_id").cast("long").alias("duplicate_id"), "previous",
        (F.size("conflicting") > 0).alias("disputed"), "decision", F.coalesce("released", F.lit(False)).alias("released"),
    )


@query("late_data_report", "WITH e AS (SELECT id, occurred_at, occurred_at + INTERVAL '1 hour' * CASE WHEN id % 10 = 0 THEN 30 ELSE 0 END AS arrived FROM usage_records), h AS (SELECT date_trunc('hour', arrived) AS h, max(occurred_at) AS top FROM e GROUP BY 1), b AS (SELECT h, max(top) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL '1 day' AS mark FROM h) SELECT id FROM e JOIN b ON b.h = date_trunc('hour', arrived) WHERE occurred_at < mark")
def late_data_report(m):
    rows = m.usage_records.select("id", "occurred_at", F.expr("occurred_at + make_interval(0, 0, 0, 0, CASE WHEN id % 10 = 0 THEN 30 ELSE 0 END, 0, 0)").alias("arrived"))
    return jobs.late_data(rows, "arrived", "occurred_at", "1 day").select("id")
