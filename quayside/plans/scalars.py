"""Queries on scalar functions (versions, dates, text, display) and simple filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, rules, text, versions
from .registry import query
from .windows import ELIGIBLE, RANKS

PERIOD_END = "CASE release_date_precision WHEN 'exact_day' THEN release_date WHEN 'month_only' THEN last_day(release_date) WHEN 'year_only' THEN make_date(year(release_date), 12, 31) END"


@query("normalize_version", "SELECT id, line_no, lower(trim(raw_version)) AS normalized FROM candidates")
def normalize_version(m):
    return m.candidates.select("id", "line_no", versions.normalize_version(F.col("raw_version")).alias("normalized"))


@query("version_tokens", r"SELECT id, array_to_string(regexp_extract_all(version, '[0-9]+|[a-z]+'), ' ') AS tokens FROM releases")
def version_tokens(m):
    return m.releases.select("id", F.array_join(versions.version_tokens(F.col("version")), " ").alias("tokens"))


@query("version_skeleton", "SELECT id, regexp_replace(replace(version, '.', ''), '[0-9]+', '#', 'g') AS part, regexp_replace(regexp_replace(version, '[0-9]+', '#', 'g'), '[^#a-z]', '', 'g') AS skeleton FROM releases")
def version_skeleton(m):
    return m.releases.select("id", F.regexp_replace(F.regexp_replace("version", r"\.", ""), "[0-9]+", "#").alias("part"), versions.version_skeleton(F.col("version")).alias("skeleton"))


@query("slugify", r"SELECT id, regexp_replace(regexp_replace(regexp_replace(lower(alias), '[^a-z0-9\s\-_./+]', '', 'g'), '[\s\-_./+]+', '-', 'g'), '^-|-$', '', 'g') AS slug, true AS valid FROM (SELECT product_id AS id, alias || ' (Rev. #' || product_id || '/A)' AS alias FROM aliases)")
def slugify(m):
    made = versions.slugify(F.concat("alias", F.lit(" (Rev. #"), "product_id", F.lit("/A)")))
    return m.aliases.select(F.col("product_id").alias("id"), made.alias("slug"), versions.valid_slug(made).alias("valid"))


@query("normalize_alias", r"SELECT product_id, alias_kind, trim(regexp_replace(lower(alias), '[^\p{L}\p{Nd}]+', ' ', 'g')) AS normalized FROM aliases")
def normalize_alias(m):
    return m.aliases.select("product_id", "alias_kind", versions.normalize_alias(F.col("alias")).alias("normalized"))


@query("dedupe_key", "SELECT id, left(sha256(lower(trim(hint)) || chr(31) || lower(trim(raw_version)) || chr(31) || lower(channel) || chr(31) || chr(31) || chr(31)), 32) AS dedupe_key FROM candidates")
def dedupe_key(m):
    none = F.lit("")
    return m.candidates.select("id", versions.dedupe_key(F.col("hint"), versions.normalize_version(F.col("raw_version")), F.col("channel"), none, none, none).alias("dedupe_key"))


@query("content_hash", "SELECT id, sha256(body) AS content_hash, strlen(body) AS bytes FROM artifacts")
def content_hash(m):
    return m.artifacts.select("id", F.sha2("body", 256).alias("content_hash"), F.octet_length("body").cast("long").alias("bytes"))


@query("parse_partial_date", f"SELECT id, release_date AS anchor, release_date_precision AS precision FROM releases")
def parse_partial_date(m):
    shown = dates.render(F.col("release_date"), F.col("release_date_precision"))
    return m.releases.select("id", dates.parse(shown).alias("d")).select("id", "d.anchor", "d.precision")


@query("render_partial_date", "SELECT id, CASE release_date_precision WHEN 'exact_day' THEN strftime(release_date, '%Y-%m-%d') WHEN 'month_only' THEN strftime(release_date, '%Y-%m') WHEN 'year_only' THEN strftime(release_date, '%Y') ELSE '' END AS shown FROM releases")
def render_partial_date(m):
    return m.releases.select("id", dates.render(F.col("release_date"), F.col("release_date_precision")).alias("shown"))


@query("period_end", f"SELECT id, {PERIOD_END} AS period_end FROM releases")
def period_end(m):
    return m.releases.select("id", dates.period_end(F.col("release_date"), F.col("release_date_precision")).alias("period_end"))


@query("parse_with_layout", "SELECT id, CAST(date_trunc('month', occurred_at) AS DATE) AS by_layout, CAST(occurred_at AS DATE) AS by_epoch FROM usage_records")
def parse_with_layout(m):
    printed = F.date_format("occurred_at", "MMMM d, yyyy")
    seconds = F.unix_seconds(F.col("occurred_at").cast("timestamp")).cast("string")
    return m.usage_records.select(
        "id", dates.parse_with_layout(printed, "MMMM d, yyyy", "month_only")["anchor"].alias("by_layout"), dates.parse_with_layout(seconds, "epoch_seconds")["anchor"].alias("by_epoch")
    )


@query("release_date_label", "SELECT id, CASE release_date_precision WHEN 'exact_day' THEN strftime(release_date, '%-d %B %Y') WHEN 'month_only' THEN strftime(release_date, '%B %Y') WHEN 'year_only' THEN strftime(release_date, '%Y') ELSE 'Release date not published' END AS label FROM releases")
def release_date_label(m):
    return m.releases.select("id", dates.label(F.col("release_date"), F.col("release_date_precision")).alias("label"))


@query("utc_minute", "SELECT id, strftime(occurred_at, '%Y-%m-%d %H:%M') || ' UTC' AS utc_minute, strftime(occurred_at, '%Y-%m-%d') AS utc_day FROM usage_records")
def utc_minute(m):
    return m.usage_records.select("id", F.date_format("occurred_at", "yyyy-MM-dd HH:mm 'UTC'").alias("utc_minute"), F.date_format("occurred_at", "yyyy-MM-dd").alias("utc_day"))


@query("truncate_excerpt", "SELECT id, CASE WHEN strlen(t) <= 4000 THEN t ELSE t[1:n] || '…' END AS excerpt FROM (SELECT id, t, CASE WHEN strlen(t) > 4000 THEN list_max(list_filter(range(999, 3998), lambda x: strlen(t[1:x]) <= 3997)) END AS n FROM (SELECT id, trim(excerpt) AS t FROM evidence))")
def truncate_excerpt(m):
    return m.evidence.select("id", text.truncate_excerpt(F.col("excerpt")).alias("excerpt"))


@query("truncate_query", "SELECT id, CASE WHEN length(t) >= 2 THEN t[1:CASE WHEN strlen(t) > 200 THEN list_max(list_filter(range(40, 201), lambda x: strlen(t[1:x]) <= 200)) ELSE 200 END] END AS q FROM (SELECT id, trim(excerpt) AS t FROM evidence)")
def truncate_query(m):
    return m.evidence.select("id", text.truncate_query(F.col("excerpt")).alias("q"))


@query("normalize_search_text", r"SELECT id, left(trim(regexp_replace(lower(excerpt), '[\s\p{Z}]+', ' ', 'g')), 48) AS term FROM evidence")
def normalize_search_text(m):
    return m.evidence.select("id", text.normalize_search_text(F.col("excerpt")).alias("term"))


@query("collapse_whitespace", r"SELECT id, trim(regexp_replace(excerpt, '[\s\p{Z}]+', ' ', 'g')) AS shown FROM (SELECT id, replace(excerpt, chr(8203), '') AS excerpt FROM evidence)")
def collapse_whitespace(m):
    return m.evidence.select("id", text.collapse_whitespace(F.col("excerpt")).alias("shown"))


@query("looks_generated", r"SELECT id, CAST(count(CASE WHEN regexp_matches(w, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$') OR regexp_matches(w, '^[0-9a-fA-F]{8,}$') OR regexp_matches(w, '^:r[0-9a-z]+:$') OR (length(regexp_replace(w, '[^0-9]', '', 'g')) >= 3 AND length(regexp_replace(w, '[^A-Za-z]', '', 'g')) >= 3) THEN 1 END) AS BIGINT) AS generated FROM (SELECT id, unnest(regexp_split_to_array(excerpt, '[ \n]')) AS w FROM evidence) GROUP BY id")
def looks_generated(m):
    words = F.split("excerpt", "[ \n]")
    return m.evidence.select("id", F.size(F.filter(words, text.looks_generated)).cast("long").alias("generated"))


@query("public_source_kind", "SELECT id, CASE source_type WHEN 'rest_api' THEN 'json' WHEN 'json_endpoint' THEN 'json' WHEN 'rss_atom' THEN 'rss_atom' WHEN 'sitemap' THEN 'xml' WHEN 'html_page' THEN 'html' WHEN 'download_portal' THEN 'html' WHEN 'pdf_release_notes' THEN 'pdf' ELSE 'text' END AS kind FROM sources")
def public_source_kind(m):
    return m.sources.select("id", rules.public_source_kind(F.col("source_type")).alias("kind"))


@query("authority_rank", f"SELECT id, {RANKS} AS rank FROM sources")
def authority_rank(m):
    return m.sources.select("id", rules.authority_rank(F.col("quality_class")).alias("rank"))


@query("media_type", "SELECT id, kind AS media_type, kind = 'text/html' AS ok FROM (SELECT id, lower(trim(split_part(CASE id % 3 WHEN 0 THEN ' Text/HTML ; charset=utf-8' WHEN 1 THEN 'application/json' ELSE '' END, ';', 1))) AS kind FROM artifacts)")
def media_type(m):
    header = F.expr("CASE id % 3 WHEN 0 THEN ' Text/HTML ; charset=utf-8' WHEN 1 THEN 'application/json' ELSE '' END")
    kind = text.media_type(header)
    return m.artifacts.select("id", kind.alias("media_type"), (kind == "text/html").alias("ok"))


@query("retry_after_seconds", "SELECT id, CASE id % 3 WHEN 0 THEN id % 100 WHEN 1 THEN greatest(0, CAST(floor(epoch(occurred_at)) AS BIGINT) - 1704500000) END AS seconds FROM usage_records")
def retry_after_seconds(m):
    header = F.when(F.col("id") % 3 == 0, (F.col("id") % 100).cast("string")).when(F.col("id") % 3 == 1, F.date_format("occurred_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise("soon")
    return m.usage_records.select("id", dates.retry_after_seconds(header, F.lit(1704500000)).alias("seconds"))


@query("classify_response", "SELECT id, CASE WHEN status_code = 429 THEN 'rate_limited' WHEN status_code >= 500 THEN 'unavailable' WHEN bytes_out % 2 = 0 THEN 'unchanged' ELSE 'changed' END AS outcome, CASE WHEN status_code < 400 THEN CASE WHEN bytes_out % 2 = 0 THEN 'etag' ELSE 'content_hash' END END AS signal FROM usage_records")
def classify_response(m):
    from ..operators.checks import classify

    log = m.usage_records.select("id", F.when((F.col("status_code") == 200) & (F.col("bytes_out") % 2 == 0), 304).otherwise(F.col("status_code")).alias("status"), F.lit(True).alias("had_etag"), F.lit("a").alias("old_hash"), F.lit("b").alias("new_hash"))
    return classify(log).select("id", "outcome", "signal")


@query("primary_category", "SELECT product_id, coalesce(list_last(list_filter(s, lambda x: x NOT LIKE 'nation-1%')), s[1]) AS primary_category FROM (SELECT product_id, list(slug ORDER BY slug) AS s FROM product_categories pc JOIN categories c ON c.id = pc.category_id GROUP BY product_id)")
def primary_category(m):
    from ..operators import catalog

    slugs = catalog.category_array(m.product_categories, m.categories)
    special = F.filter("category_slugs", lambda x: ~x.startswith("nation-1"))
    return slugs.select("product_id", F.coalesce(F.try_element_at(special, F.lit(-1)), F.try_element_at("category_slugs", F.lit(1))).alias("primary_category"))


@query("product_kind_label", "SELECT id, CASE default_release_type WHEN 'firmware' THEN 'Device firmware' WHEN 'security_update' THEN 'Security update' WHEN 'unknown' THEN 'Product' ELSE replace(default_release_type, '_', ' ') END AS label, CASE WHEN trim(model_identifier) = '' OR model_identifier = name THEN NULL ELSE model_identifier END AS model_line FROM products")
def product_kind_label(m):
    kinds = {"firmware": "Device firmware", "security_update": "Security update", "unknown": "Product"}
    shown = F.coalesce(text.lookup(kinds, F.col("default_release_type"), None), F.regexp_replace("default_release_type", "_", " "))
    line = F.when((F.trim("model_identifier") != "") & (F.col("model_identifier") != F.col("name")), F.col("model_identifier"))
    return m.products.select("id", shown.alias("label"), line.alias("model_line"))


@query("effective_release_type", "SELECT id, CASE WHEN release_type = 'advisory' THEN 'proposed' ELSE release_type END AS effective FROM candidates")
def effective_release_type(m):
    own = F.when(F.col("release_type") == "advisory", "unknown").otherwise(F.col("release_type"))
    return m.candidates.select("id", F.coalesce(F.nullif(own, F.lit("unknown")), F.lit("proposed")).alias("effective"))


@query("json_property", "SELECT id, k AS value, CAST(k AS VARCHAR) AS text FROM analytics")
def json_property(m):
    parsed = F.from_json("props", "k int")
    return m.analytics.select("id", parsed["k"].alias("value"), F.get_json_object("props", "$.k").alias("text"))


@query("point_lookup", "SELECT id, slug, name FROM products WHERE slug = 'product-7'")
def point_lookup(m):
    asked = F.lower(F.trim(F.lit(" Product-7 ")))
    return m.products.where((F.col("slug") == asked) & versions.valid_slug(asked)).select("id", "slug", "name")


@query("compliance_permits", "SELECT id, robots IN ('allowed', 'not_applicable') AND terms IN ('approved', 'restricted') AS permits FROM sources")
def compliance_permits(m):
    return m.sources.select("id", rules.compliance_permits(F.col("robots"), F.col("terms")).alias("permits"))


@query("source_eligible", f"SELECT id, {ELIGIBLE} AS eligible FROM sources")
def source_eligible(m):
    return m.sources.select("id", rules.source_eligible(F.col("enabled"), F.col("health"), F.col("robots"), F.col("terms")).alias("eligible"))


@query("dispatchable_sources", f"SELECT id, next_check_s FROM sources WHERE {ELIGIBLE} AND next_check_s <= 1706745600 AND (retry_after_s IS NULL OR retry_after_s <= 1706745600) ORDER BY next_check_s, id LIMIT 1000")
def dispatchable_sources(m):
    from ..operators.checks import dispatchable

    return dispatchable(m.sources, 1706745600).select("id", "next_check_s")


@query("latest_eligible", "SELECT id, NOT withdrawn AND release_type <> 'advisory' AS eligible FROM releases")
def latest_eligible(m):
    return m.releases.select("id", rules.latest_eligible(F.col("withdrawn"), F.col("release_type")).alias("eligible"))


@query("end_of_life", "SELECT id, lifecycle_status IN ('end_of_life', 'end_of_support') AS end_of_life, trim(model_identifier) <> '' AS is_hardware_model FROM products")
def end_of_life(m):
    return m.products.select("id", F.col("lifecycle_status").isin("end_of_life", "end_of_support").alias("end_of_life"), (F.trim("model_identifier") != "").alias("is_hardware_model"))


@query("filter_releases", "SELECT id, channel, release_type FROM releases WHERE channel = '5-LOW' AND release_type = 'firmware'")
def filter_releases(m):
    return m.releases.where("channel = '5-LOW' and release_type = 'firmware'").select("id", "channel", "release_type")


@query("candidates_by_state", "SELECT id, discovered_on FROM candidates WHERE evidence_id IS NULL ORDER BY discovered_on, id LIMIT 100")
def candidates_by_state(m):
    return m.candidates.where("evidence_id is null").select("id", "discovered_on").orderBy("discovered_on", "id").limit(100)


@query("active_key_filter", "SELECT c.id, c.plan, u.last_seen FROM (SELECT consumer_id, max(occurred_at) AS last_seen FROM usage_records GROUP BY consumer_id) u JOIN consumers c ON c.id = u.consumer_id WHERE u.last_seen >= TIMESTAMP '2024-01-30' AND c.id % 4 <> 0")
def active_key_filter(m):
    keys = m.usage_records.groupBy("consumer_id").agg(F.max("occurred_at").alias("last_seen")).where("last_seen >= timestamp'2024-01-30' and consumer_id % 4 <> 0")
    return keys.join(m.consumers, keys.consumer_id == m.consumers.id).select("id", "plan", "last_seen")


@query("expired_artifacts", "SELECT id, content_class FROM (SELECT id, CASE id % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'standard' ELSE 'permanent' END AS content_class, CASE id % 3 WHEN 0 THEN id % 30 WHEN 1 THEN id % 120 END AS expires_in FROM artifacts) WHERE expires_in < 10")
def expired_artifacts(m):
    kind = F.element_at(F.array(F.lit("short"), F.lit("standard"), F.lit("permanent")), (F.col("id") % 3 + 1).cast("int"))
    left = F.when(F.col("id") % 3 == 0, F.col("id") % 30).when(F.col("id") % 3 == 1, F.col("id") % 120)
    return m.artifacts.where(left < 10).select("id", kind.alias("content_class"))


@query("retention_keep_latest_n", "SELECT id, source_id FROM (SELECT id, source_id, started_at, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) AS n FROM checks) WHERE n <= 5 OR started_at >= TIMESTAMP '2024-01-25'")
def retention_keep_latest_n(m):
    from ..operators.checks import keep_latest

    return keep_latest(m.checks, 5, "2024-01-25").select("id", "source_id")


@query("sorted_set", "SELECT family, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM products WHERE trim(name) <> '' GROUP BY family")
def sorted_set(m):
    names = m.products.select("family", "name").distinct()
    return names.groupBy("family").agg(F.array_join(text.sorted_set(F.collect_list("name")), ",").alias("names"))


@query("merge_participants", "SELECT id, array_to_string(list_sort(list_distinct([slug, 'source-1', 'source-50'])), ',') AS participants FROM sources")
def merge_participants(m):
    others = F.array(F.lit("source-50"), F.lit("source-1"), F.lit(" "))
    return m.sources.select("id", F.array_join(text.merge_participants(F.col("slug"), others), ",").alias("participants"))


SHAPE = "regexp_replace(regexp_replace({0}, '[0-9]+', '#', 'g'), '[^#a-z]', '', 'g')"


@query("assess_transition", f"""SELECT id, line_no, r[1] AS verdict, r[2] AS reason FROM (SELECT id, line_no, CASE WHEN sa <> sb THEN ['uncomparable', 'version shape changed from ' || sa || ' to ' || sb] WHEN a = b THEN ['identical', 'identical to the previously observed version'] WHEN nb < na THEN ['suspicious', 'leading numeric component decreased from ' || na || ' to ' || nb] WHEN nb > na + 5 THEN ['suspicious', 'leading numeric component jumped from ' || na || ' to ' || nb] ELSE ['plausible', 'consistent with the previously observed version'] END AS r
FROM (SELECT *, {SHAPE.format("a")} AS sa, {SHAPE.format("b")} AS sb, CAST(regexp_extract(a, '[0-9]+') AS INT) AS na, CAST(regexp_extract(b, '[0-9]+') AS INT) AS nb FROM (SELECT id, line_no, (id % 9) || '.' || line_no AS a, (line_no * 2) || '.' || (id % 3) || CASE WHEN id % 11 = 0 THEN 'rc' ELSE '' END AS b FROM candidates)))""")
def assess_transition(m):
    rows = m.candidates.select("id", "line_no", F.concat_ws(".", F.col("id") % 9, "line_no").alias("a"), F.concat(F.col("line_no") * 2, F.lit("."), F.col("id") % 3, F.when(F.col("id") % 11 == 0, "rc").otherwise("")).alias("b"))
    return rows.select("id", "line_no", versions.assess_transition(F.col("a"), F.col("b")).alias("r")).select("id", "line_no", "r.verdict", "r.reason")


@query("valid_slug", "SELECT id, regexp_matches(lower(model_identifier), '^[a-z0-9]+(-[a-z0-9]+)*$') AS model_ok, regexp_matches(slug, '^[a-z0-9]+(-[a-z0-9]+)*$') AS slug_ok FROM products")
def valid_slug(m):
    return m.products.select("id", versions.valid_slug(F.lower("model_identifier")).alias("model_ok"), versions.valid_slug(F.col("slug")).alias("slug_ok"))


@query("is_hardware_model", "SELECT id, id % 5 <> 0 AS is_hardware_model FROM products")
def is_hardware_model(m):
    model = F.when(F.col("id") % 5 == 0, F.lit("  ")).otherwise(F.col("model_identifier"))
    return m.products.select("id", (F.trim(model) != "").alias("is_hardware_model"))


@query("utc_day", "SELECT id, strftime(started_at, '%Y-%m-%d') AS utc_day FROM checks")
def utc_day(m):
    return m.checks.select("id", F.date_format("started_at", "yyyy-MM-dd").alias("utc_day"))


@query("content_type_ok", "SELECT id, lower(trim(split_part(CASE WHEN id % 2 = 0 THEN 'TEXT/html; charset=utf-8' ELSE 'text/plain' END, ';', 1))) = 'text/html' AS ok FROM artifacts")
def content_type_ok(m):
    header = F.when(F.col("id") % 2 == 0, "TEXT/html; charset=utf-8").otherwise("text/plain")
    return m.artifacts.select("id", (text.media_type(header) == text.media_type(F.lit("text/html"))).alias("ok"))


@query("secondary_model_line", "SELECT id, CASE WHEN id % 4 <> 0 THEN model_identifier END AS line FROM products")
def secondary_model_line(m):
    name = F.when(F.col("id") % 4 == 0, F.col("model_identifier")).otherwise(F.col("name"))
    return m.products.select("id", F.when((F.trim("model_identifier") != "") & (F.col("model_identifier") != name), F.col("model_identifier")).alias("line"))
