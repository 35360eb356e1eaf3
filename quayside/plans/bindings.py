"""The catalogue's tables as views over the star schema, in SQL that Spark and DuckDB share."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def _partial(date: str, key: str) -> str:
    """A date at one of four precisions, anchored on the first day of its period."""
    return (
        f"CASE {key} % 4 WHEN 0 THEN CAST({date} AS DATE) WHEN 1 THEN CAST(date_trunc('month', {date}) AS DATE) "
        f"WHEN 2 THEN CAST(date_trunc('year', {date}) AS DATE) END AS release_date, "
        f"CASE {key} % 4 WHEN 0 THEN 'exact_day' WHEN 1 THEN 'month_only' WHEN 2 THEN 'year_only' ELSE 'unknown' END AS release_date_precision"
    )


VIEWS = {
    "vendors": "SELECT s_suppkey AS id, 'vendor-' || s_suppkey AS slug, s_name AS name FROM supplier",
    "categories": (
        "SELECT 'r' || r_regionkey AS id, 'region-' || lower(r_name) AS slug, CAST(NULL AS STRING) AS parent_id FROM region "
        "UNION ALL SELECT 'n' || n_nationkey, lower(replace(n_name, '_', '-')), 'r' || n_regionkey FROM nation"
    ),
    "products": (
        "SELECT p_partkey AS id, p_partkey % (SELECT count(*) FROM supplier) AS vendor_id, p_brand AS family, "
        "'product-' || p_partkey AS slug, p_name AS name, p_brand || '-' || p_partkey AS model_identifier, p_size * 2 AS popularity, "
        "p_size >= 40 AS security_critical, CASE p_partkey % 6 WHEN 0 THEN 'end_of_life' WHEN 1 THEN 'end_of_support' "
        "WHEN 2 THEN 'announced' ELSE 'active' END AS lifecycle_status, "
        "CASE p_type WHEN 'ECONOMY' THEN 'firmware' WHEN 'STANDARD' THEN 'security_update' WHEN 'PROMO' THEN 'advisory' ELSE 'unknown' END AS default_release_type FROM part"
    ),
    "product_categories": "SELECT p_partkey AS product_id, 'n' || (p_partkey % 25) AS category_id FROM part UNION ALL SELECT p_partkey, 'n' || ((p_partkey * 7) % 31) FROM part",
    "aliases": (
        "SELECT p_partkey AS product_id, p_partkey % (SELECT count(*) FROM supplier) AS vendor_id, p_name AS alias, 'name' AS alias_kind FROM part "
        "UNION ALL SELECT p_partkey, p_partkey % (SELECT count(*) FROM supplier), p_brand || '-' || p_partkey, 'model' FROM part "
        "UNION ALL SELECT p_partkey, p_partkey % (SELECT count(*) FROM supplier), p_brand || ' ' || p_type, 'marketing' FROM part"
    ),
    "relationships": "SELECT p_partkey AS from_product_id, 'runs_os' AS relation_kind, p_partkey % 40 AS to_product_id FROM part WHERE p_partkey >= 40 AND p_partkey % 3 = 0",
    "sources": (
        "SELECT s_suppkey AS id, 'source-' || s_suppkey AS slug, s_suppkey AS vendor_id, s_suppkey * 3 AS product_id, 'https://vendor-' || s_suppkey || '.example.com/feed' AS url, "
        "CASE s_suppkey % 5 WHEN 0 THEN 'official_manufacturer' WHEN 1 THEN 'authorized_portal' WHEN 2 THEN 'vendor_repository' WHEN 3 THEN 'trusted_community' ELSE 'unknown_third_party' END AS quality_class, "
        "s_suppkey % 5 < 2 AS official, CASE WHEN s_suppkey % 10 <= 5 THEN 'active' WHEN s_suppkey % 10 = 6 THEN 'degraded' WHEN s_suppkey % 10 = 7 THEN 'rate_limited' WHEN s_suppkey % 10 = 8 THEN 'broken' ELSE 'disabled' END AS health, "
        "CASE s_suppkey % 7 WHEN 0 THEN 'disallowed' WHEN 1 THEN 'unknown' WHEN 2 THEN 'not_applicable' ELSE 'allowed' END AS robots, "
        "CASE s_suppkey % 6 WHEN 0 THEN 'pending' WHEN 5 THEN 'prohibited' WHEN 4 THEN 'restricted' ELSE 'approved' END AS terms, s_suppkey % 11 <> 0 AS enabled, "
        "CASE s_suppkey % 8 WHEN 0 THEN 'rest_api' WHEN 1 THEN 'rss_atom' WHEN 2 THEN 'html_page' WHEN 3 THEN 'sitemap' WHEN 4 THEN 'pdf_release_notes' WHEN 5 THEN 'json_endpoint' WHEN 6 THEN 'manual' ELSE 'download_portal' END AS source_type, "
        "(s_suppkey % 9 + 1) * 3600 AS frequency_s, 1706745600 + (s_suppkey % 50 - 25) * 3600 AS next_check_s, CASE WHEN s_suppkey % 13 = 0 THEN 1706745600 + 7200 END AS retry_after_s, "
        "CASE WHEN s_suppkey % 17 <> 0 THEN 1706745600 - (s_suppkey % 97) * 3600 END AS last_success_s FROM supplier"
    ),
    "observations": (
        "SELECT l_suppkey AS source_id, l_partkey AS product_id, l_returnflag AS channel, 'v7.' || (CAST(l_quantity AS INT) % 3) AS version, "
        + _partial("l_shipdate", "l_orderkey")
        + ", CAST(l_shipdate AS DATE) AS observed_on, l_orderkey AS order_id, l_linenumber AS line_no FROM lineitem"
    ),
    "releases": (
        "SELECT o_orderkey AS id, o_orderkey % (SELECT count(*) FROM supplier) AS vendor_id, (o_orderkey % 12) || '.' || (o_custkey % 5) || (CASE WHEN o_orderkey % 9 = 0 THEN 'rc1' ELSE '' END) AS version, "
        "o_orderpriority AS channel, "
        + _partial("o_orderdate", "o_orderkey")
        + ", CAST(o_orderdate AS DATE) AS first_observed_on, CASE o_orderkey % 7 WHEN 0 THEN 'security_update' WHEN 1 THEN 'advisory' ELSE 'firmware' END AS release_type, "
        "o_orderstatus = 'F' AND o_orderkey % 5 = 0 AS withdrawn, CASE o_orderkey % 3 WHEN 1 THEN true WHEN 2 THEN false END AS recommended, "
        "CAST(o_orderdate AS DATE) + CAST(o_custkey % 30 AS INT) AS last_verified_on, o_orderkey % 1000 AS evidence_id FROM orders"
    ),
    "mappings": "SELECT DISTINCT l_orderkey AS release_id, l_partkey AS product_id FROM lineitem",
    "evidence": "SELECT doc_id AS id, doc_id % 120 AS source_id, text AS excerpt, n_chars FROM documents",
    "artifacts": "SELECT page_id AS id, url, html AS body FROM pages",
    "usage_records": (
        "SELECT event_id AS id, user_id AS consumer_id, ts AS occurred_at, CASE event_type WHEN 'error' THEN 500 WHEN 'click' THEN CASE WHEN value > 200 THEN 429 ELSE 200 END ELSE 200 END AS status_code, "
        "value AS duration_ms, CAST(event_id % 977 AS BIGINT) * 13 AS bytes_out, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, "
        "CASE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 5 WHEN 0 THEN '/v1/search' WHEN 1 THEN '/v1/products' WHEN 2 THEN '/v1/releases' WHEN 3 THEN '/v1/latest' ELSE '/v1/vendors' END AS endpoint FROM events"
    ),
    "analytics": (
        "SELECT event_id AS id, ts AS occurred_at, user_id AS session_bucket, CASE event_type WHEN 'view' THEN 'ProductViewed' WHEN 'click' THEN 'SearchExecuted' WHEN 'signup' THEN 'APIKeyCreated' WHEN 'purchase' THEN 'ReleasePublished' ELSE 'SourceBroken' END AS event_name, "
        "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 4 AS result_count, value AS latency_ms, props FROM events"
    ),
    "checks": (
        "SELECT event_id AS id, user_id AS source_id, ts AS started_at, CASE event_type WHEN 'error' THEN 'unavailable' WHEN 'purchase' THEN 'changed' WHEN 'signup' THEN 'rate_limited' ELSE 'unchanged' END AS outcome, value AS duration_ms FROM events"
    ),
    "consumers": "SELECT c_custkey AS id, c_name AS name, CASE c_mktsegment WHEN 'BUILDING' THEN 'free' WHEN 'MACHINERY' THEN 'paid' WHEN 'HOUSEHOLD' THEN 'anonymous' ELSE 'enterprise' END AS plan, CAST(20 + c_custkey % 60 AS BIGINT) AS monthly_quota FROM customer",
    "candidates": (
        "SELECT l_orderkey * 8 + l_linenumber AS id, l_suppkey AS source_id, CASE WHEN l_orderkey % 3 = 0 THEN p_brand || '-' || p_partkey WHEN l_orderkey % 3 = 1 THEN p_brand || ' ' || p_type ELSE p_name END AS hint, "
        "CASE WHEN l_orderkey % 5 = 0 THEN l_partkey END AS product_id, '  V' || (l_orderkey % 12) || '.' || CAST(l_quantity AS INT) || '  ' AS raw_version, l_returnflag AS channel, "
        + _partial("l_shipdate", "l_orderkey")
        + ", CAST(0.80 + l_discount AS DECIMAL(3,2)) AS confidence, CASE WHEN l_orderkey % 50 <> 0 THEN l_orderkey END AS evidence_id, CAST(l_shipdate AS DATE) AS discovered_on, l_linenumber AS line_no, "
        "CASE l_orderkey % 6 WHEN 0 THEN 'security_update' WHEN 1 THEN 'advisory' ELSE 'firmware' END AS release_type "
        "FROM (SELECT l.*, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS copy_no FROM lineitem l) x JOIN part ON p_partkey = l_partkey WHERE copy_no = 1"
    ),
}


class Model:
    """Lazily bound frames of one data folder: ``model.products`` and so on; base tables by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def _frames(self) -> dict[str, DataFrame]:
        return {}

    @cached_property
    def dealt_mappings(self) -> DataFrame:
        """``mappings`` for what joins them to releases: dealt by release once, rows are made distinct and joined where
        they are. The number is given, so that these tasks are not merged and the sets that each holds stay small."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        pairs = self.lineitem.select("l_orderkey", "l_partkey").repartition(parts, "l_orderkey")
        return self.spark.sql(VIEWS["mappings"].replace("FROM lineitem", "FROM {pairs}"), pairs=pairs)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in VIEWS and name not in (*BASE, "embeddings", "conversations"):
            raise AttributeError(name)
        if name not in self._frames:
            if name not in VIEWS:
                self._frames[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                used = [t for t in BASE if re.search(rf"\b(FROM|JOIN) {t}\b", VIEWS[name])]
                text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(used)})\b", r"\1 {\2}", VIEWS[name])
                self._frames[name] = self.spark.sql(text, **{t: getattr(self, t) for t in used})
        return self._frames[name]
