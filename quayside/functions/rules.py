"""Fixed tables of the domain and the predicates over sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lookup

# Authority of a source's quality class.
AUTHORITY = {"official_manufacturer": 50, "authorized_portal": 40, "vendor_repository": 30, "trusted_community": 20, "unknown_third_party": 10}
# What the public is told of a source's type; all other types are "text".
PUBLIC_KIND = {
    "rest_api": "json", "graphql_api": "json", "json_endpoint": "json", "github_releases": "json",
    "rss_atom": "rss_atom", "xml_feed": "xml", "sitemap": "xml", "html_page": "html",
    "download_portal": "html", "authenticated_portal": "html", "pdf_release_notes": "pdf",
}
# Legal next states of a candidate.
CANDIDATE_STATES = {
    "discovered": ["extracted", "rejected"],
    "extracted": ["normalized", "rejected", "human_review_required"],
    "normalized": ["validation_pending", "rejected", "human_review_required"],
    "validation_pending": ["validated", "rejected", "human_review_required"],
    "validated": ["published", "rejected", "human_review_required"],
    "human_review_required": ["validated", "rejected", "published"],
    "rejected": ["human_review_required"],
    "published": ["superseded"],
    "superseded": [],
}
# Legal next states of a source's health.
HEALTH_STATES = {
    "discovered": ["pending_review", "disabled", "retired"],
    "pending_review": ["active", "disabled", "retired"],
    "active": ["degraded", "rate_limited", "authentication_required", "broken", "relocated", "disabled", "retired"],
    "degraded": ["active", "broken", "rate_limited", "authentication_required", "relocated", "disabled", "retired"],
    "rate_limited": ["active", "degraded", "broken", "disabled", "retired"],
    "authentication_required": ["active", "disabled", "retired", "broken"],
    "broken": ["active", "degraded", "relocated", "disabled", "retired"],
    "relocated": ["active", "disabled", "retired"],
    "disabled": ["pending_review", "active", "retired"],
    "retired": [],
}
BROKEN_AFTER = 3


def authority_rank(quality: Column) -> Column:
    return lookup(AUTHORITY, quality, 0)


def public_source_kind(kind: Column) -> Column:
    return lookup(PUBLIC_KIND, kind, "text")


def compliance_permits(robots: Column, terms: Column) -> Column:
    return robots.isin("allowed", "not_applicable") & terms.isin("approved", "restricted")


def source_eligible(enabled: Column, health: Column, robots: Column, terms: Column) -> Column:
    return enabled & health.isin("active", "degraded") & compliance_permits(robots, terms)


def latest_eligible(withdrawn: Column, release_type: Column) -> Column:
    return ~withdrawn & (release_type != "advisory")


def legal(states: dict[str, list[str]], before: Column, after: Column) -> Column:
    """Staying put is legal; otherwise the table decides."""
    table = F.create_map(*[x for k, v in states.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]).cast("array<string>"))])
    return (before == after) | F.coalesce(F.array_contains(table[before], after), F.lit(False))
