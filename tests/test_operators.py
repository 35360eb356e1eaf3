"""Cases of the domain rules on small rows: ties, nulls, unknown dates, illegal steps, empty tables."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quayside.functions import dates, rules, text, versions
from quayside.operators import audit, catalog, checks, conflicts, extract, gates, latest, metrics, pages, registry, review, search
from quayside.plans import catalogue
from quayside.plans.bindings import BASE
from quayside.streaming import jobs

D = dt.date


def one(spark, expr, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("before", "after", "verdict"), [
    (None, "7.1", "plausible"), ("7.1", "7.1", "identical"), ("7.1", "7.2", "plausible"), ("7.1", "6.9", "suspicious"),
    ("7.1", "12.0", "plausible"), ("7.1", "13.0", "suspicious"), ("7.1", "7.2rc1", "uncomparable"), ("---", "7", "uncomparable"),
    ("alpha", "alpha-", "plausible"), ("99999999999999999999", "1", "uncomparable"),
])
def test_transitions(spark, before, after, verdict):
    row = spark.createDataFrame([(before, after)], "a string, b string")
    assert row.select(versions.assess_transition(F.col("a"), F.col("b"))["verdict"]).first()[0] == verdict


@pytest.mark.parametrize(("raw", "slug"), [("RouterOS v7 (stable)", "routeros-v7-stable"), ("  A_b.c/d+e ", "a-b-c-d-e"), ("ÄÖ", ""), ("a--b", "a-b")])
def test_slugs(spark, raw, slug):
    assert one(spark, versions.slugify(F.col("v")), v=raw) == slug


def test_version_limits(spark):
    rows = spark.createDataFrame([("  V 7\t.1 ",), ("",), ("x" * 201,), ("é" * 100,), ("é" * 101,), (None,)], "v string")
    got = [r[0] for r in rows.select(versions.normalize_version(F.col("v"))).collect()]
    assert got == ["v 7 .1", None, None, "é" * 100, None, None]


@pytest.mark.parametrize(("shown", "anchor", "precision"), [
    ("", None, "unknown"), ("2026", D(2026, 1, 1), "year_only"), ("2026-02", D(2026, 2, 1), "month_only"), ("2026-02-28", D(2026, 2, 28), "exact_day"),
])
def test_partial_dates_round_trip(spark, shown, anchor, precision):
    got = one(spark, dates.parse(F.col("v")), v=shown)
    assert (got.anchor, got.precision) == (anchor, precision)


@pytest.mark.parametrize("bad", ["2026-02-30", "1969", "2201", "soon", "26", "2026-13"])
def test_bad_dates_are_null(spark, bad):
    assert one(spark, dates.parse(F.col("v")), v=bad) is None


def test_window_uses_the_end_of_the_period(spark):
    rows = spark.createDataFrame([
        (1, D(2025, 1, 1), "year_only", D(2020, 1, 1)), (2, D(2025, 6, 1), "month_only", D(2020, 1, 1)),
        (3, D(2025, 6, 30), "exact_day", D(2020, 1, 1)), (4, None, "unknown", D(2026, 1, 1)), (5, None, "unknown", D(2020, 1, 1)),
    ], "id int, release_date date, release_date_precision string, first_observed_on date")
    kept = latest.history_window(rows, F.lit(D(2025, 7, 1)))
    assert sorted(r.id for r in kept.collect()) == [1, 4]
    assert latest.history_window(rows, F.lit(None).cast("date")).count() == 5


def test_excerpt_is_cut_between_characters(spark):
    for filler in ("é", "日", "😀", "a"):
        raw = "x" + filler * 4000
        got = one(spark, text.truncate_excerpt(F.col("v")), v=raw)
        assert len(got.encode()) <= 4000 and got.endswith("…") and raw.startswith(got[:-1])
        assert len(got.encode()) > 4000 - 4 - len(filler.encode())


def test_latest_prefers_known_dates_and_flags_keep_the_first(spark):
    rel = spark.createDataFrame([
        (1, "1.0", "s", None, "unknown", D(2026, 1, 9), "firmware", False), (2, "1.1", "s", D(2025, 1, 1), "exact_day", D(2025, 1, 2), "firmware", False),
        (3, "1.2", "s", D(2025, 1, 1), "exact_day", D(2025, 1, 2), "firmware", False), (4, "9", "s", D(2026, 1, 1), "exact_day", D(2026, 1, 1), "firmware", True),
        (5, "8", "s", D(2026, 1, 1), "exact_day", D(2026, 1, 1), "advisory", False),
    ], "id long, version string, channel string, release_date date, release_date_precision string, first_observed_on date, release_type string, withdrawn boolean")
    maps = spark.createDataFrame([(i, 7) for i in (1, 2, 3, 4, 5)], "release_id long, product_id long")
    assert latest.latest_release(rel, maps).first().id == 5  # the read order breaks ties by id and lets advisories through
    flags = {r.id: r.is_latest for r in latest.latest_flag(rel, maps).collect()}
    assert flags == {1: False, 2: True, 3: False, 4: False, 5: False}
    again = {r.id: r.is_latest for r in latest.latest_flag(rel.repartition(5), maps.repartition(3)).collect()}
    assert again == flags


SOURCE = "id long, quality_class string, enabled boolean, health string, robots string, terms string"
CLAIM = "source_id long, product_id long, channel string, version string, release_date date, observed_on date, order_id long, line_no int"


def test_conflicts_by_rank(spark):
    ok = (True, "active", "allowed", "approved")
    src = spark.createDataFrame([(1, "official_manufacturer", *ok), (2, "trusted_community", *ok), (3, "official_manufacturer", *ok), (4, "official_manufacturer", False, "active", "allowed", "approved")], SOURCE)
    claim = lambda s, v, p=1: (s, p, "c", v, D(2026, 1, 1), D(2026, 1, 1), 1, 1)
    obs = spark.createDataFrame([claim(1, "a"), claim(2, "b"), claim(4, "z"), claim(1, "a", 2), claim(3, "b", 2), claim(1, " ", 3)], CLAIM)
    got = {(r.product_id, r.source_id): r.status for r in conflicts.detect_conflicts(obs, src).collect()}
    assert got == {(1, 1): "outranked", (1, 2): "unresolved", (2, 1): "unresolved", (2, 3): "unresolved"}
    assert conflicts.detect_conflicts(obs.limit(0), src).count() == 0


def test_later_claims(spark):
    rows = [(1, 1, "c", "old", D(2026, 1, 1), D(2026, 1, 1), 1, 1), (1, 1, "c", "undated", None, D(2026, 9, 1), 2, 1), (1, 1, "c", "new", D(2026, 2, 1), D(2025, 1, 1), 3, 1)]
    obs = spark.createDataFrame(rows, CLAIM)
    row = conflicts.current_observation(obs).first()
    assert (row.version, row.first_observed_on) == ("new", D(2025, 1, 1))


def test_alias_resolution_has_three_outcomes(spark):
    products = spark.createDataFrame([(1, 9, "hap-ax3"), (2, 9, "other"), (3, 8, "hap-ax3")], "id long, vendor_id long, slug string")
    aliases = spark.createDataFrame([(1, 9, "hAP ax³"), (1, 9, "Router"), (2, 9, "router"), (2, 9, "")], "product_id long, vendor_id long, alias string")
    hints = spark.createDataFrame([(9, "HAP-AX3"), (9, "ROUTER!"), (9, "none"), (9, None), (9, "HAP-AX3")], "vendor_id long, hint string")
    got = {r.hint: (r.status, r.product_id) for r in catalog.alias_resolution(hints.dropna(), products, aliases).collect()}
    assert got == {"HAP-AX3": ("unique", 1), "ROUTER!": ("ambiguous", None), "none": ("no_match", None)}


def test_rejection_stops_the_gates(spark):
    schema = "id long, match string, version string, eligible boolean, duplicate_id long, release_date date, release_date_precision string, previous string, evidence_id long, official boolean, confidence decimal(3,2), conflicting array<string>"
    base = ["unique", "1", True, None, None, "unknown", None, 5, True, 0.9, []]
    import decimal

    def row(i, **change):
        names = ["match", "version", "eligible", "duplicate_id", "release_date", "release_date_precision", "previous", "evidence_id", "official", "confidence", "conflicting"]
        got = dict(zip(names, base, strict=True)) | change
        got["confidence"] = decimal.Decimal(str(got["confidence"]))
        return (i, *[got[n] for n in names])

    rows = spark.createDataFrame([row(1), row(2, eligible=False, conflicting=["x"]), row(3, confidence=0.84), row(4, match="ambiguous", duplicate_id=7), row(5, conflicting=["x"], confidence=0.1), row(6, release_date=D(2026, 1, 4), release_date_precision="exact_day")], schema)
    got = {r.id: (r.decision, r.reason, len(r.gates)) for r in gates.validate_candidates(rows, F.lit(D(2026, 1, 1))).collect()}
    assert got[1] == ("passed", None, 10)
    assert got[2] == ("rejected", "source_eligible", 3)
    assert got[3] == ("review_required", "confidence_threshold", 10)
    assert got[4] == ("rejected", "duplicate", 4)
    assert got[5] == ("review_required", "multi_source_agreement", 10)
    assert got[6] == ("review_required", "date_valid", 10)


def test_health_follows_legal_steps():
    assert checks.step_health("active", "unavailable", 1) == "degraded"
    assert checks.step_health("degraded", "unavailable", 3) == "broken"
    assert checks.step_health("broken", "changed", 0) == "active"
    assert checks.step_health("retired", "changed", 0) == "retired"
    assert checks.step_health("authentication_required", "rate_limited", 0) == "authentication_required"


def test_cadence_is_clamped_and_late_by_five_percent(spark):
    schema = "base_s long, retry_after_s long, outcome string, health string, failures int, unchanged int, last_changed_s long, now_s long, end_of_life boolean, security_critical boolean, popular boolean"
    rows = spark.createDataFrame([
        (86400, 60, "changed", "active", 0, 0, None, 0, True, True, True), (86400, None, "unavailable", "active", 30, 0, None, 0, False, False, False),
        (86400, None, "unchanged", "active", 0, 2, 0, 3600, False, False, False), (86400, None, "unchanged", "active", 0, 0, None, 0, True, True, False),
    ], schema)
    got = [(r.interval_s, r.next_s) for r in checks.next_check(rows).collect()]
    assert got == [(900.0, 945), (2592000.0, 2721600), (21600.0, 26280), (86400.0, 90720)]


def test_batch_and_stream_agree(spark, sf_dir):
    from quayside.plans.catalogue import queries

    q = queries()
    last = {r.source_id: (r.failures, r.health) for r in q["source_health_transition"](spark, sf_dir).orderBy("id").collect()}
    stream = {r.source_id: (r.failures, r.health) for r in q["stream_source_health"](spark, sf_dir).collect()}
    assert stream == last
    audit_rows = q["throttle_audit"](spark, sf_dir).groupBy("consumer_id").agg(F.count_if("allowed").alias("a"), F.count_if(~F.col("allowed")).alias("d")).collect()
    assert {r.consumer_id: (r.a, r.d) for r in audit_rows} == {r.consumer_id: (r.allowed, r.denied) for r in q["stream_token_bucket"](spark, sf_dir).collect()}
    batch = {(r.session_bucket, r.started_at): r.abandoned for r in q["search_abandonment"](spark, sf_dir).collect()}
    over = q["stream_sessions"](spark, sf_dir).collect()
    assert over and all(batch[(r.session_bucket, r.started_at.replace(tzinfo=None))] == r.abandoned for r in over)


def test_token_bucket_refills():
    passed, tokens, seen = jobs.take_tokens([0, 0, 0, 60], 2.0, None, 2, 1)
    assert (passed, tokens, seen) == ([True, True, False, True], 0.0, 60)


def test_extraction_keeps_missing_dates_unknown(spark):
    pages = spark.createDataFrame([(1, "<script>v9</script><main><li>v1 2026-09-01</li><li>v2 someday</li><li></li></main>"), (2, "<p>none</p>"), (3, None)], "id long, body string")
    rows = extract.containers(pages, "<li>(.*?)</li>", "main")
    fields = {"version": extract.field(F.col("markup"), [("regex_extract", r"(v\d+)"), ("strip", "v")]), "date": extract.field(F.col("markup"), [("regex_extract", " (.+)")])}
    got = [(r.version, r.release_date, r.release_date_precision, r.confidence, r.skipped) for r in extract.build_candidates(rows, fields, [], "yyyy-MM-dd").orderBy("container").collect()]
    assert got == [("1", D(2026, 9, 1), "exact_day", 0.95, False), ("2", None, "unknown", 0.85, False), (None, None, "unknown", 0.85, True)]
    told = {r.id: r.error for r in extract.normalize_pages(pages, "main").collect()}
    assert told == {1: None, 2: "section not found", 3: "section not found"}


def test_containers_of_every_section(spark):
    pages = spark.createDataFrame([(1, "<article><p>a</p></article><p>out</p><ARTICLE class='x'><p>b</p><p>c</p></ARTICLE>"), (2, "<p>none</p>"), (3, None)], "id long, body string")
    rows = extract.containers(pages, "<p>(.*?)</p>", "article")
    assert sorted(map(tuple, rows.select("id", "container", "markup", "found").collect())) == [(1, 0, "a", 3), (1, 1, "b", 3), (1, 2, "c", 3)]
    assert [r.found for r in extract.containers(pages, "<p>(.*?)</p>", "article", 2).collect()] == [3, 3] and extract.containers(pages, "<p>(.*?)</p>").count() == 5


def test_feeds_that_are_not_feeds(spark):
    rows = spark.createDataFrame([(1, "<rss><channel><item><title> a </title><link>l</link></item></channel></rss>"), (2, "<feed/>"), (3, "not xml")], "id long, xml string")
    got = {(r.id, r.title, r.guid, r.error is None) for r in extract.feed_entries(rows).collect()}
    assert got == {(1, "a", "l", True), (2, None, None, False), (3, None, None, False)}


def test_feeds_of_both_dialects_and_beyond_the_limits(spark):
    atom = (
        '<?xml version="1.0"?><!-- x --><feed xmlns="http://www.w3.org/2005/Atom"><title>f</title>'
        '<entry><title type="text"> v1 </title><link rel="self" href="s"/><link rel="alternate" href="p1"/><id></id><updated>2024-01-02T10:00:00Z</updated></entry>'
        '<entry><title>v2</title><link href="p2"/><id>tag:2</id><published>2024-02-03T00:00:00Z</published><updated>2025-01-01T00:00:00Z</updated></entry></feed>'
    )
    item = "<item><title>t</title></item>"
    many = f"<rss><channel>{item * (extract.MAX_ENTRIES + 3)}</channel></rss>"
    large = f"<rss><channel>{item}<!--{'x' * extract.MAX_FEED_BYTES}--></channel></rss>"
    one = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>only</title><id>i</id></entry></feed>'
    rows = spark.createDataFrame([(1, atom), (2, None), (3, large), (4, many), (5, one), (6, "<html/>")], "id long, xml string")
    got = extract.feed_entries(rows).collect()
    assert [(r.entry, r.title, r.guid, r.published) for r in got if r.id == 1] == [(0, "v1", "p1", D(2024, 1, 2)), (1, "v2", "tag:2", D(2024, 2, 3))]
    assert {r.id: r.error for r in got if r.id in (2, 3, 6)} == {2: "no document", 3: "more than 4194304 bytes", 6: "neither an RSS nor an Atom document"}
    of_many = [r for r in got if r.id == 4]
    assert len(of_many) == extract.MAX_ENTRIES and {r.warning for r in of_many} == {"5003 entries, more than 5000; later ones ignored"}
    assert [(r.title, r.guid, r.error, r.warning) for r in got if r.id == 5] == [("only", "i", None, None)]


@pytest.mark.parametrize(("path", "allowed"), [("/", True), ("/a/x", False), ("/a/ok", True), ("/z.pdf", False), ("/z.pdfx", True)])
def test_robots(spark, path, allowed):
    robots = spark.createDataFrame([("h", "*", False, "/"), ("h", "bot", False, "/a/"), ("h", "bot", True, "/a/ok"), ("h", "bot", False, "/*.pdf$")], "host string, agent string, allow boolean, pattern string")
    assert extract.robots_audit(spark.createDataFrame([("h", path)], "host string, path string"), robots, "botty").first().allowed is allowed


def test_registry(spark):
    want = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, name string")
    have = spark.createDataFrame([(2, "b"), (3, "x"), (4, "y")], "id long, name string")
    assert {r.id: r.action for r in registry.diff(want, have, ["id"]).collect()} == {1: "insert", 2: "unchanged", 3: "update", 4: "orphaned"}
    kept = registry.exact_replace(have, spark.createDataFrame([(2, "q")], "id long, name string"), "id")
    assert sorted(map(tuple, kept.collect())) == [(2, "q"), (3, "x"), (4, "y")]


def test_audits_and_pages(spark):
    rows = spark.createDataFrame([(1, None), (2, 5), (2, 6)], "id long, ref long")
    assert [r.ref for r in audit.unknown(rows, "ref", spark.createDataFrame([(5,)], "id long")).collect()] == [6]
    assert audit.repeated(rows, ["id"]).first().copies == 2
    page = pages.keyset(rows, [("id", "desc"), ("ref", "asc")], {"id": F.lit(2), "ref": F.lit(5)}, 9)
    assert [tuple(r) for r in page.collect()] == [(2, 6), (1, None)]


def test_review_scores(spark):
    rows = spark.createDataFrame([("official_manufacturer", 0.957, 300, True, False, "advisory"), (None, -1.0, None, None, None, None)], "quality_class string, confidence double, popularity int, security_critical boolean, conflicted boolean, release_type string")
    a, b = review.score_review(rows).collect()
    assert (a.priority, a.sla, len(a.reasons)) == (100 + 50 + 95 + 100 + 150 + 50, "urgent", 6)
    assert (b.priority, b.sla) == (100, "low")


def test_trigrams(spark):
    assert sorted(one(spark, text.trigrams(F.col("v")), v="ab c")) == sorted(["  a", " ab", "ab ", "  c", " c "])
    left = spark.createDataFrame([("router",), ("",), (None,)], "a string")
    right = spark.createDataFrame([("routers",), ("switch",)], "b string")
    assert [(r.a, r.b) for r in search.trigram_pairs(left, right).collect()] == [("router", "routers")]


def test_search_keeps_few_products_of_a_name_and_words(spark):
    names, n = ["red bolt", "red rod", "blue rod"], 400
    products = spark.createDataFrame([(k, names[k % 3], k % 2, "red" if k % 50 == 0 else "Brand") for k in range(n)] + [(n, None, 0, None)], "id long, name string, vendor_id long, family string")
    vendors = spark.createDataFrame([(0, "Rod Bolt"), (1, "Acme")], "id long, name string")
    aliases = spark.createDataFrame([(k, "blue bolt" if k % 7 == 0 else f"model {k}") for k in range(n)], "product_id long, alias string")
    queries = spark.createDataFrame([(q,) for q in (*names, "blue bolt", "bolt red acme", "reds", "none", "", None)], "q string")
    told = lambda limit: sorted(map(tuple, search.search(queries, products, vendors, aliases, limit).where("place <= 5").collect()))
    assert told(5) == told(1000) and {r[0] for r in told(5)} >= {*names, "blue bolt", "bolt red acme", "reds"}
    assert search.search(queries, products, vendors, aliases, 1000).count() > n
    kept = search.contenders(products, search.lexemes(products, vendors, aliases).where("word in ('red', 'blue', 'rod', 'bolt')"), 2)
    assert kept.groupBy("name", "lexemes").count().where("count > 2").isEmpty() and kept.count() < 60


def test_legal_states(spark):
    rows = spark.createDataFrame([("rejected", "rejected"), ("validated", "published"), ("published", "validated"), ("nowhere", "published")], "a string, b string")
    got = [r[0] for r in rows.select(rules.legal(rules.CANDIDATE_STATES, F.col("a"), F.col("b"))).collect()]
    assert got == [True, True, False, False]


@pytest.mark.parametrize("name", ["stream_source_health", "stream_token_bucket", "stream_sessions", "stream_search_view_join", "stream_usage_rollup", "stream_usage_dedupe", "stream_alerts"])
def test_streams_carry_state_over_batches(spark, sf_dir, tmp_path_factory, name):
    """The events of a table in four files, one a micro-batch, give what all of them in one give."""
    import duckdb
    import pyarrow.parquet as pq

    from test_queries import ordered

    folder = tmp_path_factory.mktemp("split")
    (folder / "events.parquet").mkdir()
    events = pq.read_table(f"{sf_dir}/events.parquet").sort_by([("ts", "ascending"), ("event_id", "ascending")])
    for k in range(4):
        cut = [events.num_rows * i // 4 for i in (k, k + 1)]
        path = folder / "events.parquet" / f"part-{k}.parquet"
        pq.write_table(events.slice(cut[0], cut[1] - cut[0]), path)
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    frame = catalogue.queries()[name](spark, str(folder))
    told = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in told.description]
    assert ordered(frame.select(names).collect()) == ordered(told.fetchall())


def test_ranked_equals_windows(spark):
    rng = random.Random(3)
    rows = [(rng.randint(-50, 5000) * 7, rng.choice([1, 1, 1, 2, 3, 9])) for _ in range(600)]
    rows = list(dict(rows).items())
    for part in (rows, rows[:7], rows[:1], []):
        frame = spark.createDataFrame(part, "k long, v long")
        got = sorted((r.k, r.v, r.place, r.decile) for r in metrics.ranked(frame, "k", "v", 10, buckets=16).collect())
        w = Window.orderBy(F.desc("v"))
        want = sorted(tuple(r) for r in frame.select("k", "v", F.rank().over(w), F.ntile(10).over(Window.orderBy(F.desc("v"), "k"))).collect())
        assert got == want


def test_typo_clusters_equal_all_pairs(spark):
    rng = random.Random(5)
    words = list({" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 2))) for _ in range(60)})
    asked = []
    for w in words:
        q = list(w)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(q)) if q else 0
            q[k : k + 1] = rng.choice(["", "x", " ", "ab"])
        asked.append(("".join(q), rng.randint(1, 80)))
    asked = list(dict(asked).items())

    def step(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        return out

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = step(row, i, x, b)
        return row[-1]

    want = {}
    for q, n in asked:
        for w in words:
            if n <= 50 and q != w and edits(q, w) <= 2:
                k, v = want.get(w, (0, 0))
                want[w] = (k + 1, v + n)
    got = search.typo_clusters(spark.createDataFrame(asked, "q string, n long"), spark.createDataFrame([(w,) for w in words], "word string"))
    assert {r.word: (r.spellings, r.volume) for r in got.collect()} == want and want
