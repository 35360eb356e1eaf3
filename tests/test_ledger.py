"""Decisions, upserts, states after checks and security statuses: every branch, and a batch that comes twice."""

import datetime as dt

from pyspark.sql import functions as F

from quayside.operators import checks, ledger, summary

ITEMS = "id long, state string, candidate_id long, candidate_state string, permitted boolean, conflict_id string, product_id long"
TOLD = "item_id long, decision string, actor string, reason string, decided_at date"
day = lambda n: dt.date(2026, 1, n)


def test_decisions_take_effect_once(spark):
    items = spark.createDataFrame([
        (1, "open", 10, "human_review_required", True, "c1", 100), (2, "open", 20, "human_review_required", False, None, 100), (3, "resolved", 30, "published", True, None, 100),
        (4, "open", 40, "published", True, None, 100), (5, "open", None, None, False, "c1", 200), (6, "open", 60, "human_review_required", True, None, 300), (7, "open", 70, "human_review_required", True, None, None),
    ], ITEMS)
    told = spark.createDataFrame([
        (1, " Accept ", "ann", " fine ", day(2)), (1, "reject", "bob", "late", day(3)), (1, "reject", "bob", "early", day(1)), (2, "accept", "ann", "x", day(1)), (3, "reject", "ann", "x", day(1)), (4, "reject", "ann", "x", day(1)),
        (5, "accept", "ann", "x", day(4)), (5, "reject", "ann", "x", day(5)), (6, "accept", " ", "x", day(1)), (6, "accept", "ann", None, day(1)), (6, "maybe", "ann", "x", day(1)), (7, "accept", "ann", "x", day(1)), (9, "reject", "ann", "x", day(1)),
    ], TOLD)
    log = ledger.change_log(items, told).cache()
    got = {(r.item_id, r.actor, r.decision, r.decided_at.day): (r.problem, r.item_after, r.candidate_after) for r in log.collect()}
    assert got[1, "bob", "reject", 1] == (None, "resolved", "rejected") and got[1, "ann", "accept", 2][0] == "already resolved" == got[1, "bob", "reject", 3][0]
    assert [got[k][0] for k in ((2, "ann", "accept", 1), (3, "ann", "reject", 1), (4, "ann", "reject", 1), (6, "", "accept", 1), (6, "ann", "accept", 1), (6, "ann", "maybe", 1), (9, "ann", "reject", 1))] == [
        "not permitted", "already resolved", "illegal step", "no actor", "no reason", "no such decision", "no such item",
    ]
    # an item that is about no candidate is accepted only where its source may be published from
    assert got[5, "ann", "accept", 4][0] == "not permitted" and got[5, "ann", "reject", 5] == (None, "resolved", None)
    assert [(r.conflict_id, r.actor, r.resolution) for r in ledger.closed_conflicts(log).collect()] == [("c1", "bob", "rejected: early")]
    assert {(r.subject_id, r.action, r.before.review_state, r.after.candidate_state) for r in ledger.audit_rows(log).collect()} == {(1, "review_item.rejected", "open", "rejected"), (5, "review_item.rejected", "open", None), (7, "review_item.accepted", "open", "published")}
    assert {r.product_id for r in ledger.to_refresh(log).collect()} == {100, 200}
    state = ledger.candidates_after(spark.createDataFrame([(10, "human_review_required"), (70, "human_review_required"), (99, "extracted")], "id long, state string"), log)
    assert {r.id: r.state for r in state.collect()} == {10: "rejected", 70: "published", 99: "extracted"}
    assert sum(r.release_id is not None for r in log.collect()) == 1
    assert ledger.change_log(items, told, log).count() == 0
    later = spark.createDataFrame([(1, "accept", "eve", "again", day(9)), (6, "reject", "eve", "no", day(9))], TOLD)
    assert {r.item_id: r.problem for r in ledger.change_log(items, told.union(later), log).collect()} == {1: "already resolved", 6: None}


def test_candidates_are_stored_once(spark):
    schema = "id long, source_id long, hint string, raw_version string, channel string, discovered_on date"
    first = spark.createDataFrame([(1, 1, "A", "V1", "s", day(2)), (2, 1, " a", "v1 ", "s", day(1)), (3, 2, "a", "v1", "s", day(1))], schema)
    stored = ledger.upsert(first).cache()
    assert {(r.id, r.source_id, r.created, r.seen, r.last_seen) for r in stored.collect()} == {(2, 1, True, 2, day(2)), (3, 2, True, 1, day(1))}
    again = ledger.upsert(first, stored)
    assert {(r.id, r.created) for r in again.collect()} == {(2, False), (3, False)}
    assert sorted(map(tuple, ledger.merged(stored, again).collect())) == sorted(map(tuple, stored.select("id", "source_id", "dedupe_key", "last_seen").collect()))
    more = ledger.upsert(spark.createDataFrame([(7, 1, "a", "v1", "s", day(9)), (8, 1, "a", "v2", "s", day(9))], schema), stored)
    assert {(r.id, r.created, r.last_seen) for r in more.collect()} == {(2, False, day(9)), (8, True, day(9))}
    assert ledger.merged(stored, more).count() == 3


def test_state_after_checks(spark):
    at = lambda n: dt.datetime(2026, 1, 1, n)
    rows = [(1, 1, "changed", at(1), "e1", "h1"), (2, 1, "unavailable", at(2), None, None), (3, 1, "unchanged", at(3), "e2", None), (4, 1, "unchanged", at(4), None, None), (5, 2, "parser_failed", at(1), None, None), (6, 2, "unavailable", at(1), None, None), (7, 3, "rate_limited", at(1), None, None)]
    got = {r.source_id: (r.checks, r.outcome, r.failures, r.unchanged, r.etag, r.content_hash, r.last_changed) for r in checks.after_checks(spark.createDataFrame(rows, "id long, source_id long, outcome string, started_at timestamp, etag string, content_hash string")).collect()}
    assert got == {1: (4, "unchanged", 0, 2, "e2", "h1", at(1)), 2: (2, "unavailable", 2, 0, None, None, None), 3: (1, "rate_limited", 0, 0, None, None, None)}


def test_every_security_status(spark):
    products = spark.createDataFrame([(1, "X-1"), (2, "X-2"), (3, "X-3")], "id long, model_identifier string")
    aliases = spark.createDataFrame([(1, "router one", "model"), (2, "both", "marketing"), (3, "both", "marketing"), (3, "three", "name")], "product_id long, alias string, alias_kind string")
    versions = spark.createDataFrame([(1, "1.0"), (1, "2.0"), (3, "9")], "product_id long, version string")
    adv = spark.createDataFrame([
        (1, "A", None, "x-1", True, True, ["1.0"], ["2.0"]), (2, "B", None, "X-1", False, True, ["1.0"], ["2.0"]), (3, "C", "Router One", None, True, False, ["1.0"], []), (4, "D", "router one", None, False, True, ["1.0"], []),
        (5, "E", "three", None, True, True, ["9"], []), (6, "F", "both", None, True, True, ["9"], []), (7, "G", "what", None, True, True, [], []), (8, "A", "router one", None, True, True, [], ["1.0"]),
    ], "id long, cve string, product string, cpe string, vendor boolean, scoped boolean, affected array<string>, fixed array<string>")
    out = summary.correlate(adv, products, aliases, versions).cache()
    got = {(r.id, r.product_id, r.version): r.status for r in out.collect()}
    assert got == {
        (1, 1, "1.0"): "confirmed_affected", (1, 1, "2.0"): "fixed_in_version", (2, 1, "1.0"): "vendor_investigation_pending", (2, 1, "2.0"): "confirmed_not_affected", (3, 1, "1.0"): "unknown", (3, 1, "2.0"): "unknown",
        (4, 1, "1.0"): "potentially_affected", (4, 1, "2.0"): "potentially_affected", (5, 3, "9"): "potentially_affected", (6, 2, None): "potentially_affected", (6, 3, "9"): "potentially_affected", (7, None, None): "no_match",
        (8, 1, "1.0"): "fixed_in_version", (8, 1, "2.0"): "confirmed_not_affected",
    }
    folded = {(r.cve, r.product_id, r.version): (r.status, r.review, r.advisories) for r in summary.security_status(out).collect()}
    assert folded["A", 1, "1.0"] == ("confirmed_affected", True, 2) and folded["B", 1, "2.0"] == ("confirmed_not_affected", False, 1) and folded["B", 1, "1.0"] == ("vendor_investigation_pending", True, 1)
    assert out.where(F.col("status").isin(*summary.SECURITY, "no_match")).count() == out.count()


def test_advisories_that_say_the_same_are_correlated_once(spark):
    said = [(k, f"C{k % 3}", "n" if k % 2 else "none", None, k % 4 < 2, True, ["1"], ["2"]) for k in range(600)]
    adv = spark.createDataFrame(said, "id long, cve string, product string, cpe string, vendor boolean, scoped boolean, affected array<string>, fixed array<string>")
    products = spark.createDataFrame([(1, "x-1"), (2, "x-2")], "id long, model_identifier string")
    aliases = spark.createDataFrame([(1, "N", "model")], "product_id long, alias string, alias_kind string")
    versions = spark.createDataFrame([(1, "1"), (1, "2"), (1, "3")], "product_id long, version string")
    of = (adv, products, aliases, versions)
    rows = summary.correlated_statements(*of)
    assert rows.count() == 3 * 2 * 3
    told = lambda rows: sorted(tuple(r) for r in summary.security_status(rows).collect())
    assert told(rows) == told(summary.correlate(*of)) and {r[-1] for r in told(rows)} == {100}
    assert summary.correlate(*of).where("status = 'no_match'").count() == 300


def test_ids_of_advisories_that_say_the_same_travel_together(spark, monkeypatch):
    met, told = [], summary._told
    monkeypatch.setattr(summary, "_told", lambda rows, known: met.append(rows) or told(rows, known))
    said = [(k, f"C{k % 3}", "n", None, True, True, ["1"], ["2"]) for k in range(900)] + [(0, "C0", "n", None, True, True, ["1"], ["2"])]
    adv = spark.createDataFrame(said, "id long, cve string, product string, cpe string, vendor boolean, scoped boolean, affected array<string>, fixed array<string>")
    aliases = spark.createDataFrame([(1, "N", "model")], "product_id long, alias string, alias_kind string")
    rest = spark.createDataFrame([(1, "x-1")], "id long, model_identifier string"), aliases, spark.createDataFrame([(1, "1"), (1, "2"), (1, None)], "product_id long, version string")
    for most in (1 << 16, 100):
        monkeypatch.setattr(summary, "TOGETHER", most)
        got = [(r.id, r.cve, r.product_id, r.version, r.status) for r in summary.correlate(adv, *rest).collect()]
        status = {"1": "confirmed_affected", "2": "fixed_in_version", None: "confirmed_not_affected"}
        assert sorted(got, key=str) == sorted(((k, c, 1, v, status[v]) for k, c, *_ in said for v in status), key=str)
    assert met[0].count() == 3 and 3 < met[1].count() <= 30


def test_versions_that_no_advisory_asks_for_are_left_out_first(spark):
    said = [(k, "C", "n", None, True, True, ["1"], ["2"]) for k in range(20)]
    adv = spark.createDataFrame(said, "id long, cve string, product string, cpe string, vendor boolean, scoped boolean, affected array<string>, fixed array<string>")
    products, aliases = spark.createDataFrame([(1, "x-1")], "id long, model_identifier string"), spark.createDataFrame([(1, "N", "model"), (2, "n", "model"), (9, "m", "model")], "product_id long, alias string, alias_kind string")
    lines = spark.createDataFrame([(p, v) for p in (1, 2, *range(9, 400)) for v in ("1", "2", "2")], "product_id long, version string")
    of = adv, products, aliases, lines.distinct()
    for rows, most in ((summary.correlate(*of).where("product_id is not null"), 80), (summary.correlated_statements(*of), 4)):
        assert rows.count() == most and {r.product_id for r in rows.select("product_id").collect()} == {1, 2}
        tree = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
        depth = lambda what: [len(line) - len(line.lstrip(" :+-")) for line in tree if what in line]
        assert depth("Join LeftSemi") and min(depth("Join LeftSemi")) > min(depth("Aggregate [product_id#"))


def test_versions_are_dealt_to_a_given_number_of_tasks(spark):
    of = spark.createDataFrame([(None, "n", p, 2, 3) for p in (1, 2, 3)], "cpe string, product string, product_id long, identity int, products long")
    known = summary._known(of, spark.createDataFrame([(p, str(v)) for p in (1, 2) for v in range(300)], "product_id long, version string"))
    per = [n for (n,) in known.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(per) == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1 and sum(per) == 601 and max(per) < 300
