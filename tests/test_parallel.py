"""Folds, ranks, spans and closures that are spread over tasks, against the plain way of one after the other."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.functions import rules
from quayside.operators import alerts, catalog, checks, conflicts, latest, metrics, pages, usage
from quayside.plans import catalogue

D, T = dt.date, dt.datetime


def test_composed_maps_are_steps_one_after_the_other():
    table, rng = checks.transitions(), np.random.default_rng(2)
    for n in (1, 2, 3, 7, 64, 101):
        of, state = rng.integers(0, len(table), n), np.arange(table.shape[1])
        for o in of:
            state = table[o][state]
        assert checks.composed(table[of]).tolist() == state.tolist()


def test_health_of_one_source_with_all_the_checks(spark):
    rng = random.Random(7)
    outcomes = ["unchanged", "changed", "unavailable", "parser_failed", "rate_limited", "unauthorized", "redirected", "odd", None]
    rows = [(k, 1 if k % 10 else None if k % 3 else 2, rng.choices(outcomes, [4, 2, 9, 3, 1, 1, 1, 1, 1])[0], T(2024, 1, 1) + dt.timedelta(seconds=k // 3)) for k in range(6000)]
    shuffled = rng.sample(rows, len(rows))
    want = {}
    for source in (1, 2, None):
        health, failures = "active", 0
        for k, s, outcome, _ in rows:
            if s == source:
                failures = failures + 1 if outcome in checks.FAILURES else 0
                health = checks.step_health(health, outcome or "", failures)
                want[k] = (s, failures, health)
    frame = spark.createDataFrame(shuffled, "id long, source_id long, outcome string, started_at timestamp").repartition(5)
    assert {r.id: (r.source_id, r.failures, r.health) for r in checks.fold_health(frame).collect()} == want
    assert len({h for _, _, h in want.values()}) > 4
    assert checks.fold_health(frame.limit(0)).count() == 0


def test_rolling_counts_of_one_endpoint(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["a", "a", "a", "b", None]), T(2024, 1, 1) + dt.timedelta(seconds=rng.choice([rng.randint(0, 500), rng.randint(0, 20_000)]))) for k in range(1500)]
    got = usage.rolling_counts(spark.createDataFrame(rows, "id long, e string, occurred_at timestamp"), "e", {"short": 60, "long": 7000}, block=100).collect()
    at = {k: (e, t) for k, e, t in rows}
    assert len(got) == len(rows)
    for r in rng.sample(got, 200):
        e, t = at[r.id]
        near = lambda span: sum(x == e and 0 <= (t - s).total_seconds() <= span for _, x, s in rows)  # noqa: B023, E731
        assert (r.short, r.long) == (near(60), near(7000))


@pytest.mark.parametrize("bins", [64, 4096])
def test_quantiles_are_exact(spark, bins):
    rng = np.random.default_rng(4)
    groups = {"heavy": np.exp(rng.standard_normal(2000) * 8), "ties": rng.integers(0, 4, 500) * 1.0, "one": np.array([3.5]), "two": np.array([1.0, 2.0]), "far": np.array([-1e308, 0.0, 1e308, 1.0]), None: rng.standard_normal(99)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("ties", None), ("empty", None)]
    wanted = {"low": 0.0, "half": 0.5, "p95": 0.95, "p99": 0.99, "top": 1.0}
    got = metrics.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", wanted, bins=bins).collect()
    assert {r.g for r in got} == set(groups)
    for r in got:
        for name, q in wanted.items():
            x = np.sort(groups[r.g])
            at = q * (len(x) - 1)
            want = x[int(at)] + (x[int(np.ceil(at))] - x[int(at)]) * (at - int(at))
            assert r[name] == pytest.approx(want, rel=1e-9, abs=1e-6)


def test_latest_as_of_equals_every_day(spark):
    rng = random.Random(8)
    day = lambda n: D(2020, 1, 1) + dt.timedelta(days=n)
    rels = [(k, f"v{k}", "c", None if k % 7 == 0 else day(rng.randint(-50, 40)), None if k == 5 else day(rng.randint(0, 60)), day(rng.randint(0, 70)) if k % 3 == 0 else None) for k in range(150)]
    maps = [(k, p) for k in range(150) for p in range(4) if rng.random() < 0.4]
    days = [day(n) for n in sorted(rng.sample(range(-5, 75), 37))]
    frame = spark.createDataFrame(rels, "id long, version string, channel string, release_date date, first_observed_on date, withdrawn_on date")
    want = set()
    for d, p in itertools.product(days, range(4)):
        live = [r for r in rels if (r[0], p) in set(maps) and r[4] and r[4] <= d and (r[5] is None or r[5] > d)]
        if live:
            want.add((d, p, max(live, key=lambda r: (r[3] is not None, r[3] or D.min, r[4], r[0]))[0]))
    out = latest.latest_as_of(frame, spark.createDataFrame(maps, "release_id long, product_id long"), spark.createDataFrame([(d,) for d in days] * 2, "day date"))
    assert {(r.day, r.product_id, r.id) for r in out.collect()} == want
    assert out.count() == len(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_latest_as_of_reads_mappings_once_in_small_tasks(spark, sf_dir):
    plan = catalogue.queries()["latest_as_of"](spark, sf_dir)._jdf.queryExecution()
    assert sum("Relation [" in line and "l_partkey#" in line for line in plan.optimizedPlan().toString().splitlines()) == 1
    assert "REPARTITION_BY_NUM" in plan.executedPlan().toString()


def test_ancestors_of_long_chains_and_cycles(spark):
    chain = [(f"c{k}", f"c{k + 1}" if k < 29 else None) for k in range(30)]
    got = catalog.category_ancestors(spark.createDataFrame(chain, "id string, parent_id string")).collect()
    assert len(got) == 435 and {(r.id, r.ancestor): r.steps for r in got}[("c0", "c29")] == 29
    ring = spark.createDataFrame([("a", "b"), ("b", "a"), ("x", "a"), ("s", "s"), ("lost", "gone")], "id string, parent_id string")
    rows = {(r.id, r.ancestor): r.steps for r in catalog.category_ancestors(ring).collect()}
    assert rows == {("a", "b"): 1, ("b", "a"): 1, ("a", "a"): 2, ("b", "b"): 2, ("x", "a"): 1, ("x", "b"): 2, ("s", "s"): 1, ("lost", "gone"): 1}
    assert {k[0] for k in rows if k[0] == k[1]} == {"a", "b", "s"}
    assert catalog.category_ancestors(ring.limit(0)).count() == 0


def test_conflicts_of_a_subject_with_many_sources(spark):
    sources = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 2 == 0, "official_manufacturer").otherwise("trusted_community").alias("quality_class"), F.lit(True).alias("enabled"), F.lit("active").alias("health"), F.lit("allowed").alias("robots"), F.lit("approved").alias("terms"))
    claims = sources.select(F.col("id").alias("source_id"), F.lit(1).cast("long").alias("product_id"), F.lit("s").alias("channel"), F.concat(F.lit("v"), F.col("id") % 3).alias("version"), F.lit(None).cast("date").alias("release_date"), F.lit("2024-01-01").cast("date").alias("observed_on"), F.lit(1).alias("order_id"), F.lit(1).alias("line_no"))
    out = conflicts.detect_conflicts(claims, sources)
    told = {(r.version, r.rank, r.status, tuple(r.conflicting_versions), tuple(r.outranked_versions), r.authority_rank, r.n) for r in out.groupBy("version", "rank", "status", "conflicting_versions", "outranked_versions", "authority_rank").agg(F.count("*").alias("n")).collect()}
    others = {f"v{k}": tuple(f"v{j}" for j in range(3) if j != k) for k in range(3)}
    assert {(v, r, s, c, o, a) for v, r, s, c, o, a, _ in told} == {(v, rank, "unresolved", others[v], others[v] if rank == 50 else (), 50) for v in others for rank in (50, 20)}
    assert sum(n for *_, n in told) == 20_000
    held = conflicts.open_conflicts(out).first()
    assert (held.versions, len(held.source_ids), held.authority_rank) == (["v0", "v1", "v2"], 20_000, 50)


def test_every_event_is_counted(spark):
    rows = [(T(2024, 1, 1), "ReleasePublished", 1), (T(2024, 1, 1, 5), "ReleasePublished", 1), (T(2024, 1, 1, 6), "APIKeyCreated", None), (T(2024, 1, 2), "Mine", 4)]
    got = metrics.event_counts(spark.createDataFrame(rows, "occurred_at timestamp, event_name string, k long"), "k").collect()
    assert {(r.day, r.event_name, r.about, r.events, r.subjects) for r in got} == {(D(2024, 1, 1), "ReleasePublished", "release", 2, 1), (D(2024, 1, 1), "APIKeyCreated", "consumer", 1, 0), (D(2024, 1, 2), "Mine", "unknown", 1, 1)}
    assert sum(map(len, metrics.EVENTS.values())) == 28


def test_rules_hold_fire_and_end(spark):
    at = lambda h: T(2024, 1, 1) + dt.timedelta(hours=h)
    up = spark.createDataFrame([("m", "s", at(h), v) for h, v in [(0, 9.0), (1, 9.0), (2, 9.0), (3, 0.0), (4, 9.0), (6, 9.0), (7, 9.0), (8, None), (12, 9.0)]] + [("m", "other", at(20), 0.0)], "metric string, series string, at timestamp, value double")
    table = alerts.rule_table(spark, [("hot", "m", ">", 5.0, 7200, "page", False), ("gone", "m", "<", 1.0, 3600, "ticket", True), ("no metric", "x", ">", 0.0, 0, "page", False)])
    spans = alerts.stretches(up, table, 3600)
    got = {(r.rule, r.series, r.pending_at, r.firing_at, r.resolved_at) for r in spans.collect()}
    assert got == {
        ("hot", "s", at(0), at(2), at(3)), ("hot", "s", at(4), None, at(5)), ("hot", "s", at(6), None, at(8)), ("hot", "s", at(12), None, at(13)),
        ("gone", "s", at(3), None, at(4)), ("gone", "s", at(5), None, at(6)), ("gone", "s", at(9), at(10), at(12)), ("gone", "s", at(13), at(14), None), ("gone", "other", at(20), None, None),
    }
    said = alerts.events(spans.where("rule = 'hot'")).orderBy("at", "event").collect()
    assert [(r.event, r.at) for r in said] == [("pending", at(0)), ("firing", at(2)), ("resolved", at(3)), ("pending", at(4)), ("cleared", at(5)), ("pending", at(6)), ("cleared", at(8)), ("pending", at(12)), ("cleared", at(13))]


def test_broken_after_is_in_the_states():
    assert checks.transitions().shape == (len(checks.OUTCOMES), len(rules.HEALTH_STATES) * (rules.BROKEN_AFTER + 1))


def test_products_that_share_releases_meet_as_classes(spark):
    rng = random.Random(11)
    rows = [(r, p) for p in range(60) for r in rng.sample(range(40), rng.randint(1, 4))] + [(7, 3), (7, 3), (None, 3), (7, None)]
    rows += [(r, p) for p in range(100, 140) for r in (7, 11, 900)]  # copies of one product
    frame = spark.createDataFrame(rows, "release_id long, product_id long")
    want = {}
    for (r1, p1), (r2, p2) in itertools.product(rows, rows):
        if r1 is not None and r1 == r2 and p1 is not None and p2 is not None and p1 < p2:
            want[p1, p2] = want.get((p1, p2), 0) + 1
    assert sorted(tuple(r) for r in pages.shared(frame).collect()) == sorted((*k, v) for k, v in want.items())
    hot = spark.range(1000, 31_000).select(F.lit(1).cast("long").alias("release_id"), F.col("id").alias("product_id"))
    members, pairs = pages.sharing_classes(hot.union(frame))
    assert members.count() == 30_000 + 60 + 40
    assert members.where("product_id >= 1000").agg(F.collect_set("class")).first()[0] == [1000]
    beside = sum(1 in {r for r, q in rows if q == p} for p in range(60))
    assert pairs.where("c2 = 1000").count() == beside > 0
    assert pages.shared(frame.limit(0)).count() == 0
