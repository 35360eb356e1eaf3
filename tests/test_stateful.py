"""Streams with a machine for each key against batch replays of all that has come."""

import datetime as dt
import random

from pyspark.sql import functions as F

from quayside.operators import alerts, conflicts
from quayside.streaming import jobs, stateful

T = dt.datetime


def test_conflicts_open_and_close_as_claims_change(spark):
    rng = random.Random(3)
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    schema = "source_id long, product_id long, channel string, version string, release_date date, observed_on date, order_id long, line_no long"
    steps = [[(1, 1, "s", "v1", None, day(5), 1, 1), (2, 1, "s", "v2", None, day(5), 2, 1)], [(2, 1, "s", "v1", None, day(6), 3, 1)], [(1, 1, "s", "v9", None, day(2), 4, 1)], [(1, 1, "s", " ", None, day(9), 5, 1), (1, 2, None, "v1", None, day(1), 5, 2)]]
    for n, step in enumerate(steps):  # files come out of order: a later one holds older claims
        step += [(rng.randint(1, 6), rng.randint(3, 8), rng.choice("ab"), rng.choice(["v1", "v2", "v3", ""]), rng.choice([None, day(rng.randint(0, 30))]), day(rng.randint(0, 40)), 10 + n, k) for k in range(40)]
    frames = [spark.createDataFrame(s, schema) for s in steps]
    got = {(r.step, r.product_id, r.channel, r.event, tuple(r.versions)) for r in jobs.replay(frames, stateful.conflict_events).collect()}
    sources = spark.range(1, 7).select("id", F.lit("vendor_repository").alias("quality_class"), F.lit(True).alias("enabled"), F.lit("active").alias("health"), F.lit("allowed").alias("robots"), F.lit("approved").alias("terms"))
    want, was, so_far = set(), {}, None
    for k, frame in enumerate(frames):
        so_far = frame if so_far is None else so_far.union(frame)
        now = {}
        for r in conflicts.detect_conflicts(so_far, sources).collect():
            now.setdefault((r.product_id, r.channel), []).append(r)
        for key in set(now) | set(was):
            rows = now.get(key, [])
            hot = any(r.status == "unresolved" for r in rows)
            if hot != was.get(key, False):
                want.add((k, *key, "opened" if hot else "resolved", tuple(sorted({r.version for r in rows}))))
            was[key] = hot
    assert got == want
    first = [(s, e) for s, p, c, e, _ in sorted(got, key=str) if (p, c) == (1, "s")]
    assert first == [(0, "opened"), (1, "resolved")]
    assert {e for *_, e, _ in got} == {"opened", "resolved"}


def test_many_subjects_take_few_calls(spark):
    import time

    rows = spark.range(40_000).selectExpr("id % 7 as source_id", "id div 2 as product_id", "'a' as channel", "concat('v', id % 2) as version", "date'2024-01-01' as release_date", "date'2024-01-01' as observed_on", "id as order_id", "1L as line_no")
    began = time.perf_counter()
    out = jobs.replay([rows], stateful.conflict_events)
    assert out.where("event = 'opened'").select("product_id").distinct().count() == out.count() == 20_000
    assert time.perf_counter() - began < 40


def test_alerts_hold_through_gaps_and_late_rows(spark):
    at = lambda m: T(2024, 1, 1) + dt.timedelta(minutes=m)
    rng = random.Random(6)
    busy = [(m, e) for m in range(0, 3000, 7) for e in "ab" if not 600 <= m < 1500 and not (e == "b" and m > 2000)]  # a gap, and a series that ends
    rows = [(at(m), e, 500 if (m // 240) % 2 and rng.random() < 0.7 else 200) for m, e in busy]
    steps = [[r for r in rows if r[0] < at(1000)], [r for r in rows if at(1000) <= r[0] < at(2400)], [r for r in rows if r[0] >= at(2400)]]
    steps[2].append((at(30), "a", 500))  # far behind the watermark: it changes nothing
    steps[1].append(steps[0].pop(0))  # late, and behind the watermark as well
    schema = "occurred_at timestamp, endpoint string, status_code int"
    rules = [("errors", "error_ratio", ">", 0.3, 7200, "page", False), ("brief", "error_ratio", ">", 0.3, 0, "page", False), ("silent", "requests", "<", 1.0, 10_800, "page", True)]
    job = lambda s: stateful.alert_events(jobs.traffic(s, "10 minutes", "1 hour", "1 hour"), rules, 3600)
    got = sorted((r.rule, r.series, r.event, r.at) for r in jobs.replay([spark.createDataFrame(s, schema) for s in steps], job).collect())
    until, windows = max(r[0] for r in rows) - dt.timedelta(minutes=10), {}
    for t, e, code in [r for s in steps for r in s if r not in (steps[2][-1], steps[1][-1])]:
        end = t.replace(minute=0) + dt.timedelta(hours=1)
        if end <= until:
            n, bad = windows.get((e, end), (0, 0))
            windows[e, end] = (n + 1, bad + (code >= 500))
    samples = [(m, e, t, v) for (e, t), (n, bad) in windows.items() for m, v in (("requests", float(n)), ("error_ratio", bad / n))]
    frame = spark.createDataFrame(samples, "metric string, series string, at timestamp, value double")
    spans = alerts.stretches(frame, alerts.rule_table(spark, rules), 3600, F.lit(until))
    assert got == sorted((r.rule, r.series, r.event, r.at) for r in alerts.events(spans).collect())
    assert {(r, e) for r, _, e, _ in got} >= {("errors", "firing"), ("brief", "resolved"), ("silent", "firing"), ("silent", "resolved")}
    # plainly, one step after the other
    want, hold = [], {"errors": 2, "brief": 0, "silent": 3}
    for series in "ab":
        t = min(e for s, e in windows if s == series)
        state = {r: ("quiet", None) for r in hold}
        while t <= until:
            n, bad = windows.get((series, t), (0, 0))
            for rule, for_ in hold.items():
                hot = (n < 1) if rule == "silent" else n > 0 and bad / n > 0.3
                kind, since = state[rule]
                if hot and kind == "quiet":
                    kind, since = "pending", t
                    want.append((rule, series, "pending", t))
                if hot and kind == "pending" and t - since >= dt.timedelta(hours=for_):
                    kind = "firing"
                    want.append((rule, series, "firing", t))
                if not hot and kind != "quiet":
                    want.append((rule, series, "resolved" if kind == "firing" else "cleared", t))
                    kind = "quiet"
                state[rule] = (kind, since)
            t += dt.timedelta(hours=1)
    assert got == sorted(want)
