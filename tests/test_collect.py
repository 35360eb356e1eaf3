"""Collectors by configuration, every warning they can give, and the job from artifacts to releases."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quayside.operators import collect
from quayside.streaming import ingest

TEXT = {
    "engine": "text_regex", "container": r"(?P<v>v[\d.]+)(?: on (?P<day>\S+))?(?: (?P<channel>\w+);)?", "replace": [["V", "v"], [r"\s+", " "]], "product": "router",
    "fields": {
        "version": {"group": "v", "transforms": [["strip_prefix", "v"], "trim"], "required": True}, "channel": {"transforms": [["map", {"s": "stable", "b": "beta"}]]},
        "release_date": {"group": "day", "date_format": "%d/%m/%Y", "precision": "month_only"}, "region": {"value": "EU"},
    },
}
HTML = {
    "engine": "html_selectors", "container": "li.rel", "section": "main", "strip": [".ad"], "max_candidates": 2, "channel": "stable", "base": 0.9, "penalty": 0.25, "floor": 0.6,
    "fields": {"version": {"selector": "b"}, "release_notes_url": {"selector": "a", "attribute": "href"}, "release_date": {"selector": "time", "date_format": "epoch_seconds", "precision": "exact_day"}, "hardware_revision": {"selector": "i", "first": True}},
}


def run(spark, artifacts, **configs):
    rows = spark.createDataFrame([(k, "kept", c, b) for k, (c, b) in enumerate(artifacts)], "id long, extra string, collector_id string, body string")
    table = spark.createDataFrame([(n, c if isinstance(c, str) else json.dumps(c)) for n, c in configs.items()], "collector_id string, spec string")
    out = collect.extract(rows, table, ("extra",)).cache()
    return collect.candidates(out).orderBy("id", "container").collect(), {(r.id, r.container, r.warning) for r in collect.warnings(out).collect()}


def test_named_groups_replaced_texts_and_dates(spark):
    made, warned = run(spark, [("t", "V1.2 on\n03/02/2026 s; then v9 on 31/31/2026 x;"), ("t", None), ("t", "nothing here")], t=TEXT)
    assert [(r.id, r.extra, r.container, r.found, r.raw_version, r.channel, r.release_date, r.release_date_precision, r.hint, r.fields["region"], r.confidence) for r in made] == [
        (0, "kept", 0, 2, "1.2", "stable", dt.date(2026, 2, 1), "month_only", "router", "EU", 0.95), (0, "kept", 1, 2, "9", None, None, "unknown", "router", "EU", 0.75),
    ]
    assert made[0].excerpt == "v1.2 on 03/02/2026 s;" and len(made[0].dedupe_key) == 32
    assert warned == {(0, 1, "lowered"), (0, 1, "undated"), (1, None, "no_match"), (2, None, "no_match")}


def test_selectors_sections_and_limits(spark):
    li = lambda v, more="": f"<li class=rel><b>{v}</b>{more}</li>"
    page = "<li class=rel><b>out</b></li><main><div class=ad>" + li("ad") + "</div><ul>" + li("1.0", "<a href='/n'>n</a><time>86400</time><i>r1</i><i>r2</i>") + li("2.0<b>x</b>", "") + li("3.0") + "</ul></main>"
    made, warned = run(spark, [("h", page), ("h", "<main></main>")], h=HTML)
    assert [(r.raw_version, r.fields["release_notes_url"], r.fields["hardware_revision"], r.release_date, r.channel, r.confidence, r.found) for r in made] == [("1.0", "/n", "r1", dt.date(1970, 1, 2), "stable", 0.9, 3)]
    assert warned == {(0, None, "too_many"), (0, 1, "ambiguous"), (0, 1, "skipped"), (1, None, "no_match")}


def test_limits_of_bytes(spark):
    small = TEXT | {"max_bytes": 8}
    made, warned = run(spark, [("t", "v1 éé v2"), ("h", "<main>" + "x" * 50 + "</main>"), ("x", "v1"), ("bad", "v1"), ("old", "v1"), (None, "v1")], t=small, h=HTML | {"max_bytes": 20}, bad="{", old={"engine": "perl", "container": "x", "fields": {"version": {}}})
    assert [(r.id, r.raw_version) for r in made] == [(0, "1")]
    assert {w for w in warned if w[2] not in ("lowered", "undated")} == {(0, None, "truncated"), (1, None, "too_large"), (2, None, "no_config"), (3, None, "bad_config"), (4, None, "bad_config"), (5, None, "no_config")}


def test_a_pattern_that_takes_too_long(monkeypatch):
    slow = collect.Collector(TEXT)

    def find(body, warn):
        yield "v1", {"version": "v1"}, []
        raise TimeoutError

    monkeypatch.setattr(slow, "find", find)
    rows, warned = slow.read("v1")
    assert len(rows) == 1 and warned[-1][1] == "timeout"


@pytest.mark.parametrize(("value", "steps", "want"), [
    (" A b ", ["trim", "lowercase"], "a b"), ("x", ["uppercase"], "X"), ("v1", [["strip_prefix", "v"]], "1"), ("1-rc", [["strip_suffix", "-rc"]], "1"), ("n 12 m", [["regex_extract", r"(\d)\d"]], "1"),
    ("n 12 m", [["regex_extract", r"\d+"]], "12"), ("n", [["regex_extract", r"\d"]], None), ("a.b", [["regex_replace", r"\.", "-"]], "a-b"), ("a", [["map", {"b": "c"}], "trim"], None), (None, ["trim"], None),
])
def test_transforms(value, steps, want):
    assert collect.transform(value, steps) == want
    with pytest.raises(ValueError):
        collect.transform("x", ["eval"])


def test_artifacts_to_releases_in_one_file_or_many(spark):
    spec = json.dumps({"engine": "text_regex", "container": r"(?P<version>\d+\.\d+)(?P<channel>[ab])", "fields": {"version": {}, "channel": {}}})
    configs = spark.createDataFrame([("c", spec)], "collector_id string, spec string")
    sources = spark.createDataFrame([(k, k % 3, q, True, "active", "allowed", t) for k, q, t in [(1, "official_manufacturer", "approved"), (4, "official_manufacturer", "approved"), (7, "trusted_community", "approved"), (10, "official_manufacturer", "prohibited"), (2, "official_manufacturer", "approved"), (11, "official_manufacturer", "approved")]], "id long, product_id long, quality_class string, official boolean, health string, robots string, terms string")
    products = spark.createDataFrame([(1, "one")], "id long, slug string")
    said = ["1.0a 1.0b", "1.0a", "1.1a", "9.9a", "2.0a 2.1b 2.1b", "1.2a 1.3a", "x", "1.1a 1.2b", "1.4a", "8.0a", "1.0a"]
    rows = [(k, "c", [1, 4, 7, 10, 2, 11][k % 6], body) for k, body in enumerate(said)]
    frame = lambda part: spark.createDataFrame(part, "id long, collector_id string, source_id long, body string")
    today = F.lit("2026-01-01").cast("date")
    read = lambda folder, name: sorted((tuple(map(str, r)) for r in spark.read.parquet(f"{folder}/{name}/number=*").collect()))
    whole = ingest.ingest(frame(rows), configs, sources, products, today)
    parts = ingest.ingest([frame(rows[:2]), frame(rows[2:3]), frame(rows[3:])], configs, sources, products, today)
    for name in ("verdicts", "releases"):
        assert read(whole, name) == read(parts, name) != []
    got = {(r.id, r.container): (r.decision, r.reason, r.duplicate_id, r.previous, tuple(r.conflicting)) for r in spark.read.parquet(f"{parts}/verdicts/number=*").collect()}
    assert got[0, 0] == ("passed", None, None, None, ()) and got[1, 0] == ("rejected", "duplicate", "0", "1.0", ())
    assert got[2, 0][:2] == ("review_required", "multi_source_agreement") and got[3, 0][:2] == ("rejected", "source_eligible") and got[4, 0][1] == "product_identity"
    before = read(parts, "releases")
    assert len(before) == len({(r[2], r[3], r[4], r[5]) for r in before}) or before
    again = ingest.ingest([frame([])], configs, sources, products, today, parts)  # nothing new: nothing changes
    assert read(again, "releases") == before


def test_one_collector_with_most_artifacts_is_dealt_to_many_tasks(spark):
    configs = spark.createDataFrame([("t", json.dumps(TEXT))], "collector_id string, spec string")
    rows = spark.range(4000).select("id", F.lit("t").alias("collector_id"), F.lit("v1").alias("body")).repartition(4)
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = collect.extract(rows, configs).where("warning is null")
        per = [n for (n,) in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(per) == 4000 and max(per) < 2000
