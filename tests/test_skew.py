"""Joins in which most rows have no key."""

import datetime as dt
import random

from pyspark.sql import functions as F

from quayside.operators import catalog, frames, gates, summary
from quayside.sources import registry_docs


def test_rows_without_a_key_are_dealt_to_many_tasks(spark):
    rows = spark.range(8000).select("id", F.when(F.col("id") % 8 == 0, F.col("id") % 5).alias("k"), F.lit("a").alias("c"))
    table = spark.createDataFrame([(0, "a", "x"), (1, "b", "y"), (None, "a", "z")], "k long, c string, v string")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = frames.left_by(rows, table, "k", "c")
        per = [n for (n,) in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert sum(per) == 8000 and max(per) < 4000
        assert out.columns == ["c", "id", "k", "v"] and {(r.k, r.v) for r in out.select("k", "v").distinct().collect()} == {(None, None), (0, "x"), (1, None), (2, None), (3, None), (4, None)}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_hint_by_slug_and_alias(spark):
    products = spark.createDataFrame([(1, 9, "one"), (2, 9, "two"), (3, 9, "three")], "id long, vendor_id long, slug string")
    aliases = spark.createDataFrame([(9, "One", 1), (9, "one!", 1), (9, "Two", 3), (9, "both", 1), (9, "both", 2), (9, "x", 3)], "vendor_id long, alias string, product_id long")
    hints = spark.createDataFrame([(9, h) for h in ("One", "two", "three", "both", "X", "no", None, "X")], "vendor_id long, hint string")
    got = sorted((str(r.hint), r.status, r.product_id) for r in catalog.resolved(hints, products, aliases).collect())
    assert got == [("None", "no_match", None), ("One", "unique", 1), ("X", "unique", 3), ("X", "unique", 3), ("both", "ambiguous", None), ("no", "no_match", None), ("three", "unique", 3), ("two", "ambiguous", None)]


def test_outcomes_as_columns_equal_the_pivot(spark):
    every = [[(g, "passed") for g in gates.GATES], [("product_identity", "rejected")], [("product_identity", "review_required"), ("version_present", "rejected")]]
    verdicts = spark.createDataFrame([(k, g) for k, g in enumerate(every)], "id long, gates array<struct<gate:string,outcome:string>>")
    told = lambda rows: sorted(map(tuple, rows.select("id", *gates.GATES).collect()))
    assert told(gates.gate_columns(verdicts, ["id"])) == told(gates.pivot(gates.gate_results(verdicts, ["id"]), ["id"]))


def test_registry_documents_of_one_task_are_dealt_to_many(spark):
    files = spark.range(2000).selectExpr("concat('kind: Product\nslug: p', id, '\n---\nkind: Vendor\nslug: v\n') as value").coalesce(1)
    out = registry_docs.parse(files, "Product", "slug string")
    per = [n for (n,) in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(per) == out.select("slug").distinct().count() == 2000 and max(per) < 1000


def test_mappings_are_dealt_by_release_once(spark, sf_dir):
    from quayside.plans.bindings import Model

    m = Model(spark, sf_dir)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        at = m.dealt_mappings.withColumn("at", F.spark_partition_id()).cache()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert at.select("at").distinct().count() == 7
    assert at.groupBy("release_id").agg(F.count_distinct("at").alias("n")).where("n > 1").count() == 0
    assert at.count() == at.select("release_id", "product_id").distinct().count() == m.lineitem.select("l_orderkey", "l_partkey").distinct().count()


def test_stats_need_no_distinct_count_after_the_join(spark):
    releases = spark.createDataFrame([(1, False, "a"), (1, False, "b"), (2, False, None), (3, True, "z"), (None, False, "y")], "id long, withdrawn boolean, last_verified_on string")
    maps = spark.createDataFrame([(1, 7), (1, 7), (2, 7), (3, 7), (2, 8), (3, 9), (1, None), (None, 7)], "release_id long, product_id long")
    out = summary.stats(releases, maps)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(7, 2, "b"), (8, 1, None), (None, 1, "b")], key=str)
    assert "distinct" not in out._jdf.queryExecution().executedPlan().toString()


def test_sources_of_a_product_are_told_apart_by_id(spark):
    releases = spark.createDataFrame([(1, False, 1), (2, False, 2), (3, True, 3), (4, False, 9)], "id long, withdrawn boolean, evidence_id long")
    evidence = spark.createDataFrame([(1, 5), (2, 6), (3, 7), (9, None)], "id long, source_id long")
    sources = spark.createDataFrame([(5, "b", "u", "t", True), (6, "a", "u", "t", True), (6, "a", "u", "t", True), (7, "c", "u", "t", True)], "id long, slug string, url string, source_type string, official boolean")
    out = summary.official_sources(releases, spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, 1), (4, 2), (1, 3)], "release_id long, product_id long"), evidence, sources)
    assert {r.product_id: [x.slug for x in r.official_sources] for r in out.collect()} == {1: ["a", "b"], 3: ["b"]}
    keys = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [product_id" in keys and not any("Aggregate [" in line and "url" in line.split("]")[0] for line in keys.splitlines())


def test_facts_of_a_subject_meet_the_releases_once(spark):
    releases = spark.createDataFrame([(1, "1", "a", None, "2024-01-01", False), (2, "2", "a", "2024-01-02", "2024-01-03", False), (3, "2", "a", "2024-01-01", "2024-01-02", False), (4, None, "a", "2024-01-09", "2024-01-09", False), (5, "9", "a", "2025-01-01", "2025-01-01", True)], "id long, version string, channel string, release_date string, first_observed_on string, withdrawn boolean")
    maps = spark.createDataFrame([(r, 1) for r in (1, 2, 3, 5)] + [(r, 2) for r in (2, 4)] + [(4, 3)], "release_id long, product_id long")
    sources = spark.createDataFrame([], "id long, quality_class string, enabled boolean, health string, robots string, terms string")
    claims = spark.createDataFrame([], "source_id long, product_id long, channel string, version string, release_date date, observed_on date, order_id long, line_no int")
    out = gates.subject_facts(sources, releases, maps, claims)
    got = {r.product_id: (sorted(tuple(v) for v in r.versions), r.previous) for r in out.collect()}
    assert got == {1: ([("1", 1), ("2", 3)], "2"), 2: ([("2", 2)], None), 3: ([], None)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD [release_id") == 1


def gate_tables(spark, rng):
    """Small tables in which every gate has every outcome, with nulls in what may be null."""
    some, n = lambda *of: rng.choice(of), 1500
    day = lambda: some(None, dt.date(1989, 1, 1), dt.date(1998, 5, 1), dt.date(1999, 6, 1))
    product = lambda: some(None, None, 1, 2, 3, 4)
    sources = [(k, k % 3, some("official_manufacturer", "trusted_community", None), some(True, False, None), some("active", "active", "broken", None), some("allowed", "allowed", "disallowed", None), "approved", some(True, True, False)) for k in range(40)]
    products = [(k, k % 3, some(f"Slug-{k}", f"slug-{k}", "two", None)) for k in range(1, 7)]
    aliases = [(some(0, 1, 2, None), some("Slug 1", "slug-2!", "two", "Three", "", None), k % 6 + 1) for k in range(30)]
    releases = [(k, some("v1", "v1.2", "2", "x", None), some("a", "b", "c", None), some(True, False, None), day(), dt.date(1997, 1, 1 + k % 9)) for k in range(200)]
    maps = [(k, some(1, 2, 3, 4, None)) for k in range(200)]
    claims = [(rng.randrange(40), some(1, 2, 3, 4), some("a", "b", None), some("v1", "v2", " "), day(), dt.date(1997, 1, 1), k, 1) for k in range(150)]
    rows = [(k, some(*range(41)), some("SLUG-1", "slug-2", " two ", "three", "no", "", None), product(), some(" V1 ", "v1.2", "V9", "2", "", None), some("a", "a", "b", None), day(), some("exact_day", "unknown", None), some(None, "0.80", "0.95"), some(None, 1, 1, 1)) for k in range(n)]
    make = spark.createDataFrame
    return (
        make(rows, "id long, source_id long, hint string, product_id long, raw_version string, channel string, release_date date, release_date_precision string, confidence string, evidence_id long").withColumn("confidence", F.col("confidence").cast("decimal(3,2)")),
        make(sources, "id long, vendor_id long, quality_class string, official boolean, health string, robots string, terms string, enabled boolean"), make(products, "id long, vendor_id long, slug string"),
        make(aliases, "vendor_id long, alias string, product_id long"), make(releases, "id long, version string, channel string, withdrawn boolean, release_date date, first_observed_on date"), make(maps, "release_id long, product_id long"),
        make(claims, "source_id long, product_id long, channel string, version string, release_date date, observed_on date, order_id long, line_no long"),
    )


def test_verdicts_look_up_only_what_a_gate_needs_that_runs(spark, monkeypatch):
    met, by = [], gates.left_by
    today, tables = F.lit("1999-01-01").cast("date"), gate_tables(spark, random.Random(5))
    names = ["id", "raw_version", "decision", "reason", "gates", "first_review"]
    told = lambda rows: sorted((tuple(r) for r in rows.select(names).collect()), key=lambda r: r[0])
    want = told(gates.validate_candidates(gates.gate_context(*tables), today))
    assert {(r[2], r[3]) for r in want} >= {("rejected", g) for g in ("product_identity", "version_present", "source_eligible", "duplicate", "date_valid", "evidence_retained")} | {("passed", None), ("review_required", "multi_source_agreement")}
    monkeypatch.setattr(gates, "left_by", lambda rows, *rest: met.append(rows) or by(rows, *rest))
    for channels in (None, spark.createDataFrame([("a",), ("b",), ("b",), ("z",)], "channel string")):
        assert told(gates.verdicts(*tables, today, ("raw_version",), channels=channels)) == want
        assert told(gates.verdicts(*tables, today, ("raw_version",), True, channels)) == [r for r in want if r[2] != "rejected"]
    # all candidates, and of those that may be open fewer; with a subject only those of eligible sources and of a version
    every, some = (rows.select("id", "subject_id").collect() for rows in met[:2])
    stopped = {r[0] for r in want if r[3] in ("product_identity", "version_present", "source_eligible")}
    assert len(every) == len(want) > 2 * len(some) and not any(r.subject_id is not None and r.id in stopped for r in every)
    # releases of channels that nobody asks for are of no subject
    facts = gates.subject_facts(tables[1], *tables[4:], channels=spark.createDataFrame([("b",)], "channel string")).where("versions is not null")
    assert {r.channel for r in facts.collect()} == {"b"}
    assert gates.subject_facts(tables[1], *tables[4:], channels=spark.createDataFrame([("z",)], "channel string")).where("versions is not null").count() == 0


def test_a_written_table_leaves_no_shuffle_files(spark):
    conf, before = spark.conf, spark.conf.get(frames.CLEAN, None)
    out = frames.written(spark.range(5000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).agg(F.count("*").alias("n"), F.max(F.struct("id")).alias("last")), "tens")
    assert sorted((r.k, r.n, r.last.id) for r in out.collect()) == [(k, 500, 4990 + k) for k in range(10)]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString() and conf.get(frames.CLEAN, None) == before
