"""SQL functions say what the Column functions say; the table function matches in order."""

from pyspark.sql import functions as F

from quayside.functions import dates, sql, versions


def test_sql_and_columns_agree(spark, sf_dir):
    from quayside.plans.bindings import Model

    sql.register(spark)
    m = Model(spark, sf_dir)
    rows = m.releases.select(
        F.expr("period_end(release_date, release_date_precision)").alias("a"), dates.period_end(F.col("release_date"), F.col("release_date_precision")).alias("b"),
        F.expr("render_partial_date(release_date, release_date_precision)").alias("c"), dates.render(F.col("release_date"), F.col("release_date_precision")).alias("d"),
    )
    assert rows.where("not (a <=> b) or not (c <=> d)").count() == 0
    none = F.lit(None).cast("string")
    rows = m.candidates.select(
        F.expr("normalize_version(raw_version)").alias("a"), versions.normalize_version(F.col("raw_version")).alias("b"),
        F.expr("normalize_alias(hint)").alias("c"), versions.normalize_alias(F.col("hint")).alias("d"),
        F.expr("dedupe_key(hint, 'v', channel, null, null, null)").alias("e"), versions.dedupe_key(F.col("hint"), F.lit("v"), F.col("channel"), none, none, none).alias("f"),
    )
    assert rows.where("not (a <=> b) or not (c <=> d) or not (e <=> f)").count() == 0


def test_extract_releases(spark):
    sql.register(spark)
    got = spark.sql(r"SELECT e.* FROM VALUES ('v1 and v22'), (null) AS t(body), LATERAL extract_releases(t.body, 'v([0-9]+)') e").collect()
    assert [(r.container, r.version) for r in got] == [(0, "1"), (1, "22")]


def test_latest_by(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (1, "c", 2)], "k int, v string, t int")
    assert rows.groupBy("k").agg(sql.latest_by("v", F.col("t")).alias("v")).first().v == "b"
