"""Claims of sources about products, and where they disagree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import sorted_set

SUBJECT = ["product_id", "channel"]


def with_source(observations: DataFrame, sources: DataFrame) -> DataFrame:
    """Observations with their source's rank and whether it is eligible."""
    s = sources.select(
        F.col("id").alias("source_id"), rules.authority_rank(F.col("quality_class")).alias("rank"),
        rules.source_eligible(F.col("enabled"), F.col("health"), F.col("robots"), F.col("terms")).alias("eligible"),
    )
    return observations.join(s, "source_id")


def current_observation(observations: DataFrame) -> DataFrame:
    """The claim that stands for each source, product and channel.

    Dated claims beat undated ones, then the later date, then the later observation; the
    remaining columns break exact ties. first_observed_on is the earliest of all.
    """
    key = ["source_id", *SUBJECT]
    order = Window.partitionBy(*key).orderBy(
        F.col("release_date").desc_nulls_last(), F.col("observed_on").desc(), F.col("version").desc(), F.col("order_id").desc(), F.col("line_no").desc()
    )
    first = F.min("observed_on").over(Window.partitionBy(*key)).alias("first_observed_on")
    return observations.select("*", first, F.row_number().over(order).alias("place")).where("place = 1").drop("place")


def eligible_claims(observations: DataFrame, sources: DataFrame) -> DataFrame:
    """Current claims of eligible sources. Eligibility is the source's, and the source is part
    of a claim's key, so the rest is dropped before the window shuffles anything."""
    able = with_source(observations, sources).where("eligible")
    return current_observation(able).where("trim(version) <> ''")


def classes(claims: DataFrame) -> DataFrame:
    """The verdict on each version and rank that is claimed of a subject, whoever claims it.

    A different version of equal or higher rank conflicts; one of lower rank is outranked. What
    is compared is a subject's versions, of which each has a row for every rank, so the work does
    not grow with the number of sources that say the same.
    """
    sides = claims.groupBy(*SUBJECT, "version", "rank").agg(F.count("*").alias("sources"))
    others = sides.select(*SUBJECT, F.col("version").alias("other_version"), F.col("rank").alias("other_rank"))
    pairs = sides.join(others, SUBJECT).withColumn("differs", F.col("other_version") != F.col("version"))
    worse, equal = F.col("differs") & (F.col("other_rank") < F.col("rank")), F.col("differs") & (F.col("other_rank") >= F.col("rank"))
    found = pairs.groupBy(*SUBJECT, "version", "rank").agg(
        F.max("sources").alias("sources"), F.array_sort(F.collect_set(F.when(equal, F.col("other_version")))).alias("conflicting_versions"),
        F.array_sort(F.collect_set(F.when(worse, F.col("other_version")))).alias("outranked_versions"), F.max(F.when(equal, F.col("other_rank"))).alias("authority_rank"),
    )
    status = F.when(F.size("conflicting_versions") > 0, "unresolved").when(F.size("outranked_versions") > 0, "outranked").otherwise("none")
    return found.withColumn("status", status)


def detect_conflicts(observations: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per current claim of an eligible source: none, outranked or unresolved, with the versions
    that it differs from. The verdict is that of its class; who else is in which class is not
    repeated for every claim."""
    claims = eligible_claims(observations, sources)
    verdicts = classes(claims).drop("sources")
    return claims.select(*SUBJECT, "source_id", "version", "rank").join(verdicts, [*SUBJECT, "version", "rank"])


def open_conflicts(verdicts: DataFrame) -> DataFrame:
    """One open conflict per product and channel, from the claims that are unresolved.

    Of two versions the one of lower or equal rank is unresolved and the other its opponent, so
    all sources of a subject that has an unresolved claim take part.
    """
    out = verdicts.groupBy(*SUBJECT).agg(
        F.bool_or(F.col("status") == "unresolved").alias("hot"), F.array_sort(F.collect_set("version")).alias("versions"),
        sorted_set(F.collect_set(F.col("source_id").cast("string"))).alias("source_ids"), F.max("authority_rank").alias("authority_rank"),
    )
    return out.where("hot").drop("hot")


def reconcile(stored: DataFrame, verdicts: DataFrame) -> DataFrame:
    """What to do with each subject: open, refresh, close (and why), or nothing.

    ``stored`` holds the open conflicts' product_id and channel.
    """
    per = verdicts.groupBy(*SUBJECT).agg(F.bool_or(F.col("status") == "unresolved").alias("hot"), F.bool_or(F.col("status") == "outranked").alias("ranked"))
    both = stored.select(*SUBJECT, F.lit(True).alias("was_open")).join(per, SUBJECT, "full_outer")
    hot, was = F.coalesce("hot", F.lit(False)), F.coalesce("was_open", F.lit(False))
    action = F.when(hot & was, "refresh").when(hot, "open").when(was & F.col("hot").isNotNull(), "close").otherwise("keep")
    why = F.when(action == "close", F.when(F.col("ranked"), "resolved by source authority").otherwise("sources agree"))
    return both.select(*SUBJECT, action.alias("action"), why.alias("resolution"))
