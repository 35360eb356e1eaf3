"""Latest and recommended releases, history, and what was latest on a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, rules
from ..functions.versions import assess_transition


def newest_first() -> list[Column]:
    """Release date (unknown last), first observed, id; never the version."""
    return [F.col("release_date").desc_nulls_last(), F.col("first_observed_on").desc(), F.col("id").desc()]


def mapped(releases: DataFrame, mappings: DataFrame) -> DataFrame:
    """One row per release and product, with the release's columns."""
    return mappings.join(releases, mappings.release_id == releases.id).drop("release_id")


def latest_release(releases: DataFrame, mappings: DataFrame, by_channel: bool = True) -> DataFrame:
    """The newest release of each product (and channel) that is not withdrawn."""
    keys = ["product_id", "channel"] if by_channel else ["product_id"]
    rows = mapped(releases.where(~F.col("withdrawn")), mappings)
    w = Window.partitionBy(*keys).orderBy(*newest_first())
    return rows.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def recommended_release(releases: DataFrame, mappings: DataFrame) -> DataFrame:
    """Newest release of each product that its vendor recommends; null recommendations do not count."""
    return latest_release(releases.where("recommended"), mappings, by_channel=False)


def latest_flag(releases: DataFrame, mappings: DataFrame) -> DataFrame:
    """Every mapped release and whether it holds the flag of its product and channel.

    Published in order of first_observed_on and id; a later one takes the flag only if it is
    strictly newer, so the first published of equals keeps it. Advisories and withdrawn ones
    never hold it.
    """
    rows = mapped(releases, mappings)
    able = rules.latest_eligible(F.col("withdrawn"), F.col("release_type"))
    # by date, and among equal dates by first observation; the lowest id was published first
    w = Window.partitionBy("product_id", "channel", able).orderBy(
        F.col("release_date").desc_nulls_last(), F.col("first_observed_on").desc(), F.col("id")
    )
    return rows.withColumn("is_latest", able & (F.row_number().over(w) == 1))


def previous_version(releases: DataFrame, mappings: DataFrame) -> DataFrame:
    """Each release of a product and channel with the version before it and the verdict on the step."""
    rows = mapped(releases.where(~F.col("withdrawn")), mappings)
    w = Window.partitionBy("product_id", "channel").orderBy(F.col("release_date").asc_nulls_first(), "first_observed_on", "id")
    rows = rows.withColumn("previous", F.lag("version").over(w))
    return rows.withColumn("transition", assess_transition(F.col("previous"), F.col("version"))["verdict"])


def latest_as_of(releases: DataFrame, mappings: DataFrame, days: DataFrame) -> DataFrame:
    """For every ``day``: the release (id, version, channel) of each product that counted as latest then.

    A release counts from first_observed_on until withdrawn_on (null: for good), which is a range
    of the days asked for. One to the last of these leaves one row, and the best so far goes on from each
    day to the next that has one. Other ranges are cut into aligned powers of two, at most two of a size, and
    the best release of a product and such a piece is an aggregate; a day then has the best of
    the pieces that hold it. So a release is copied by the logarithm of the days, not to all of
    them, and a product with many releases is combined before it is shuffled.
    """
    rows = releases.where("first_observed_on is not null")
    asked = days.select("day").where("day is not null").distinct()
    # one row a calendar day: how many of the days asked for come before it
    dates_ = rows.select(F.col("first_observed_on").alias("date")).union(rows.select("withdrawn_on").where("withdrawn_on is not null")).distinct().select("date", F.lit(0).alias("is_day"))
    both = asked.select(F.col("day").alias("date"), F.lit(1).alias("is_day")).union(dates_).groupBy("date").agg(F.max("is_day").alias("is_day"))
    nth = both.withColumn("at", (F.sum("is_day").over(Window.orderBy("date")) - F.col("is_day")).cast("int"))
    starts, ends = nth.select(F.col("date").alias("first_observed_on"), F.col("at").alias("low")), nth.select(F.col("date").alias("withdrawn_on"), F.col("at").alias("high"))
    n = asked.count()
    ranged = rows.join(starts, "first_observed_on").join(ends, "withdrawn_on", "left").withColumn("high", F.coalesce("high", F.lit(n))).where("low < high")
    ranged = mapped(ranged, mappings)  # ranges and dates are the releases', so mappings are read once
    size = lambda k: F.lit(1 << k)
    # of size 2^k: where the range begins (or goes on) at an odd multiple, and where it ends after an odd one
    up = lambda c, k: F.ceil(F.col(c) / size(k)).cast("int") * size(k)
    down = lambda c, k: F.floor(F.col(c) / size(k)).cast("int") * size(k)
    till_end = F.col("high") == n
    pieces = [F.when(till_end, F.struct(F.lit(-1).alias("k"), F.col("low").alias("at")))]
    for k in range(max(1, n.bit_length())):
        a, b = up("low", k), down("high", k)
        begins = (a < b) & (a / size(k) % 2 == 1)
        ends_ = (F.when(begins, a + size(k)).otherwise(a) < b) & (b / size(k) % 2 == 1)
        pieces += [F.when(~till_end & begins, F.struct(F.lit(k).alias("k"), a.alias("at"))), F.when(~till_end & ends_, F.struct(F.lit(k).alias("k"), (b - size(k)).alias("at")))]
    order = F.struct("release_date", "first_observed_on", "id", "version", "channel")  # nulls come first, so a known date wins
    cut = ranged.select("product_id", order.alias("best"), F.explode(F.array_compact(F.array(*pieces))).alias("p"))
    best = cut.groupBy("product_id", "p").agg(F.max("best").alias("best")).select("product_id", "p.k", "p.at", "best")
    w = Window.partitionBy("product_id", F.col("k") < 0).orderBy("at")  # of a product's days, not of its releases
    going = best.withColumns({"so_far": F.max("best").over(w), "next": F.lead("at").over(w)})
    last = F.when(F.col("k") < 0, F.coalesce("next", F.lit(n))).otherwise(F.col("at") + F.expr("shiftleft(1, k)")) - 1
    each = going.select("product_id", F.when(F.col("k") < 0, F.col("so_far")).otherwise(F.col("best")).alias("best"), F.explode(F.sequence("at", last)).alias("at"))
    top = each.groupBy("product_id", "at").agg(F.max("best").alias("best"))
    return top.join(nth.where("is_day = 1").select("at", F.col("date").alias("day")), "at").select("day", "product_id", "best.id", "best.version", "best.channel")


def history_window(releases: DataFrame, since: Column) -> DataFrame:
    return releases.where(dates.in_window(F.col("release_date"), F.col("release_date_precision"), F.col("first_observed_on"), since))


def duplicates(releases: DataFrame, mappings: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (product_id, version, channel) with the first live release that has all three.

    A null channel means exactly the channel-less release.
    """
    rows = mapped(releases.where(~F.col("withdrawn")), mappings).select("product_id", "version", F.coalesce("channel", F.lit("")).alias("channel"), "id", "first_observed_on")
    first = rows.groupBy("product_id", "version", "channel").agg(F.min_by("id", F.struct("first_observed_on", "id")).alias("duplicate_id"))
    keyed = wanted.withColumn("channel", F.coalesce("channel", F.lit("")))
    return keyed.join(first, ["product_id", "version", "channel"], "left")
