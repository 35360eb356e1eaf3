"""Partial dates: an anchor (first day of the period) and a precision; columns come in pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Years that a date may have.
FIRST_YEAR, LAST_YEAR = 1970, 2200


def known(anchor: Column, precision: Column) -> Column:
    return anchor.isNotNull() & (F.coalesce(precision, F.lit("unknown")) != "unknown")


def period_end(anchor: Column, precision: Column) -> Column:
    """Last day of the day, month or year; null if unknown."""
    return (
        F.when(precision == "exact_day", anchor)
        .when(precision == "month_only", F.last_day(anchor))
        .when(precision == "year_only", F.make_date(F.year(anchor), F.lit(12), F.lit(31)))
    )


def render(anchor: Column, precision: Column) -> Column:
    """At the stored precision; empty if unknown."""
    text = (
        F.when(precision == "exact_day", F.date_format(anchor, "yyyy-MM-dd"))
        .when(precision == "month_only", F.date_format(anchor, "yyyy-MM"))
        .when(precision == "year_only", F.date_format(anchor, "yyyy"))
    )
    return F.coalesce(text, F.lit(""))


def label(anchor: Column, precision: Column) -> Column:
    """For readers: 4 September 2026, September 2026, 2026."""
    text = (
        F.when(precision == "exact_day", F.date_format(anchor, "d MMMM yyyy"))
        .when(precision == "month_only", F.date_format(anchor, "MMMM yyyy"))
        .when(precision == "year_only", F.date_format(anchor, "yyyy"))
    )
    return F.coalesce(text, F.lit("Release date not published"))


def parse(text: Column) -> Column:
    """struct(anchor, precision) of YYYY, YYYY-MM or YYYY-MM-DD; unknown if empty, null if invalid."""
    t = F.trim(F.coalesce(text, F.lit("")))
    full = F.when(t.rlike("^[0-9]{4}$"), F.concat(t, F.lit("-01-01"))).when(t.rlike("^[0-9]{4}-[0-9]{2}$"), F.concat(t, F.lit("-01"))).when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), t)
    day = F.try_to_date(full, "yyyy-MM-dd")
    kind = F.when(F.length(t) == 4, "year_only").when(F.length(t) == 7, "month_only").otherwise("exact_day")
    return F.when(t == "", F.struct(F.lit(None).cast("date").alias("anchor"), F.lit("unknown").alias("precision"))).when(
        F.year(day).between(FIRST_YEAR, LAST_YEAR), F.struct(day.alias("anchor"), kind.alias("precision"))
    )


def parse_with_layout(text: Column, layout: str, precision: str = "exact_day") -> Column:
    """struct(anchor, precision) by a named layout, cut to ``precision``.

    ``epoch_seconds`` reads a count; any other layout is a Spark date pattern for the day that
    the vendor printed, whatever its offset. What does not parse is unknown.
    """
    day = F.to_date(F.timestamp_seconds(F.trim(text).try_cast("bigint"))) if layout == "epoch_seconds" else F.try_to_date(F.trim(text), layout)
    cut = {"exact_day": day, "month_only": F.trunc(day, "month"), "year_only": F.trunc(day, "year")}[precision]
    return F.struct(cut.alias("anchor"), F.when(day.isNull(), "unknown").otherwise(precision).alias("precision"))


def in_window(anchor: Column, precision: Column, first_observed: Column, since: Column) -> Column:
    """Whether a release is inside a history window: its period ends on or after the day of
    ``since``; undated ones go by when they were first observed. No ``since``: always."""
    by_date = period_end(anchor, precision) >= since.cast("date")
    return since.isNull() | F.when(known(anchor, precision), by_date).otherwise(first_observed >= since)


def window_start(plan: Column, now: Column, months: int = 12) -> Column:
    """Free and anonymous plans see twelve months; others have no limit (null)."""
    return F.when(plan.isin("anonymous", "free"), F.add_months(now, -months))


def retry_after_seconds(header: Column, now: Column) -> Column:
    """Seconds to wait by a Retry-After header: a count, or an HTTP date against ``now`` (epoch
    seconds); never negative; null if it is neither."""
    date = F.unix_seconds(F.try_to_timestamp(F.regexp_replace(F.trim(header), "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss 'GMT'")))
    seconds = F.coalesce(F.trim(header).try_cast("bigint"), date - now)
    return F.when(seconds.isNotNull(), F.greatest(seconds, F.lit(0).cast("bigint")))
