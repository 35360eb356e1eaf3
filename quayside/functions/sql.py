"""The functions that SQL users call by name, and the extraction table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

# SQL bodies, so that Catalyst inlines them; they say what the Column functions of the same names do.
FUNCTIONS = {
    "normalize_version(raw STRING) RETURNS STRING": r"""
        CASE WHEN trim(regexp_replace(raw, '[\\s\\p{Z}]+', ' ')) <> '' AND octet_length(trim(regexp_replace(raw, '[\\s\\p{Z}]+', ' '))) <= 200
        THEN lower(trim(regexp_replace(raw, '[\\s\\p{Z}]+', ' '))) END""",
    "period_end(anchor DATE, precision STRING) RETURNS DATE": """
        CASE precision WHEN 'exact_day' THEN anchor WHEN 'month_only' THEN last_day(anchor)
        WHEN 'year_only' THEN make_date(year(anchor), 12, 31) END""",
    "render_partial_date(anchor DATE, precision STRING) RETURNS STRING": """
        coalesce(CASE precision WHEN 'exact_day' THEN date_format(anchor, 'yyyy-MM-dd') WHEN 'month_only' THEN date_format(anchor, 'yyyy-MM')
        WHEN 'year_only' THEN date_format(anchor, 'yyyy') END, '')""",
    "normalize_alias(name STRING) RETURNS STRING": r"trim(regexp_replace(lower(name), '[^\\p{L}\\p{Nd}]+', ' '))",
    "dedupe_key(hint STRING, version STRING, channel STRING, hardware STRING, region STRING, mode STRING) RETURNS STRING": """
        substring(sha2(concat_ws(chr(31), lower(trim(coalesce(hint, ''))), coalesce(version, ''), lower(trim(coalesce(channel, ''))),
        lower(trim(coalesce(hardware, ''))), lower(trim(coalesce(region, ''))), lower(trim(coalesce(mode, '')))), 256), 1, 32)""",
}


@udtf(returnType="container int, version string")
class ExtractReleases:
    """``extract_releases(body, pattern)``: one row for each match of a pattern's first group."""

    def eval(self, body: str, pattern: str) -> Iterator[tuple[int, str]]:
        import re

        for k, m in enumerate(re.finditer(pattern, body or "")):
            yield k, m.group(1)


def register(spark: SparkSession) -> None:
    """Make every function, and the table function, known to SQL in this session."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("extract_releases", ExtractReleases)


def latest_by(value: str, *order: Column) -> Column:
    """The value that stands in the row which is last by ``order``."""
    return F.max_by(value, F.struct(*order))
