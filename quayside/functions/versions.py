"""Column functions for versions, slugs and keys. Versions are opaque: equality only, no order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_VERSION_BYTES = 200
#: Larger steps of the leading number are suspicious.
LARGEST_STEP = 5


def normalize_version(raw: Column) -> Column:
    """Lower case, runs of white space as one space; null if empty or over 200 bytes after trimming."""
    text = F.trim(F.regexp_replace(raw, r"[\s\p{Z}]+", " "))
    return F.when((text != "") & (F.octet_length(text) <= MAX_VERSION_BYTES), F.lower(text))


def version_tokens(normalized: Column) -> Column:
    """Runs of digits and runs of letters, in order."""
    return F.regexp_extract_all(normalized, F.lit(r"(\p{Nd}+|\p{L}+)"), 1)


def is_number(token: Column) -> Column:
    """A run of digits that fits a 64-bit integer; longer runs are text."""
    return token.rlike(r"^\p{Nd}+$") & token.try_cast("bigint").isNotNull()


def version_skeleton(normalized: Column) -> Column:
    """The tokens with every number as ``#``."""
    return F.array_join(F.transform(version_tokens(normalized), lambda t: F.when(is_number(t), F.lit("#")).otherwise(t)), "")


def leading_number(normalized: Column) -> Column:
    return F.try_element_at(F.filter(version_tokens(normalized), is_number), F.lit(1)).cast("bigint")


def assess_transition(previous: Column, current: Column) -> Column:
    """Struct of verdict and reason. The verdict is plausible, identical, suspicious (leading number
    fell, or rose by over five) or uncomparable (no tokens, or another shape). Null or empty
    ``previous``: plausible."""
    a, b = leading_number(previous), leading_number(current)
    none = F.size(version_tokens(previous)) * F.size(version_tokens(current)) == 0
    shape, then = version_skeleton(previous), version_skeleton(current)
    told = lambda verdict, *reason: F.struct(F.lit(verdict).alias("verdict"), F.concat(*[F.lit(r) if isinstance(r, str) else r.cast("string") for r in reason]).alias("reason"))
    # Verdicts and what a reviewer reads with them.
    return (
        F.when(previous.isNull() | (previous == ""), told("plausible", "no previously observed version for this product and channel"))
        .when(previous == current, told("identical", "identical to the previously observed version"))
        .when(none, told("uncomparable", "one of the versions contains no recognisable tokens"))
        .when(shape != then, told("uncomparable", "version shape changed from ", shape, " to ", then))
        .when(a.isNull() | b.isNull(), told("plausible", "no numeric component to compare"))
        .when(b < a, told("suspicious", "leading numeric component decreased from ", a, " to ", b))
        .when(b > a + LARGEST_STEP, told("suspicious", "leading numeric component jumped from ", a, " to ", b))
        .otherwise(told("plausible", "consistent with the previously observed version"))
    )


def slugify(text: Column) -> Column:
    """Letters a-z and digits; white space and ``-_./+`` as one dash; all else dropped."""
    kept = F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9\s\p{Z}\-_./+]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"[\s\p{Z}\-_./+]+", "-"), "^-|-$", "")


def valid_slug(text: Column) -> Column:
    return text.rlike("^[a-z0-9]+(?:-[a-z0-9]+)*+$")


def normalize_alias(text: Column) -> Column:
    """Lower case letters and digits; everything between them is one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]+", " "))


def dedupe_key(hint: Column, version: Column, *rest: Column) -> Column:
    """First 16 bytes, in hex, of SHA-256 over six parts joined by 0x1F. ``rest``: channel,
    hardware revision, region, deployment mode. The version is normalised already."""
    clean = [F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (hint, *rest)]
    return F.substring(F.sha2(F.concat_ws("\x1f", clean[0], F.coalesce(version, F.lit("")), *clean[1:]), 256), 1, 32)
