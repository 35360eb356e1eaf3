"""Column functions for text, search and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_EXCERPT_BYTES, MAX_QUERY_BYTES, PRIVATE_CHARS = 4000, 200, 48
ELLIPSIS = "…"


def cut_bytes(text: Column, most: int) -> Column:
    """The longest prefix of at most ``most`` UTF-8 bytes that ends between characters."""
    raw = F.encode(text, "UTF-8")
    head = F.substring(raw, 1, most)
    # a cut inside a character leaves a replacement mark at the end, and only there
    whole = F.substring(F.hex(F.substring(raw, most + 1, 1)), 1, 1).isin("8", "9", "A", "B")
    back = F.regexp_replace(F.hex(head), "(F[0-9A-F]|E[0-9A-F]|[CD][0-9A-F])([89AB][0-9A-F]){0,2}$", "")
    return F.decode(F.when(whole, F.unhex(back)).otherwise(head), "UTF-8")


def truncate_excerpt(text: Column) -> Column:
    """Trimmed, at most 4,000 bytes with the ellipsis that marks a cut."""
    t = F.trim(text)
    return F.when(F.octet_length(t) <= MAX_EXCERPT_BYTES, t).otherwise(F.concat(cut_bytes(t, MAX_EXCERPT_BYTES - 3), F.lit(ELLIPSIS)))


def truncate_query(text: Column) -> Column:
    """Trimmed, at most 200 bytes; null under two characters."""
    t = F.trim(text)
    return F.when(F.length(t) >= 2, F.when(F.octet_length(t) <= MAX_QUERY_BYTES, t).otherwise(cut_bytes(t, MAX_QUERY_BYTES)))


def normalize_search_text(text: Column) -> Column:
    """Lower case, one space between words, cut to 48 characters."""
    return F.left(F.trim(F.regexp_replace(F.lower(text), r"[\s\p{Z}]+", " ")), F.lit(PRIVATE_CHARS))


def collapse_whitespace(text: Column) -> Column:
    """Without zero-width characters; every run of white space is one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x{200B}\x{200C}\x{200D}\x{FEFF}]", ""), r"[\s\p{Z}]+", " "))


def looks_generated(text: Column) -> Column:
    """A value that a template engine makes: UUID, eight or more hex digits, or a token that
    mixes three digits with three letters."""
    uuid = text.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")
    mixed = (F.regexp_count(text, F.lit("[0-9]")) >= 3) & (F.regexp_count(text, F.lit("[A-Za-z]")) >= 3) & ~text.rlike(r"\s")
    return uuid | text.rlike("^[0-9a-fA-F]{8,}$") | text.rlike("^:r[0-9a-z]+:$") | mixed


def media_type(header: Column) -> Column:
    return F.lower(F.trim(F.substring_index(header, ";", 1)))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each word, padded with two spaces before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    each = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(each))


def similarity(a: Column, b: Column) -> Column:
    """Shared over all distinct trigrams of two arrays; 0 if neither has any."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def sorted_set(values: Column) -> Column:
    """Distinct values that are not blank, in order."""
    return F.array_sort(F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (F.trim(x) != ""))))


def merge_participants(own: Column, others: Column) -> Column:
    return sorted_set(F.concat(F.array(own), others))


def lookup(values: dict, key: Column, default) -> Column:
    """A small fixed table as an expression."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key], F.lit(default))
