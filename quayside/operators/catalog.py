"""Joins over the catalogue: categories, aliases, coverage, relations, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.versions import normalize_alias
from .frames import checkpoint


def category_array(bridge: DataFrame, categories: DataFrame) -> DataFrame:
    """product_id and its category slugs in order."""
    rows = bridge.join(categories, bridge.category_id == categories.id)
    return rows.groupBy("product_id").agg(F.sort_array(F.collect_list("slug")).alias("category_slugs"))


def category_ancestors(categories: DataFrame) -> DataFrame:
    """``id``, ``ancestor`` and ``steps`` (the fewest) for every category (id, parent_id) and each above it.

    Paths are joined to paths, so a chain of any length takes rounds by its logarithm. A
    category in a cycle is an ancestor of its own, and so a row with ``id = ancestor``: that is
    how cycles are reported. Parents that are no category themselves are ancestors too.
    """
    paths = checkpoint(categories.where("parent_id is not null").select("id", F.col("parent_id").alias("ancestor"), F.lit(1).alias("steps")).distinct())
    known = paths.count()
    while known:
        further = paths.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("above"), F.col("steps").alias("more"))
        longer = paths.join(further, "ancestor").select("id", F.col("above").alias("ancestor"), (F.col("steps") + F.col("more")).alias("steps"))
        paths = checkpoint(paths.union(longer).groupBy("id", "ancestor").agg(F.min("steps").alias("steps")))
        before, known = known, paths.count()
        if known == before:
            break
    return paths


def alias_resolution(hints: DataFrame, products: DataFrame, aliases: DataFrame) -> DataFrame:
    """``hints`` (hint, vendor_id) with how each resolves: unique, ambiguous or no_match.

    A hint is a product's slug, or equals one of its aliases once both are normalised. Hints are
    made distinct before joining.
    """
    return resolved(hints.select("vendor_id", "hint").distinct(), products, aliases)


def resolved(rows: DataFrame, products: DataFrame, aliases: DataFrame, hint: Column | None = None, deal: str | None = None) -> DataFrame:
    """``rows`` (vendor_id, and a ``hint``) with status and product_id of what each one's hint names.

    Slugs and aliases are told by their normalised text, in which a slug that equals a hint is equal too: one row
    for each, with how many products it may be and the smallest, also for each slug. So rows pass once, as they are.
    Rows without a hint are dealt by ``deal``, if given, as they may be many.
    """
    hint = F.col("hint") if hint is None else hint
    # a text in lower case is its normalised text and what parts the words of it
    parts = lambda text: F.regexp_replace(text, r"[\p{L}\p{Nd}]+", "x")
    slugs = products.where(F.col("slug") == F.lower("slug")).select("vendor_id", normalize_alias(F.col("slug")).alias("_s"), parts(F.col("slug")).alias("_parts"), F.col("id").alias("product_id"))
    names = aliases.select("vendor_id", normalize_alias(F.col("alias")).alias("_s"), F.lit(None).cast("string").alias("_parts"), "product_id").where("_s <> ''")
    # dealt once: all that is counted of a text is counted where it is
    each = slugs.union(names).repartition("vendor_id", "_s").distinct()
    each = each.groupBy("vendor_id", "_s", "_parts").agg(F.count("product_id").alias("n"), F.min("product_id").alias("p"))
    told = each.groupBy("vendor_id", "_s").agg(
        F.max(F.when(F.col("_parts").isNull(), F.struct("n", "p"))).alias("_named"), F.collect_list(F.when(F.col("_parts").isNotNull(), F.struct("_parts", "n", "p"))).alias("_slugs")
    )
    name = normalize_alias(hint)
    if deal is not None:  # no normalised text has this sign
        name = F.coalesce(name, F.concat(F.lit("#"), F.pmod(F.xxhash64(deal), F.lit(1 << 20)).cast("string")))
    rows = rows.withColumns({"_s": name, "_parts": parts(F.lower(F.trim(hint)))}).join(told, ["vendor_id", "_s"], "left")
    slug = F.try_element_at(F.filter("_slugs", lambda x: x["_parts"] == F.col("_parts")), F.lit(1))
    n0, n1 = F.coalesce(slug["n"], F.lit(0)), F.coalesce("_named.n", F.lit(0))
    unique = (n0 + n1 == 1) | (n0 == 1) & (n1 == 1) & (slug["p"] == F.col("_named.p"))
    status = F.when(n0 + n1 == 0, "no_match").when(unique, "unique").otherwise("ambiguous")
    found = F.when(n0 > 0, slug["p"]).otherwise(F.col("_named.p"))
    return rows.withColumns({"status": status, "product_id": F.when(unique, found)}).drop("_s", "_parts", "_named", "_slugs")


def covered_products(sources: DataFrame, source_products: DataFrame, products: DataFrame) -> DataFrame:
    """Products that a source covers: stated ones, its own product, and members of its family."""
    stated = source_products.select("source_id", "product_id")
    own = sources.where("product_id is not null").select(F.col("id").alias("source_id"), "product_id").join(products.select(F.col("id").alias("product_id")), "product_id", "left_semi")
    family = sources.select(F.col("id").alias("source_id"), "family", "vendor_id").join(products.select(F.col("id").alias("product_id"), "family", "vendor_id"), ["family", "vendor_id"]).select("source_id", "product_id")
    return stated.union(own.select("source_id", "product_id")).union(family).distinct()


def edges(relationships: DataFrame, products: DataFrame) -> DataFrame:
    """What each device runs, as an array of structs in order of the target's slug."""
    target = products.select(F.col("id").alias("to_product_id"), "slug", "name")
    rows = relationships.join(target, "to_product_id")
    return rows.groupBy("from_product_id").agg(F.sort_array(F.collect_list(F.struct("slug", "name", F.col("relation_kind").alias("kind")))).alias("runs"))


def release_read(releases: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Releases with the evidence and source behind them; a source that is gone leaves nulls."""
    ev = evidence.select(F.col("id").alias("evidence_id"), "source_id")
    src = sources.select(F.col("id").alias("source_id"), F.col("slug").alias("source_slug"), "url", "source_type", "official")
    return releases.join(ev, "evidence_id", "left").join(src, "source_id", "left")
