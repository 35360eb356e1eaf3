"""Keyset pages, orders inside a page, and small ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyset(rows: DataFrame, order: list[tuple[str, str]], after: dict[str, Column] | None, limit: int) -> DataFrame:
    """The ``limit`` rows that follow ``after`` in an order of mixed directions."""
    if after:
        beyond, equal = [], F.lit(True)
        for name, way in order:
            step = F.col(name) < after[name] if way == "desc" else F.col(name) > after[name]
            beyond.append(equal & step)
            equal = equal & (F.col(name) == after[name])
        rows = rows.where(reduce(lambda a, b: a | b, beyond))
    return rows.orderBy(*[F.col(n).desc() if way == "desc" else F.col(n).asc() for n, way in order]).limit(limit)


def local_sort(page: DataFrame, descending: bool = False) -> DataFrame:
    """``place`` of each row of one page by date, then observation, then id; unknown dates last."""
    turn = (lambda c: c.desc()) if descending else (lambda c: c.asc())
    date = F.col("release_date").desc_nulls_last() if descending else F.col("release_date").asc_nulls_last()
    # a page is bounded by its limit, so one window over it is too
    w = Window.orderBy(date, turn(F.col("first_observed_on")), turn(F.col("id")))
    return page.withColumn("place", F.row_number().over(w))


def newest(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The ``n`` newest rows of every key, numbered."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n)


def sharing_classes(mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Products with equal releases are a class, named by its smallest product.

    Returns ``product_id``, ``class``, ``within`` (releases that two of its members share), and
    ``c1`` < ``c2``, ``shared`` of the classes that share releases. A release's products meet only
    as classes, so copies of a product cost one row each. Sets are compared by two 64-bit
    hashes and their size, which are partial aggregates: no product's releases are gathered.
    Repeated rows count as often as they occur; null releases and products take no part.
    """
    times = mappings.where("release_id is not null and product_id is not null").groupBy("product_id", "release_id").agg(F.count("*").alias("times"))
    marks = [F.bit_xor(F.xxhash64("release_id", "times", F.lit(k))).alias(f"mark{k}") for k in range(2)]
    sets = times.groupBy("product_id").agg(*marks, F.count("*").alias("releases"), F.sum(F.col("times") * F.col("times")).alias("within"))
    key = ["mark0", "mark1", "releases"]
    heads = sets.groupBy(*key).agg(F.min("product_id").alias("class"))
    members = sets.join(heads, key).select("product_id", "class", "within")
    held = times.join(heads.select(F.col("class").alias("product_id")), "product_id")
    a = held.select("release_id", F.col("product_id").alias("c1"), F.col("times").alias("t1"))
    b = held.select("release_id", F.col("product_id").alias("c2"), F.col("times").alias("t2"))
    pairs = a.join(b, "release_id").where("c1 < c2").groupBy("c1", "c2").agg(F.sum(F.col("t1") * F.col("t2")).alias("shared"))
    return members, pairs


def shared(mappings: DataFrame) -> DataFrame:
    """``p1`` < ``p2`` of the products that share releases, and how many: ``sharing_classes`` with every
    class written out as its members. Where copies are many, use those instead."""
    members, pairs = sharing_classes(mappings)
    first = members.select(F.col("class").alias("c1"), F.col("product_id").alias("a"))
    second = members.select(F.col("class").alias("c2"), F.col("product_id").alias("b"))
    between = pairs.join(first, "c1").join(second, "c2").select(F.least("a", "b").alias("p1"), F.greatest("a", "b").alias("p2"), "shared")
    of = lambda name: members.select("class", F.col("product_id").alias(name), "within")
    inside = of("p1").join(of("p2").drop("within"), "class").where("p1 < p2").select("p1", "p2", F.col("within").alias("shared"))
    return between.union(inside)
