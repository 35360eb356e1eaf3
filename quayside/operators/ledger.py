"""Reviewers' decisions and stored candidates as ledgers: what a batch changes, and what follows from that."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.versions import dedupe_key, normalize_version


def change_log(items: DataFrame, decisions: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Every decision with what it changes, or the ``problem`` for which it changes nothing.

    ``items``: id, state, candidate_id, candidate_state, permitted (whether the candidate's source
    may be published from), conflict_id and product_id. ``decisions``: item_id, decision (accept or
    reject), actor, reason, decided_at. The first sound decision on an item that is open counts;
    later ones find it resolved. Decisions that ``stored``, the log so far, has already are left
    out, and items that it has changed are as it left them, so a batch run twice adds nothing.
    """
    key = ["item_id", "decision", "actor", "decided_at"]
    asked = decisions.select("item_id", F.lower(F.trim("decision")).alias("decision"), F.trim("actor").alias("actor"), F.trim("reason").alias("reason"), "decided_at").dropDuplicates(key)
    known = items.select(F.col("id").alias("item_id"), F.col("state").alias("item_before"), "candidate_id", F.col("candidate_state").alias("candidate_before"), "permitted", "conflict_id", "product_id")
    if stored is not None:
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"s.{c}")) for c in key]
        asked = asked.alias("a").join(stored.select(*key).alias("s"), same, "left_anti")
        done = stored.where("problem is null").select("item_id", F.col("item_after").alias("item_now"), F.col("candidate_after").alias("candidate_now"))
        known = known.join(done, "item_id", "left").withColumns({"item_before": F.coalesce("item_now", "item_before"), "candidate_before": F.coalesce("candidate_now", "candidate_before")}).drop("item_now", "candidate_now")
    rows = asked.join(known, "item_id", "left")
    after = F.when(F.col("decision") == "accept", "published").when(F.col("decision") == "reject", "rejected")
    unsound = (
        F.when(F.coalesce("actor", F.lit("")) == "", "no actor").when(F.coalesce("reason", F.lit("")) == "", "no reason").when(after.isNull(), "no such decision")
        .when(F.col("item_before").isNull(), "no such item").when(F.col("item_before").isin("resolved", "dismissed"), "already resolved")
        .when((F.col("decision") == "accept") & ~F.coalesce("permitted", F.lit(False)), "not permitted")
        .when(F.col("candidate_id").isNotNull() & ~rules.legal(rules.CANDIDATE_STATES, F.col("candidate_before"), after), "illegal step")
    )
    rows = rows.withColumn("unsound", unsound)
    turn = F.row_number().over(Window.partitionBy("item_id", F.col("unsound").isNull()).orderBy("decided_at", "actor", "decision"))
    rows = rows.withColumn("problem", F.coalesce("unsound", F.when(turn > 1, "already resolved")))
    good = F.col("problem").isNull()
    release = F.when(good & (F.col("decision") == "accept") & F.col("candidate_id").isNotNull(), F.substring(F.sha2(F.concat(F.lit("release|"), F.col("candidate_id").cast("string")), 256), 1, 16))
    return rows.select(
        *key, "reason", "problem", "candidate_id", "conflict_id", "product_id", "item_before", F.when(good, "resolved").otherwise(F.col("item_before")).alias("item_after"),
        "candidate_before", F.when(good & F.col("candidate_id").isNotNull(), after).otherwise(F.col("candidate_before")).alias("candidate_after"), release.alias("release_id"),
    )


def effective(log: DataFrame) -> DataFrame:
    return log.where("problem is null")


def candidates_after(candidates: DataFrame, log: DataFrame) -> DataFrame:
    """Candidates (id, state) as the log leaves them."""
    now = effective(log).where("candidate_id is not null").select(F.col("candidate_id").alias("id"), "candidate_after")
    return candidates.join(now, "id", "left").withColumn("state", F.coalesce("candidate_after", "state")).drop("candidate_after")


def closed_conflicts(log: DataFrame) -> DataFrame:
    """Conflicts that decisions settled, each by the first that did, with who settled it and how."""
    first = F.min_by(F.struct("actor", F.concat_ws(": ", F.concat("decision", F.lit("ed")), "reason").alias("resolution"), "decided_at"), F.struct("decided_at", "item_id")).alias("by")
    return effective(log).where("conflict_id is not null").groupBy("conflict_id").agg(first).select("conflict_id", "by.*")


def audit_rows(log: DataFrame) -> DataFrame:
    """One row for each decision that took effect: who, what, and the states before and after."""
    return effective(log).select(
        F.col("item_id").alias("subject_id"), F.concat(F.lit("review_item."), "decision", F.lit("ed")).alias("action"), "actor", "reason", F.col("decided_at").alias("occurred_at"),
        F.struct(F.col("item_before").alias("review_state"), F.col("candidate_before").alias("candidate_state")).alias("before"),
        F.struct(F.col("item_after").alias("review_state"), F.col("candidate_after").alias("candidate_state"), "release_id").alias("after"),
    )


def to_refresh(log: DataFrame) -> DataFrame:
    """Products whose summary the log makes out of date."""
    return effective(log).where("product_id is not null and (conflict_id is not null or release_id is not null)").select("product_id").distinct()


def upsert(candidates: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row for each source and dedupe key of ``candidates``: the stored candidate, or the first of them.

    ``created`` says that it is new, ``seen`` how many of the batch have the key, and ``last_seen``
    the latest day any did. ``stored`` is what earlier batches gave, merged by ``merged``.
    """
    none = F.lit("")
    keyed = candidates.withColumn("dedupe_key", dedupe_key(F.col("hint"), normalize_version(F.col("raw_version")), F.col("channel"), none, none, none))
    batch = keyed.groupBy("source_id", "dedupe_key").agg(F.min_by("id", F.struct("discovered_on", "id")).alias("first_id"), F.count("*").alias("seen"), F.max("discovered_on").alias("last_seen"))
    if stored is None:
        return batch.select(F.col("first_id").alias("id"), "source_id", "dedupe_key", F.lit(True).alias("created"), "seen", "last_seen")
    old = stored.select("source_id", "dedupe_key", F.col("id").alias("old_id"), F.col("last_seen").alias("old_seen"))
    both = batch.join(old, ["source_id", "dedupe_key"], "left")
    return both.select(F.coalesce("old_id", "first_id").alias("id"), "source_id", "dedupe_key", F.col("old_id").isNull().alias("created"), "seen", F.greatest("last_seen", "old_seen").alias("last_seen"))


def merged(stored: DataFrame, upserted: DataFrame) -> DataFrame:
    """What is stored after a batch: rows that it did not touch, and those that it made or brought up to date."""
    columns = ["id", "source_id", "dedupe_key", "last_seen"]
    return stored.join(upserted, ["source_id", "dedupe_key"], "left_anti").select(*columns).union(upserted.select(*columns))
