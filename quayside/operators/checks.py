"""Source checks: what a response means, which sources are due, health and cadence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from .frames import checkpoint

HOUR, DAY = 3600, 86400


def classify(log: DataFrame) -> DataFrame:
    """outcome and signal of fetches (status, had_etag, old_hash, new_hash)."""
    s, same = F.col("status"), F.col("old_hash") == F.col("new_hash")
    outcome = (
        F.when(s == 304, "unchanged").when(s == 429, "rate_limited").when(s.isin(401, 403), "unauthorized")
        .when(s.between(300, 399), "redirected").when(s.isNull() | (s >= 400), "unavailable")
        .when(same, "unchanged").otherwise("changed")
    )
    signal = F.when(s == 304, F.when(F.col("had_etag"), "etag").otherwise("last_modified")).when(s.between(200, 299), "content_hash")
    return log.withColumn("outcome", outcome).withColumn("signal", signal)


def dispatchable(sources: DataFrame, now: int, limit: int = 1000) -> DataFrame:
    """Eligible sources that are due, the longest due first; times in epoch seconds."""
    ok = rules.source_eligible(F.col("enabled"), F.col("health"), F.col("robots"), F.col("terms"))
    due = (F.col("next_check_s") <= now) & (F.col("retry_after_s").isNull() | (F.col("retry_after_s") <= now))
    return sources.where(ok & due).orderBy("next_check_s", "id").limit(limit)


def keep_latest(rows: DataFrame, n: int, since: str) -> DataFrame:
    """The newest ``n`` of every source, and everything from ``since`` on."""
    w = Window.partitionBy("source_id").orderBy(F.desc("started_at"), F.desc("id"))
    return rows.withColumn("place", F.row_number().over(w)).where((F.col("place") <= n) | (F.col("started_at") >= F.lit(since).cast("timestamp"))).drop("place")


def next_check(state: DataFrame) -> DataFrame:
    """interval_s and next_s (epoch seconds) by the ladder of cadences.

    ``state``: base_s, retry_after_s, outcome, health, failures, unchanged, last_changed_s,
    now_s, end_of_life, security_critical, popular. Steps are counted up to 24, intervals kept
    between 15 minutes and 30 days, and every next time is 5 % later than the interval.
    """
    steps = lambda c: F.least(F.greatest(F.col(c), F.lit(1)), F.lit(24))
    grow = lambda factor, c: F.col("base_s") * F.pow(F.lit(factor), steps(c))
    failing = (F.col("health") == "broken") | F.col("outcome").isin("unavailable", "parser_failed")
    recent = F.col("now_s") - F.col("last_changed_s") < 72 * HOUR
    early = (F.col("retry_after_s") > 0) | (F.col("outcome") == "rate_limited")
    closed = ~failing & (F.col("health") == "authentication_required")
    first = (
        F.when(F.col("retry_after_s") > 0, F.col("retry_after_s").cast("double"))
        .when((F.col("outcome") == "rate_limited") | failing, grow(2.0, "failures"))
        .when(F.col("health") == "authentication_required", F.lit(30.0 * DAY))
        .when((F.col("outcome") == "changed") | F.coalesce(recent, F.lit(False)), F.lit(6.0 * HOUR))
        .when(F.col("unchanged") > 0, grow(1.35, "unchanged"))
        .otherwise(F.col("base_s").cast("double"))
    )
    final = F.coalesce(early, F.lit(False)) | closed
    aged = F.when(F.col("end_of_life"), first * 7).otherwise(first)
    held = F.when(F.col("security_critical"), F.least(aged, F.col("base_s").cast("double"))).otherwise(aged)
    popular = F.when(F.col("popular"), F.least(held, F.lit(6.0 * HOUR))).otherwise(held)
    interval = F.greatest(F.lit(900.0), F.least(F.lit(30.0 * DAY), F.when(final, first).otherwise(popular)))
    out = state.withColumn("interval_s", interval)
    return out.withColumn("next_s", F.floor(F.col("now_s") + F.col("interval_s") * 1.05))


def step_health(current: str, outcome: str, failures: int) -> str:
    """Health after one check; an illegal step leaves it as it was."""
    if outcome in ("unchanged", "changed"):
        wanted = "active" if current in ("degraded", "rate_limited", "broken") else current
    elif outcome in ("unavailable", "parser_failed"):
        wanted = "broken" if failures >= rules.BROKEN_AFTER else "degraded"
    else:
        wanted = {
            "unauthorized": "authentication_required", "rate_limited": "rate_limited", "redirected": "relocated",
            "suspicious_content": "degraded", "manual_review_required": "degraded",
        }.get(outcome, current)
    return wanted if wanted in rules.HEALTH_STATES[current] else current


def after_checks(log: DataFrame) -> DataFrame:
    """The state of each source after its checks (id, source_id, outcome, started_at, etag, content_hash).

    checks, last_check, last_changed, outcome, failures and unchanged checks in a row, the etag of
    the last answer and the hash of the last change. How many in a row the last ones are is a
    count of those after the last other one, so no window goes over a source's log.
    """
    at, failed, same = F.struct("started_at", "id"), F.col("outcome").isin(*FAILURES), F.col("outcome") == "unchanged"
    last = log.groupBy("source_id").agg(
        F.count("*").alias("checks"), F.max("started_at").alias("last_check"), F.max(F.when(F.col("outcome") == "changed", F.col("started_at"))).alias("last_changed"), F.max_by("outcome", at).alias("outcome"),
        F.max_by("etag", F.when(F.col("etag").isNotNull(), at)).alias("etag"), F.max_by("content_hash", F.when(F.col("content_hash").isNotNull(), at)).alias("content_hash"),
        F.max(F.when(~failed, at)).alias("no_failure"), F.max(F.when(~same, at)).alias("no_same"),
    )
    ends = last.select("source_id", "no_failure", "no_same")
    after = lambda c: F.col(c).isNull() | (at > F.col(c))
    rows = log.select("source_id", "started_at", "id").join(ends, "source_id").groupBy("source_id").agg(F.count_if(after("no_failure")).alias("failures"), F.count_if(after("no_same")).alias("unchanged"))
    return last.drop("no_failure", "no_same").join(rows, "source_id")


FAILURES = ("unavailable", "parser_failed")
#: Outcomes that step_health tells apart; all others leave health as it is.
OUTCOMES = ("unchanged", "changed", *FAILURES, "unauthorized", "rate_limited", "redirected", "suspicious_content", "manual_review_required", "")


def transitions() -> np.ndarray:
    """What each outcome makes of each state: a state is a health and failures in a row, up to those
    that break a source, as one number."""
    healths, most = list(rules.HEALTH_STATES), rules.BROKEN_AFTER
    out = np.empty((len(OUTCOMES), len(healths) * (most + 1)), "u1")
    for o, outcome in enumerate(OUTCOMES):
        for h, health in enumerate(healths):
            for f in range(most + 1):
                failures = min(most, f + 1) if outcome in FAILURES else 0
                out[o, h * (most + 1) + f] = healths.index(step_health(health, outcome, failures)) * (most + 1) + failures
    return out


def composed(maps: np.ndarray) -> np.ndarray:
    """Maps of states, one after the other, as one: neighbours are composed until one is left."""
    while len(maps) > 1:
        odd = maps[len(maps) // 2 * 2 :]
        maps = np.concatenate([np.take_along_axis(maps[1 : len(maps) // 2 * 2 : 2], maps[: len(maps) // 2 * 2 : 2], axis=1), odd])
    return maps[0]


def _runs(keys: pd.Series) -> list[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero((keys != keys.shift()).to_numpy()[1:]) + 1).tolist(), len(keys)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def fold_health(checks: DataFrame, start: str = "active") -> DataFrame:
    """Every check (id, source_id, outcome, started_at) with the failures in a row and the health after it.

    Each step depends on the one before, but what a run of checks does is a map of few states to
    states, and such maps can be composed. The log is dealt by time into blocks, of which a hot
    source has many; each block becomes one map for each source, the maps of a source are gone
    through in order (one row a block), and then all blocks are replayed, each from its own start.
    """
    table, per, healths = transitions(), rules.BROKEN_AFTER + 1, list(rules.HEALTH_STATES)
    code = F.create_map(*[F.lit(x) for k, o in enumerate(OUTCOMES) for x in (o, k)])
    rows = checks.select(
        "id", "source_id", F.coalesce(F.try_element_at(code, F.coalesce("outcome", F.lit(""))), F.lit(len(OUTCOMES) - 1)).alias("code"), "started_at",
        F.coalesce(F.col("source_id").cast("string"), F.lit("")).alias("key"),
    )
    dealt = checkpoint(rows.repartitionByRange("key", "started_at", "id").withColumn("block", F.spark_partition_id()))
    failing = np.array([o in FAILURES for o in OUTCOMES])

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each block and key: its map, whether all of it failed, and the failures it ends with."""
        last, whole, reset, ends = None, None, False, 0
        said = lambda: pd.DataFrame({"block": [last[0]], "key": [last[1]], "map": [whole.astype("i4")], "reset": [reset], "ends": [ends]})
        for held in batches:
            of, block, key = held["code"].to_numpy(), held["block"], held["key"]
            for a, b in _runs(block.astype(str) + " " + key):
                if (block.iloc[a], key.iloc[a]) != last:
                    if last:
                        yield said()
                    last, whole, reset, ends = (block.iloc[a], key.iloc[a]), np.arange(table.shape[1], dtype="u1"), False, 0
                whole = composed(np.stack([whole, composed(table[of[a:b]])]))
                good = np.flatnonzero(~failing[of[a:b]])
                reset, ends = reset or len(good) > 0, (b - a - 1 - good[-1]) if len(good) else ends + b - a
        if last:
            yield said()

    def started(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The state and the failures in a row with which each block of a key begins."""
        last, state, failures = None, 0, 0
        for held in batches:
            out = []
            for key, whole, reset, ends in zip(held["key"], held["map"], held["reset"], held["ends"], strict=True):
                if key != last:
                    last, state, failures = key, healths.index(start) * per, 0
                out.append((state, failures))
                state, failures = int(whole[state]), ends if reset else failures + ends
            yield held[["block", "key"]].assign(state=[s for s, _ in out], failures=[f for _, f in out])

    def replayed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state, failures, steps = None, 0, 0, table.tolist()
        for held in batches:
            of, block, key, after = held["code"].tolist(), held["block"], held["key"], []
            count = np.empty(len(held), "i8")
            for a, b in _runs(block.astype(str) + " " + key):
                if (block.iloc[a], key.iloc[a]) != last:
                    last, state, failures = (block.iloc[a], key.iloc[a]), int(held["state"].iloc[a]), int(held["failures"].iloc[a])
                for o in of[a:b]:
                    state = steps[o][state]
                    after.append(state)
                at = np.arange(b - a)
                since = np.maximum.accumulate(np.where(failing[np.array(of[a:b])], -1, at))
                count[a:b] = np.where(since >= 0, at - since, failures + at + 1)
                failures = int(count[b - 1])
            yield held[["id", "source_id"]].assign(failures=count, health=[healths[s // per] for s in after])

    blocks = in_order(dealt, ["block", "key"], "started_at", "id").mapInPandas(summed, "block int, key string, map array<int>, reset boolean, ends long")
    begin = in_order(blocks, ["key"], "block").mapInPandas(started, "block int, key string, state int, failures long")
    again = in_order(dealt.join(begin, ["block", "key"]), ["block", "key"], "started_at", "id")
    return again.select("id", "source_id", "code", "block", "key", "state", "failures").mapInPandas(replayed, "id long, source_id long, failures int, health string")


def in_order(rows: DataFrame, key: str | list[str], *order: str) -> DataFrame:
    """Rows of each ``key`` in one partition, one after the other and in ``order``."""
    keys = [key] if isinstance(key, str) else key
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def illegal_steps(log: DataFrame, states: dict[str, list[str]], key: str, order: list[str | Column]) -> DataFrame:
    """Rows whose ``state`` may not follow the state before it under ``key``."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = log.withColumn("before", F.lag("state").over(w))
    return rows.where(F.col("before").isNotNull() & ~rules.legal(states, F.col("before"), F.col("state")))
