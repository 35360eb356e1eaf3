"""Jobs that keep a machine for each key: conflicts of claims, and alerts by rules."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocks(spark: SparkSession) -> None:
    """State of more than one kind a key needs this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


#: Subjects are dealt to so many machines: calls of Python are few, and one call's rows are a small part of a batch.
BUCKETS = 4096
CLAIM = ["dated", "released", "observed", "version", "order_id", "line_no"]


class _Claims(StatefulProcessor):
    """Of one bucket of subjects: by subject the claim that stands for each source, and whether versions
    differ. A subject that a batch brings claims of is read once and written once; others cost nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        claims = "source_id array<long>, dated array<boolean>, released array<long>, observed array<long>, version array<string>, order_id array<long>, line_no array<long>"
        self.subjects = handle.getMapState("subjects", "product_id long, channel string", f"disputed boolean, {claims}")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        of = ["product_id", "channel", "source_id"]
        best = frame.sort_values(CLAIM).drop_duplicates(of, keep="last")
        came: dict[tuple, dict] = {}
        for product, channel, source, *claim in zip(*(best[c].tolist() for c in [*of, *CLAIM]), strict=True):
            came.setdefault((product, None if pd.isna(channel) else channel), {})[source] = tuple(claim)
        out = []
        for subject, new in came.items():
            known = self.subjects.getValue(subject)
            disputed, claims = (known[0], {s: tuple(c) for s, *c in zip(*known[1:], strict=True)}) if known else (False, {})
            later = {s: c for s, c in new.items() if s not in claims or claims[s] < c}
            if not later:
                continue
            claims |= later
            said = sorted({c[3] for c in claims.values() if c[3].strip(" ")})  # a source that names no version makes no claim
            if (len(said) > 1) != disputed:
                disputed = not disputed
                out.append((*subject, "opened" if disputed else "resolved", said))
            self.subjects.updateValue(subject, (disputed, *map(list, zip(*((s, *c) for s, c in claims.items()), strict=True))))
        if out:
            yield pd.DataFrame(out, columns=["product_id", "channel", "event", "versions"])

    def close(self) -> None:
        pass


def conflict_events(claims: DataFrame) -> DataFrame:
    """A row whenever eligible sources begin to name more than one version of a product and channel
    (``opened``), and when they no longer do (``resolved``), with the versions then named.

    ``claims``: product_id, channel, source_id, version, release_date, observed_on, order_id and
    line_no, of eligible sources. A source's claim stands until it makes one that comes later in
    the order of claims, so a source can take back what it said; one that arrives late and comes
    earlier in that order changes nothing.
    """
    with_rocks(claims.sparkSession)
    days = lambda c: F.coalesce(F.datediff(c, F.lit("1970-01-01")), F.lit(0)).cast("long")
    rows = claims.where("product_id is not null").select(
        "product_id", "channel", "source_id", F.coalesce("version", F.lit("")).alias("version"), F.col("release_date").isNotNull().alias("dated"),
        days("release_date").alias("released"), days("observed_on").alias("observed"), "order_id", "line_no",
    )
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("product_id", "channel"), F.lit(BUCKETS)).cast("int"))
    return rows.groupBy("bucket").transformWithStateInPandas(_Claims(), "product_id long, channel string, event string, versions array<string>", "append", "none")


class _Alert(StatefulProcessor):
    """One rule over one series: quiet, pending or firing. ``rules``: seconds that a breach must last,
    and whether a step without a sample is one."""

    def __init__(self, rules: dict[str, tuple[int, bool]], step: int):
        self.rules, self.step = {k: (-(-hold // step) * step, gap) for k, (hold, gap) in rules.items()}, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, since long, last long, timer long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("at")
        at = (frame["at"].astype("datetime64[us]").astype("int64") + 1) // 1_000_000  # a window's time is just before its end
        self._begin(key)
        for t, breached in zip(at.tolist(), frame["breached"].tolist(), strict=True):
            if self.last >= 0:
                self._without(self.last + self.step, t - self.step)
            self._at(t, breached)
            self.last = t
        yield from self._end(key)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self._begin(key)
        now = timerValues.getCurrentWatermarkInMs() // 1000 // self.step * self.step
        self._without(self.last + self.step, now)
        self.last, self.timer = max(self.last, now), 0
        yield from self._end(key)

    def _begin(self, key: Any) -> None:
        self.status, self.since, self.last, self.timer = self.state.get() if self.state.exists() else ("quiet", 0, -1, 0)
        self.hold, self.on_gap = self.rules[key[0]]
        self.said: list[tuple[str, int]] = []

    def _at(self, t: int, breached: bool) -> None:
        if not breached and self.status != "quiet":
            self.said.append(("resolved" if self.status == "firing" else "cleared", t))
            self.status = "quiet"
        if breached and self.status == "quiet":
            self.status, self.since = "pending", t
            self.said.append(("pending", t))
        if breached and self.status == "pending" and t - self.since >= self.hold:
            self.status = "firing"
            self.said.append(("firing", t))

    def _without(self, first: int, end: int) -> None:
        """The steps from ``first`` to ``end``, of which no samples came: only those that change anything."""
        if first <= end:
            self._at(first, self.on_gap)
            if self.status == "pending" and first < self.since + self.hold <= end:
                self._at(self.since + self.hold, True)

    def _end(self, key: Any) -> Iterator[pd.DataFrame]:
        wake = 1000 * (self.last + self.step) if self.on_gap or self.status != "quiet" else 0
        if self.timer not in (0, wake):
            self.handle.deleteTimer(self.timer)
        if wake and wake != self.timer:
            self.handle.registerTimer(wake)
        self.state.update((self.status, self.since, self.last, wake))
        if self.said:
            yield pd.DataFrame({"rule": key[0], "series": key[1], "event": [e for e, _ in self.said], "at": pd.to_datetime([t for _, t in self.said], unit="s")})

    def close(self) -> None:
        pass


def alert_events(samples: DataFrame, rules: list[tuple], step: int) -> DataFrame:
    """When each rule is pending, firing, resolved, or cleared before it fired, for every series.

    ``samples`` is a stream of windowed aggregates in append mode: series, ``at`` (window_time)
    and a column for each metric, at every ``step`` seconds at most. ``rules``: (rule, metric,
    comparison, threshold, seconds to hold, severity, on_gap) as in ``operators.alerts``. Windows
    are the first stateful operator and these machines the second; a timer in event time wakes a
    machine whose series goes silent, so that an alert ends, or one on silence begins, without a
    further sample.
    """
    with_rocks(samples.sparkSession)
    from ..operators.alerts import breached

    each = F.explode(F.array(*[F.struct(F.lit(r[0]).alias("rule"), breached(F.col(r[1]), F.lit(r[2]), F.lit(r[3])).alias("breached")) for r in rules]))
    rows = samples.select("series", "at", each.alias("r")).select("r.rule", "series", "at", "r.breached")
    machine = _Alert({r[0]: (r[4], r[6]) for r in rules}, step)
    return rows.groupBy("rule", "series").transformWithStateInPandas(machine, "rule string, series string, event string, at timestamp", "append", "eventTime")
