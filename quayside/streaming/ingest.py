"""From new artifacts to releases in one incremental job."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import rules
from ..functions.versions import normalize_version
from ..operators import collect, gates
from .jobs import shared_folder
from .stateful import with_rocks

CARRIED = ["id", "container", "source_id", "rank", "official", "eligible", "match", "subject_id", "channel", "version", "release_date", "release_date_precision", "confidence", "dedupe_key", "excerpt", "evidence_id"]
TYPES = "id {id}, container int, source_id long, rank int, official boolean, eligible boolean, match string, subject_id long, channel string, version string, release_date date, release_date_precision string, confidence double, dedupe_key string, excerpt string, evidence_id {id}"


class _Subject(StatefulProcessor):
    """What is known of a product and channel: its versions and who first told them, the last new one, and
    what each source claims. Every candidate gets what came before it, earlier ones of its batch
    too, so that results do not depend on how artifacts are cut into files."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getMapState("first", "version string", "id string")
        self.claims = handle.getMapState("claims", "source_id long", "version string, rank int")
        self.sides = handle.getMapState("sides", "version string, rank int", "sources long")
        self.last = handle.getValueState("last", "version string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["id", "container"])
        known = key[0] >= 0
        last = self.last.get()[0] if self.last.exists() else None
        sides = {tuple(k): v[0] for k, v in self.sides.iterator()} if known else {}
        before, changed, out = dict(sides), {}, []
        seen: dict[str, str | None] = {}
        for name, source, rank, version, able in zip(frame["id"], frame["source_id"], frame["rank"], frame["version"], frame["eligible"], strict=True):
            if not known or not version:
                out.append((None, None, [], []))
                continue
            if version not in seen:
                seen[version] = self.first.getValue((version,))[0] if self.first.containsKey((version,)) else None
            at = int(source)
            if at not in changed:
                changed[at] = (tuple(self.claims.getValue((at,))) if self.claims.containsKey((at,)) else None,) * 2
            own = changed[at][1]
            others = [k for k, n in sides.items() if n > (k == own) and k[0] != version]
            out.append((seen[version], last, sorted({v for v, r in others if r >= rank}), sorted({v for v, r in others if r < rank})))
            if seen[version] is None:
                seen[version] = str(name)
                self.first.updateValue((version,), (str(name),))
                last = version
            if able:  # the claim of a source that may not be used is no evidence
                now = (version, int(rank))
                if own:
                    sides[own] -= 1
                sides[now] = sides.get(now, 0) + 1
                changed[at] = (changed[at][0], now)
        for at, (was, now) in changed.items():
            if now and now != was:
                self.claims.updateValue((at,), now)
        for k in set(sides) | set(before):
            if sides.get(k, 0) != before.get(k, 0):
                self.sides.updateValue(k, (sides[k],)) if sides[k] else self.sides.removeKey(k)
        if last is not None:
            self.last.update((last,))
        for k, name in enumerate(("duplicate_id", "previous", "conflicting", "outranked")):
            frame[name] = [o[k] for o in out]
        yield frame[[*CARRIED, "duplicate_id", "previous", "conflicting", "outranked"]]

    def close(self) -> None:
        pass


def assessed(artifacts: DataFrame, configs: DataFrame, sources: DataFrame, products: DataFrame, today: Column) -> DataFrame:
    """Candidates of a stream of artifacts (id, collector_id, source_id, body) with their verdict.

    Extraction and the lookups of source and product are stateless; what the gates must know of
    earlier batches is the state of one operator, keyed by product and channel. ``products`` has
    id and slug, which a configuration's or a match's product_hint names; a source's own product
    counts if there is no hint. The order of artifacts is that of their ids.
    """
    with_rocks(artifacts.sparkSession)
    found = collect.candidates(collect.extract(artifacts, configs, ("source_id",)))
    told = sources.select(
        F.col("id").alias("source_id"), F.col("product_id").alias("own_product"), rules.authority_rank(F.col("quality_class")).alias("rank"),
        (F.col("official") & (F.col("quality_class") == "official_manufacturer")).alias("official"),
        (F.col("health").isin("active", "degraded") & rules.compliance_permits(F.col("robots"), F.col("terms"))).alias("eligible"),
    )
    by_slug, by_id = products.select(F.col("slug").alias("hint"), F.col("id").alias("hinted")), products.select(F.col("id").alias("own_product"), F.col("id").alias("owned"))
    rows = found.join(told, "source_id").join(by_slug, "hint", "left").join(by_id, "own_product", "left")
    subject = F.coalesce("hinted", F.when(F.col("hint").isNull(), F.col("owned")))
    rows = rows.withColumns({"subject_id": subject, "match": F.when(subject.isNotNull(), "unique").otherwise("no_match"), "evidence_id": F.col("id"), "version": normalize_version(F.col("raw_version"))})
    # candidates of no product have nothing before them; they are dealt to many keys, none of which is null
    rows = rows.withColumn("subject_id", F.coalesce("subject_id", -1 - F.pmod(F.xxhash64("id"), F.lit(1024))))
    kind = artifacts.schema["id"].dataType.simpleString()
    schema = TYPES.format(id=kind) + ", duplicate_id string, previous string, conflicting array<string>, outranked array<string>"
    known = rows.select(*CARRIED).groupBy("subject_id", "channel").transformWithStateInPandas(_Subject(), schema, "append", "none")
    known = known.withColumn("subject_id", F.when(F.col("subject_id") >= 0, F.col("subject_id")))
    return gates.validate_candidates(known, today)


def ingest(steps: list[DataFrame] | DataFrame, configs: DataFrame, sources: DataFrame, products: DataFrame, today: Column, folder: str | None = None) -> str:
    """Run ``assessed`` over a stream of artifacts, or over ``steps`` that arrive one after the other, and append
    verdicts and releases to tables in a folder, which is returned.

    A batch writes its own part of both tables and overwrites it if it is run again, so a batch
    counts once. A release is a passed candidate, the first of its product, channel and version.
    """
    many = steps if isinstance(steps, list) else [steps]
    spark = many[0].sparkSession
    folder = folder or shared_folder(spark)

    def put(batch: DataFrame, number: int) -> None:
        at = f"{folder}/verdicts/number={number}"
        batch.write.mode("overwrite").parquet(at)
        released = gates.publishable(spark.read.schema(batch.schema).parquet(at))
        released.write.mode("overwrite").parquet(f"{folder}/releases/number={number}")

    for k, step in enumerate(many):
        stream = step
        if not step.isStreaming:
            step.write.mode("overwrite").parquet(f"{folder}/in/s{k}")
            stream = spark.readStream.schema(step.schema).parquet(f"{folder}/in/*")
        q = assessed(stream, configs, sources, products, today).writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(put).start()
        q.awaitTermination()
    return folder
