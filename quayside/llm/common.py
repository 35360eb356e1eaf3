"""What the training-data operators share: checkpoints, byte tokens, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark removes the shuffle files of a query when the query ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path is only ever opened by Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder, which
    ``spark.checkpoint.dir`` names. Only a local session may leave it unset; its one machine
    then has a temporary folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quayside-"))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, where the whole cluster sees it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    return f"{base or tempfile.mkdtemp(prefix='quayside-')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder. Columns of hashes and counts take
    an eighth of the room that a checkpoint's rows take, and small files are read together."""
    path, conf = shared_folder(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(CLEAN, None)
    conf.set(CLEAN, "true")  # nothing reads what this write has shuffled again
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEAN) if before is None else conf.set(CLEAN, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about ``size`` bytes (one row at least), so that what
    a task derives from a run does not depend on how many rows Spark puts into a batch."""
    for batch in batches:
        rows = max(1, min(batch.num_rows, batch.num_rows * size // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(column: pa.Array, size: int = 4_000_000) -> Iterator[str | None]:
    """The texts of a column, of which only about ``size`` bytes are Python strings at a time."""
    rows = max(1, min(len(column), len(column) * size // max(1, column.nbytes)))
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


def words(text: str | None) -> list[bytes]:
    """Words of ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, as UTF-8 bytes (null: none).

    ``bytes.lower`` and ``bytes.split`` know ASCII only, which is exactly that definition.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node``, ``root``: the smallest node that each node of ``edges`` (a, b) can reach.

    Alternates large-star and small-star steps: every round joins the edges to the smallest
    neighbour of one end, so no neighbourhood is ever gathered in one place, and a hub is an
    equi-join key that adaptive execution can split. Rounds grow with the logarithm of a
    component's size. An empty input gives an empty result; self-loops are ignored.
    """
    e = checkpoint(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    mark = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(down.select("u", F.col("m").alias("v")))
            .distinct()
        )
        e = checkpoint(small)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError("connected components did not settle")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
