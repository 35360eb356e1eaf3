"""What operators that run in rounds share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder, which
    ``spark.checkpoint.dir`` names; a local session may leave it unset."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quayside-"))
    return df.checkpoint(eager=True)


#: Spark removes the shuffle files of a query when the query ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the cluster's shared folder, beside the checkpoints: it takes less
    room than what was shuffled to make it, which goes when it is written."""
    spark, conf = df.sparkSession, df.sparkSession.conf
    base = conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    path, before = f"{base or tempfile.mkdtemp(prefix='quayside-')}/{name}-{uuid.uuid4().hex}", conf.get(CLEAN, None)
    conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEAN) if before is None else conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def left_by(rows: DataFrame, table: DataFrame, first: str, *rest: str, deal: str = "id") -> DataFrame:
    """``rows`` left-joined to ``table`` on ``first`` and ``rest``. Rows whose ``first`` is null meet nothing, and may
    be most: they are dealt by ``deal``, so that no task has all of them."""
    none = F.col(first).isNull()
    key = F.when(none, F.pmod(F.xxhash64(deal), F.lit(1 << 20))).otherwise(F.col(first))
    known = table.where(F.col(first).isNotNull()).withColumnRenamed(first, "_key").withColumn("_none", F.lit(False))
    return rows.withColumns({"_key": key, "_none": none}).join(known, ["_key", "_none", *rest], "left").drop("_key", "_none")
