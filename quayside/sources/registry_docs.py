"""Registry documents: YAML files with several documents each, as typed rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as ``value``, however many documents each holds."""
    return spark.read.text(path, wholetext=True)


def parse(files: DataFrame, kind: str, schema: str) -> DataFrame:
    """Documents of one kind with the columns of ``schema``; the rest of a document is ignored.

    Reading YAML takes far longer than reading its text, so files are dealt to all tasks, however
    few they came in, and libyaml reads them where it is installed.
    """
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        import yaml

        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        for batch in batches:
            docs = [d for text in batch["value"].dropna() for d in yaml.load_all(text, Loader=loader) if isinstance(d, dict)]
            yield pd.DataFrame({"kind": [str(d.get("kind")) for d in docs], "body": [json.dumps(d, default=str) for d in docs]})

    rows = files.select("value").repartition(tasks).mapInPandas(load, "kind string, body string").where(F.col("kind") == kind)
    return rows.select(F.from_json("body", schema).alias("d")).select("d.*")
