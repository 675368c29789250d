"""Where tables that a job writes for itself go."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the one set on the context. Where neither is
    set, as in tests, a temporary one, on a local master only."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{os.urandom(8).hex()}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame by way of a table in the shared folder, for one that several parts of a plan read: it is made once."""
    df.write.parquet(path := fresh(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What is set while a table is merged: a shuffle's files go when the action that made them ends, not when the driver next collects its garbage.
CLEANED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def configured(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of a session, as they were before afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
