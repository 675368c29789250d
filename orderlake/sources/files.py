"""Delimited files, and folders of them."""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: A string that no file has, so that texts as n/a stay texts.
NO_NULL = "\u0000"


def write_delimited(df: DataFrame, path: str, sep: str = "\t") -> None:
    df.write.csv(path, sep=sep, header=True, emptyValue="", timestampFormat="yyyy-MM-dd HH:mm:ss")


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = "\t") -> DataFrame:
    return spark.read.schema(schema).csv(path, sep=sep, header=True, nullValue=NO_NULL, enforceSchema=False)


def table_name(path: str) -> str:
    """A table's name from its file's: without folders, suffix and the data set's prefix and ending."""
    return re.sub(r"^raw_|_dataset$", "", re.sub(r"\.[^.]+$", "", path.rstrip("/").rpartition("/")[2]))


def dedup_files(spark: SparkSession, paths: list[str], out: str) -> list[str]:
    """Each file, its repeated rows dropped, to a table of its own; returns their folders. Columns stay text."""
    made = []
    for path in paths:
        spark.read.csv(path, header=True, nullValue=NO_NULL).dropDuplicates().write.mode("overwrite").parquet(to := f"{out.rstrip('/')}/{table_name(path)}")
        made.append(to)
    return made


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Only the partitions that the frame has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def list_files(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """The folder's files of a name pattern, read by Spark's own reader, so that any store will do."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return [r["path"] for r in found.select("path").orderBy("path").collect()]


def write_table(df: DataFrame, name: str, mode: str = "append") -> None:
    """Create if missing, then ``append`` or ``replace``."""
    exists = df.sparkSession.catalog.tableExists(name)
    if mode == "replace":
        df.write.mode("overwrite").format("parquet").saveAsTable(name)
    elif exists:
        df.select(*df.sparkSession.table(name).columns).write.insertInto(name)
    else:
        df.write.format("parquet").saveAsTable(name)


def make_namespace(spark: SparkSession, name: str, drop: bool = False, table: str = "") -> None:
    """The namespace; with ``drop``, without its tables, or without the one."""
    spark.sql(f"CREATE NAMESPACE IF NOT EXISTS `{name}`")
    if drop:
        for row in spark.sql(f"SHOW TABLES IN `{name}`").collect():
            if not row["isTemporary"] and (not table or row["tableName"] == table):
                spark.sql(f"DROP TABLE IF EXISTS `{name}`.`{row['tableName']}` PURGE")


def make_empty(spark: SparkSession, name: str, schema: T.StructType) -> None:
    if not spark.catalog.tableExists(name):
        spark.createDataFrame([], schema).write.format("parquet").saveAsTable(name)


def wait_for(spark: SparkSession, name: str, seconds: float = 60, poll: float = 1) -> None:
    """Wait until another job has made a table; a TimeoutError if it doesn't come."""
    end = time.monotonic() + seconds
    while not spark.catalog.tableExists(name):
        if time.monotonic() >= end:
            raise TimeoutError(f"no table {name} after {seconds} seconds")
        time.sleep(poll)


def key_hash(columns: list[str]) -> F.Column:
    """A surrogate key that comes out the same each time."""
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256)
