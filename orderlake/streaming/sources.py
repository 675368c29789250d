"""Streams: what they read and how they are run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from orderlake.sources.paths import fresh


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 8) -> DataFrame:
    """A table's files as a stream, whether it is one file or a folder of them."""
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if is_folder(spark, f"{sf_dir.rstrip('/')}/{name}.parquet"):
        return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir.rstrip("/"))


def is_folder(spark: SparkSession, path: str) -> bool:
    """Asked of the store that Spark reads."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def folder_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def log_stream(spark: SparkSession, servers: str, topics: list[str], per_trigger: int = 50) -> DataFrame:
    """A Kafka log from its start, where the package is there: key, value, topic; lost data don't stop it."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("startingOffsets", "earliest").option("failOnDataLoss", "false").option("maxOffsetsPerTrigger", per_trigger).load().select("key", "value", "topic")


def zoned(df: DataFrame, *columns: str) -> DataFrame:
    """Times without zone as times, which watermarks need."""
    return df.withColumns({c: F.col(c).cast("timestamp") for c in columns})


def unzoned(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


#: Rows of a log for each partition of its state, and where Spark has their number.
STATE_ROWS, PARTS = 500_000, "spark.sql.shuffle.partitions"


def state_parts(spark: SparkSession, rows: int) -> int:
    """Over how many partitions a log of so many rows has its state: each opens and commits its stores in every micro-batch, so there
    are no more than the rows ask for, or than the cores where these are more."""
    return max(-(-rows // STATE_ROWS), min(int(spark.conf.get(PARTS)), spark.sparkContext.defaultParallelism))


def start(df: DataFrame, name: str, path: str | None = None, mode: str = "append", each=None, seconds: int | None = None, console: bool = False, checkpoint: str | None = None, rows: int | None = None) -> StreamingQuery:
    """A named, checkpointed query: to Parquet, to a function on micro-batches, or to the console. Without ``seconds`` it takes
    what there is and stops. With the ``checkpoint`` of one that failed it goes on where that one was. Where a log's ``rows`` are
    known, its state is dealt by them; a query keeps what is set when it starts."""
    spark = df.sparkSession
    if rows is not None:
        before = spark.conf.get(PARTS)
        spark.conf.set(PARTS, state_parts(spark, rows))
        try:
            return start(df, name, path, mode, each, seconds, console, checkpoint)
        finally:
            spark.conf.set(PARTS, before)
    writer = df.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint or fresh(spark, f"checkpoint-{name}"))
    writer = writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)
    if each:
        return writer.foreachBatch(each).start()
    return writer.format("console").start() if console else writer.format("parquet").start(path)


def drain(df: DataFrame, name: str, mode: str = "append", rows: int | None = None) -> DataFrame:
    """The stream run over what there is; its output as a table."""
    spark = df.sparkSession
    path = fresh(spark, name)
    start(df, name, path, mode, rows=rows).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def supervise(spark: SparkSession, queries: list[StreamingQuery], poll_seconds: int = 10, report=print) -> None:
    """Wait for all; one that fails stops the others and is raised."""
    try:
        while alive := [q for q in queries if q.isActive]:
            for q in alive:
                q.awaitTermination(poll_seconds)
                if p := q.lastProgress:
                    report(f"{q.name}: batch {p['batchId']}, {p['numInputRows']} rows")
            for q in queries:
                if q.exception():
                    raise q.exception()
    finally:
        for q in queries:
            if q.isActive:
                q.stop()
        spark.streams.resetTerminated()
