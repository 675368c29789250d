"""What the operators of this subpackage share: table access, checkpoints, small column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orderlake.sources.paths import fresh

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of characters other than space, \t, \n, \v, \f, \r.
WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The frame by way of a table in the shared folder: lineage ends there, no executor is needed to read it, and its
    size is known to the joins that follow."""
    path = fresh(df.sparkSession, "cut")
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete the tables of frames that came from ``cut`` and that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. Texts of ASCII alone, told by their byte count, take the faster lower()."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.filter(F.split(text, WHITE), lambda w: w != "")


#: Bits of the map of identifiers that ``among`` sends to all tasks: 1 MB.
MAP_BITS = 1 << 23


def marked(df: DataFrame, ids: DataFrame, column: str, how: str) -> DataFrame:
    """df with ``__hit``: whether the map of ``ids`` has the row's. The map has MAP_BITS / 32768 rows of 4 KB at most."""
    place = F.pmod(F.xxhash64(F.col(column)), F.lit(MAP_BITS))
    bits = ids.where(F.col(column).isNotNull()).groupBy(F.bitmap_bucket_number(place).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("__bits"))
    at = F.bitmap_bit_position(place).cast("int")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    told = df.join(F.broadcast(bits), F.bitmap_bucket_number(place) == F.col("__bucket"), how)
    return told.withColumn("__hit", F.coalesce(F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2 == 1, F.lit(False)))


def among(df: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """The rows whose ``column`` may be one of ``ids``, told by a bitmap of hashes of fixed size: all that are, and a few
    others. Put before a join with few of many identifiers, it keeps the rest from being shuffled; where the
    identifiers fill the map, everything passes."""
    return marked(df, ids, column, "inner").where("__hit").select(*[F.col(f"`{c}`") for c in df.columns])


def without(df: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """The rows whose ``column`` isn't one of ``ids``; a null never is. Only those that the bitmap can't tell are shuffled."""
    told = marked(df, ids, column, "left")
    columns = [F.col(f"`{c}`") for c in df.columns]
    gone = ids.select(F.col(column).alias("__gone")).distinct()
    unsure = told.where("__hit").select(*columns)
    return told.where("NOT __hit").select(*columns).unionByName(unsure.join(gone, F.col(column) == F.col("__gone"), "left_anti"))
