"""Reshaping, shares and ranks that several analyses need."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def share(df: DataFrame, count: str, by: list[str] | None = None, out: str = "proportion", places: int = 4) -> DataFrame:
    """With the share of a count in its total, or in its group's; totals are aggregated, not gathered in a window."""
    if by:
        totals = df.groupBy(*by).agg(F.sum(count).alias("__total"))
        return df.join(totals, by).withColumn(out, F.round(F.col(count) / F.col("__total"), places)).drop("__total")
    total = df.agg(F.sum(count).alias("__total"))
    return df.crossJoin(F.broadcast(total)).withColumn(out, F.round(F.col(count) / F.col("__total"), places)).drop("__total")  # one row


def several(df: DataFrame, key: list[str], value: str, out: str = "n_values") -> DataFrame:
    """Keys with more than one different value."""
    return df.groupBy(*key).agg(F.count_distinct(value).alias(out)).where(F.col(out) > 1)


def rounded(c: Column, places: int) -> Column:
    """A double rounded as a double: scaled first, and then to a whole number, halves away from zero. ``round`` with places goes by the
    decimal digits that a double prints, so that ties fall otherwise than in SQL engines that scale."""
    return F.round(c * F.lit(10.0**places), 0) / F.lit(10.0**places)


def best(df: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def running(df: DataFrame, order: list[Column], value: str, buckets: int = 64) -> DataFrame:
    """With ``running`` (the sum of the values up to the row, in order), ``row`` (its place from 1), and the totals ``total`` and
    ``rows``, over the whole frame. No task sees all rows: they are dealt by range, summed in each partition, and the
    partitions' sums, one row each, give what stands before. The order must be total."""
    dealt = df.repartitionByRange(buckets, *order).withColumn("__p", F.spark_partition_id())
    inside = W.partitionBy("__p").orderBy(*order)
    here = dealt.withColumn("__s", F.sum(value).over(inside.rowsBetween(W.unboundedPreceding, 0))).withColumn("__n", F.row_number().over(inside))
    sums = here.groupBy("__p").agg(F.max("__n").alias("n"), F.max_by("__s", "__n").alias("s"))
    along = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select("__p", F.coalesce(F.sum("s").over(along), F.lit(0)).alias("__before"), F.coalesce(F.sum("n").over(along), F.lit(0)).alias("__rows"), F.sum("s").over(W.partitionBy()).alias("total"), F.sum("n").over(W.partitionBy()).alias("rows"))
    return here.join(F.broadcast(before), "__p").withColumn("running", F.col("__s") + F.col("__before")).withColumn("row", F.col("__n") + F.col("__rows")).drop("__p", "__s", "__n", "__before", "__rows")


#: Rows of a partition of what is dealt by its keys.
PART_ROWS = 250_000


def dealt(df: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by their keys over partitions that grow in number with a table, so that what a task sorts or hashes stays as small. The
    table's rows are counted from its files; keys alone decide, so rows of equal keys are together."""
    return df.repartition(max(1, -(-table.count() // PART_ROWS)), *keys)


def gaps(df: DataFrame, ts: str, unique: str, bucket: str = "day") -> DataFrame:
    """Seconds from each event to the one before, over the whole log, in two passes: within buckets of time, and from a
    bucket's first event to the last one before it. One row per bucket is all that is ever ordered whole."""
    log = df.select(F.date_trunc(bucket, ts).alias("b"), F.col(ts).alias("ts"), F.col(unique).alias("u"))
    inside = log.withColumn("prev", F.lag("ts").over(W.partitionBy("b").orderBy("ts", "u")))
    edges = log.groupBy("b").agg(F.max("ts").alias("last"))
    edges = edges.select("b", F.lag("last").over(W.orderBy("b")).alias("before"))
    joined = inside.join(edges, "b").withColumn("prev", F.coalesce("prev", "before"))
    return joined.where("prev IS NOT NULL").select(F.col("u").alias(unique), (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("prev").cast("timestamp"))).alias("gap_micros"))


def together(frames: list[DataFrame]) -> DataFrame:
    """What several workers have made, by name; columns that some lack are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def date_range(columns: list[tuple[DataFrame, str]]) -> DataFrame:
    """The least and greatest of many time columns: one aggregate each, then one over their few rows."""
    each = [df.agg(F.min(c).alias("lo"), F.max(c).alias("hi")) for df, c in columns]
    return reduce(DataFrame.unionByName, each).agg(F.min("lo").alias("min_ts"), F.max("hi").alias("max_ts"))
