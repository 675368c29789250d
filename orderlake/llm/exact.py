"""Exact duplicates by a tree of sorted digest runs.

Each input partition turns its rows into a run: sorted by digest, one entry for each, with the smallest or largest
identifier and a count. Partitions then exchange runs in rounds: in each round the runs whose numbers agree but for their
lowest ``log2(fan_in)`` bits meet, are merged in order of their digests, and of each stretch of equal ones the head stays
with the sum of their counts, until one run is left. A run that comes of more partitions is dealt over as many
ranges of digests, so that a round has as much to do as the one before and no task holds a whole run.

An entry is the digest together with the byte length and a second, independent hash of the text, and entries merge only where
all three agree, so every level verifies what it joins. A partition combines before it sends, so a group that
holds a third of all rows is one entry from each.

Defined results: a null text counts as empty; rows with the same text and the same identifier are one document that
stays or goes as a whole; an empty table gives no rows; further columns are ignored by ``groups`` and kept by ``drop``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from orderlake.llm.common import ascii_lower, cut, table, without

KEYS = ["digest", "n_bytes", "check"]


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest, n_bytes, check of the text with A-Z lower-cased."""
    norm = df.select(F.col(id_col).alias("id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    return norm.select("id", F.unhex(F.sha2("t", 256)).alias("digest"), F.octet_length("t").alias("n_bytes"), F.xxhash64("t").alias("check"))


def merge_runs(rows: DataFrame, keep: str = "min", fan_in: int = 4) -> DataFrame:
    """The last run of the tree: digest, n_bytes, check, keep_id, group_size. Its leaves are the partitions of ``rows``."""
    best, first = {"min": (F.min, F.asc_nulls_last), "max": (F.max, F.desc_nulls_last)}[keep]
    step = fan_in.bit_length() - 1
    left = (rows.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0) + 1
    runs = rows.select(F.pmod(F.spark_partition_id(), F.lit(left)).alias("run"), *KEYS, F.col("id").alias("keep_id"))
    leading = F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int")

    def met(runs: DataFrame, spread: int) -> DataFrame:
        return runs.withColumn("run", F.shiftright("run", step)).withColumn("range", F.floor(leading * min(spread, 65_536) / 65_536).cast("int"))

    # the least of structs is taken by sorting: each partition's run on this side, their merge on the other
    spread, left = 4 * fan_in, (left + fan_in - 1) // fan_in
    entry = F.when(F.col("keep_id").isNotNull(), F.struct("keep_id"))
    runs = met(runs, spread).groupBy("run", "range", *KEYS).agg(best(entry).alias("entry"), F.count("*").alias("group_size")).select("run", *KEYS, "entry.keep_id", "group_size")
    while left > 1:
        spread, left = spread * fan_in, (left + fan_in - 1) // fan_in
        runs = met(runs, spread).repartition("run", "range").sortWithinPartitions("run", "range", *KEYS, first("keep_id"))
        stretch = W.partitionBy("run", "range", *KEYS).orderBy(first("keep_id"))
        whole = stretch.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        runs = runs.select("run", *KEYS, "keep_id", F.row_number().over(stretch).alias("at"), F.sum("group_size").over(whole).alias("group_size")).where("at = 1").drop("at")
    return runs.drop("run")


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256. The digests are written once; only groups of
    two and more come back to the rows, by a join whose large partitions Spark can split."""
    rows = cut(digests(df, id_col, text_col))
    many = merge_runs(rows, keep).where("group_size > 1")
    out = rows.join(many.hint("merge"), KEYS, "left")
    keep_id = F.coalesce("keep_id", "id")
    return out.select(F.col("id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows that stay, with their columns as they came; rows with a null identifier, which can't be told apart, stay."""
    gone = cut(groups(df, id_col, text_col, keep).where("NOT kept").select(id_col))
    return without(df, gone, id_col)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"), keep="max")


OP3_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""
