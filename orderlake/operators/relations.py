"""Relations between tables, found in their data: which column's values another one's hold."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Entries of a sketch are 2 to this; estimates are then within about two percent.
LG_ENTRIES = 13
#: What estimates must reach before values are counted; a key's distinct values in its rows, and values found in those looked for.
LEAST = 0.9


def key_name(column: str) -> str:
    """A column's name without its table's prefix of one letter."""
    return re.sub(r"^[a-z]_", "", column)


def key_columns(df: DataFrame) -> list[str]:
    """Whole numbers and texts named as keys."""
    return [c for c, t in df.dtypes if t in ("bigint", "int", "string") and re.search(r"(key|id|_code)$", c)]


def sketches(tables: dict[str, DataFrame]) -> DataFrame:
    """A row for each key column: table, column, key (its name), n_rows, sketch of its distinct values. Each table is read once."""
    parts = []
    for name, df in tables.items():
        if columns := key_columns(df):
            one = df.agg(F.count("*").alias("n"), *[F.theta_sketch_agg(F.col(c).cast("string"), LG_ENTRIES).alias(c) for c in columns])
            each = F.array(*[F.struct(F.lit(name).alias("table"), F.lit(c).alias("column"), F.lit(key_name(c)).alias("key"), F.col("n").alias("n_rows"), F.col(c).alias("sketch")) for c in columns])
            parts.append(one.select(F.inline(each)))
    return reduce(DataFrame.unionByName, parts)


def candidates(tables: dict[str, DataFrame]) -> list[tuple[str, str, str, str]]:
    """Pairs of columns of one name, of different tables, of which by estimate the second is a key of its table and holds the
    first one's values. As many sketches come to the driver's plan as there are columns, and as many pairs come back."""
    s = sketches(tables)
    estimate = lambda c: F.theta_sketch_estimate(c)
    a = s.select("key", F.col("table").alias("a"), F.col("column").alias("ca"), F.col("sketch").alias("sa"))
    b = s.where(estimate("sketch") >= LEAST * F.col("n_rows")).select("key", F.col("table").alias("b"), F.col("column").alias("cb"), F.col("sketch").alias("sb"))
    held = a.join(b, "key").where("a <> b").where(estimate(F.theta_intersection("sa", "sb")) >= LEAST * estimate("sa"))
    return [tuple(r) for r in held.select("a", "ca", "b", "cb").orderBy("a", "ca", "b", "cb").collect()]


def foreign_keys(tables: dict[str, DataFrame], least: Column | float = 1.0) -> DataFrame:
    """from_table, from_column, to_table, to_column, n_values, n_found: how many distinct values a column has, and how many of
    them the key that it refers to; those where at least that share is found. Candidates come of sketches, counts are exact."""
    parts = []
    for a, ca, b, cb in candidates(tables):
        values = tables[a].select(F.col(ca).cast("string").alias("v")).dropna().distinct()
        there = tables[b].select(F.col(cb).cast("string").alias("v")).dropna().distinct().withColumn("found", F.lit(1))
        parts.append(values.join(there, "v", "left").agg(F.count("*").alias("n_values"), F.count("found").alias("n_found")).select(F.lit(a).alias("from_table"), F.lit(ca).alias("from_column"), F.lit(b).alias("to_table"), F.lit(cb).alias("to_column"), "n_values", "n_found"))
    none = "from_table string, from_column string, to_table string, to_column string, n_values long, n_found long"
    spark = next(iter(tables.values())).sparkSession
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], none)
    return found.where(F.col("n_found") >= least * F.col("n_values"))
