"""Predicates, flags and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed values. The country's bounds: kept inside the first box; the second, wider one tells rejects.
LAT, LNG = (-33.69111, 2.81972), (-72.89583, -34.80861)
WIDE_LAT, WIDE_LNG = (-33.75, 5.27), (-73.98, -34.79)


def in_bounds(lat: str = "lat", lng: str = "lng", box=(LAT, LNG)) -> Column:
    (a, b), (c, d) = box
    return F.col(lat).between(a, b) & F.col(lng).between(c, d)


def any_null(columns: list[str]) -> Column:
    return reduce(lambda x, y: x | y, [F.col(c).isNull() for c in columns])


def quarantine(df: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows without a null in the columns, and the others."""
    bad = any_null(columns or df.columns)
    return df.where(~bad), df.where(bad)


def null_audit(df: DataFrame) -> DataFrame:
    """column_name, n_nulls: one pass, a row per column."""
    sums = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c), F.lit(0).cast("long")).alias("n_nulls")) for c in df.columns])))


def integrity(before: DataFrame, after: DataFrame, key: str, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """One row: distinct keys on either side, the share that is left, nulls and rows out of bounds after, a verdict."""
    b = before.agg(F.count_distinct(key).alias("keys_before"))
    a = after.agg(F.count_distinct(key).alias("keys_after"), F.coalesce(F.sum(any_null(after.columns).cast("long")), F.lit(0)).alias("n_nulls"), F.coalesce(F.sum((~in_bounds(lat, lng)).cast("long")), F.lit(0)).alias("n_outside"))
    both = b.crossJoin(F.broadcast(a))  # one row each
    share = F.round(F.col("keys_after") / F.nullif(F.col("keys_before"), F.lit(0)), 4)
    return both.select("*", share.alias("kept_share"), ((F.col("n_nulls") == 0) & (F.col("n_outside") == 0)).alias("is_sound"))


def portfolio(quantity: Column, price: Column, quantity_cut: Column, price_cut: Column, at_cut: bool = False) -> Column:
    """The four quadrants: volume counts as high above its cut (with ``at_cut``: at its cut or above), price at its cut
    or above."""
    high_q, high_p = quantity >= quantity_cut if at_cut else quantity > quantity_cut, price >= price_cut
    return F.when(high_q & high_p, "Star Products").when(high_q & ~high_p, "Volume Drivers").when(~high_q & high_p, "Niche Gems").otherwise("Question Marks")


def quantity_bucket(n: Column) -> Column:
    return F.when(n <= 5, n.cast("int").cast("string")).when(n <= 10, "6-10").when(n <= 20, "11-20").when(n <= 50, "21-50").otherwise(">50")


BUCKETS = ["1", "2", "3", "4", "5", "6-10", "11-20", "21-50", ">50"]
