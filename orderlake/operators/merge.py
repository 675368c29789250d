"""Keyed merges, as joins that give the target's new state.

Null keys never match, as with SQL ``=``: such source rows are inserted. A source with two rows of one key would make an
update ambiguous; ``single`` keeps the last by an order, and updates check for it as they run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def single(source: DataFrame, on: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by ``order``."""
    return source.withColumn("__r", F.row_number().over(W.partitionBy(*on).orderBy(*order))).where("__r = 1").drop("__r")


def insert_only(target: DataFrame, source: DataFrame, on: list[str]) -> DataFrame:
    """The target and the source's rows of new keys; of several with one key, the least of their values."""
    return target.unionByName(new_rows(target, source, on))


def new_rows(target: DataFrame, source: DataFrame, on: list[str], single: bool = True) -> DataFrame:
    """What an insert-only merge adds to its target; an append-only table needs no more. Without ``single``, all source rows of
    a new key, as MERGE inserts them."""
    rest = [c for c in target.columns if c not in on]
    keyed = F.lit(True)
    for c in on:
        keyed = keyed & F.col(c).isNotNull()
    rows = source.select(*target.columns)
    if not single:  # null keys meet nothing here
        return rows.join(target.select(*on), on, "left_anti").select(*target.columns)
    one = rows.where(keyed)
    one = one.groupBy(*on).agg(F.min(F.struct(*rest)).alias("__v")).select(*on, "__v.*") if rest else one.distinct()
    new = one.select(*target.columns).join(target.select(*on), on, "left_anti").select(*target.columns)
    return new.unionByName(rows.where(~keyed))


def latest(rows: DataFrame, on: list[str], order: str) -> DataFrame:
    """The state after coalescing merges of ``rows`` one after another by ``order``: per key and column the last value that
    isn't null. One aggregation at the reader instead of a rewritten target for each merge; null keys are one key here."""
    rest = [c for c in rows.columns if c not in (*on, order)]
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("o"), F.col(c).alias("v"))))["v"].alias(c)
    return rows.groupBy(*on).agg(*[last(c) for c in rest])


def update(target: DataFrame, source: DataFrame, on: list[str], value, when: Column | None = None) -> DataFrame:
    """Full outer join on the key. Where both sides match (and ``when`` holds, which sees columns as t_ and s_), a column
    becomes ``value(source, target)``; source rows of new keys are inserted."""
    rest = [c for c in target.columns if c not in on]
    counted = source.select(*target.columns).groupBy(*on).agg(F.count("*").alias("__n"), F.min(F.struct(*rest)).alias("__s"))
    checked = counted.withColumn("__s", F.when((F.col("__n") > 1) & ~_any_null(on), F.raise_error(F.concat(F.lit("several source rows have one key: "), F.concat_ws(",", *[F.col(c).cast("string") for c in on]))).cast(counted.schema["__s"].dataType)).otherwise(F.col("__s")))
    loose = source.select(*target.columns).where(_any_null(on))
    s = checked.where(~_any_null(on)).select(*[F.col(c).alias(f"s_{c}") for c in on], *[F.col(f"__s.{c}").alias(f"s_{c}") for c in rest], F.lit(True).alias("__in_s"))
    t = target.select(*[F.col(c).alias(f"t_{c}") for c in target.columns], F.lit(True).alias("__in_t"))
    match = F.lit(True)
    for c in on:
        match = match & (F.col(f"t_{c}") == F.col(f"s_{c}"))
    both = t.join(s, match, "full_outer")
    hit = F.col("__in_s") & F.col("__in_t") if when is None else F.col("__in_s") & F.col("__in_t") & F.coalesce(when, F.lit(False))
    pick = lambda c: F.when(F.col("__in_t").isNull(), F.col(f"s_{c}")).when(hit, value(F.col(f"s_{c}"), F.col(f"t_{c}"))).otherwise(F.col(f"t_{c}")).alias(c)
    out = both.select(*[F.coalesce(f"t_{c}", f"s_{c}").alias(c) if c in on else pick(c) for c in target.columns])
    return out.unionByName(loose)


def _any_null(on: list[str]) -> Column:
    found = F.lit(False)
    for c in on:
        found = found | F.col(c).isNull()
    return found


def coalesce(target: DataFrame, source: DataFrame, on: list[str]) -> DataFrame:
    """On a match, a source value that isn't null replaces the target's."""
    return update(target, source, on, lambda s, t: F.coalesce(s, t))


def conditional(target: DataFrame, source: DataFrame, on: list[str], differs: list[str]) -> DataFrame:
    """On a match, the source's values if one of ``differs`` does."""
    when = F.lit(False)
    for c in differs:
        when = when | (F.col(f"s_{c}") != F.col(f"t_{c}"))
    return update(target, source, on, lambda s, t: s, when)


def overwrite(target: DataFrame, source: DataFrame, on: list[str]) -> DataFrame:
    """On a match, the source's values."""
    return update(target, source, on, lambda s, t: s)
