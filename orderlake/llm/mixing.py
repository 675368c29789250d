"""Mixing sources to target weights by Poisson replication.

A source with n of N documents and target weight q has the mean repetition rate q * N / n. Every document's count is a
Poisson variate of that mean, found by inverting the distribution at a uniform number that a hash of seed and identifier
gives; so counts are repeatable, need no coordination, and come out the same for repeated rows. Documents are exploded
by their count and dealt over all partitions by a hash of identifier and copy, in whose order they are written.

The rates are one row per source. They are broadcast only after their number is checked; beyond ``broadcast_rows`` they
are joined by source and a salt, so that a source that holds a third of all rows is spread over ``salts`` tasks.

Defined results: a null source is a source of its own; a target of zero, or a source that ``targets`` doesn't name,
gives no copies; an empty table gives no rows; repeated rows are replicated alike; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orderlake.llm.common import table

SEED, ALPHA = "mix-1", 0.5
#: A mean beyond this is split in equal parts, each with a uniform number of its own; the terms below reach 1 for it.
PART, TERMS = 32.0, 160


def uniform(seed: str, *parts: Column) -> Column:
    """52 bits of an MD5 as a number in [0, 1)."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2**52))


def rates(df: DataFrame, source_col: str = "source", targets: Mapping[str, float] | None = None, alpha: float = ALPHA) -> DataFrame:
    """source_key, mean, n_parts, cdf. Without ``targets``, weights are the counts to the power ``alpha``."""
    counts = df.groupBy(source_key(source_col).alias("source_key")).agg(F.count("*").alias("n"))
    if targets is None:
        weights = counts.withColumn("q", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    else:
        given = F.create_map(*[F.lit(x) for k, v in targets.items() for x in (f"s{k}", float(v))]) if targets else F.lit(None).cast("map<string,double>")
        weights = counts.withColumn("q", F.coalesce(F.try_element_at(given, F.col("source_key")), F.lit(0.0)))
    totals = weights.agg(F.sum("n").alias("all_n"), F.sum("q").alias("all_q"))
    mean = F.when(F.col("all_q") > 0, F.col("q") / F.col("all_q") * F.col("all_n") / F.col("n")).otherwise(0.0)
    out = weights.crossJoin(F.broadcast(totals)).select("source_key", mean.alias("mean"))  # totals: one row
    out = out.withColumn("n_parts", F.greatest(F.ceil(F.col("mean") / PART), F.lit(1)).cast("int"))
    return out.withColumn("cdf", poisson_cdf(F.col("mean") / F.col("n_parts")))


def poisson_cdf(mean: Column) -> Column:
    """P(X <= k) for k from 0, as an array."""
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))
    grow = lambda s, k: F.struct((s["p"] * mean / k).alias("p"), (s["c"] + s["p"] * mean / k).alias("c"), F.concat(s["all"], F.array(s["c"] + s["p"] * mean / k)).alias("all"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, grow, lambda s: s["all"])


def source_key(source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null"))


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", targets: Mapping[str, float] | None = None, alpha: float = ALPHA, seed: str = SEED, broadcast_rows: int = 10_000, salts: int = 64, copy_col: str | None = None) -> DataFrame:
    """The replicated rows with the input's columns, and the number of the copy if ``copy_col`` names a column."""
    found = rates(df, source_col, targets, alpha)
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).alias("id"), source_key(source_col).alias("source_key"))
    if found.limit(broadcast_rows + 1).count() <= broadcast_rows:
        joined = whole.join(F.broadcast(found), "source_key")
    else:
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = whole.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(salted, ["source_key", "salt"])
    part = lambda k: F.size(F.filter(F.col("cdf"), lambda c: uniform(seed, F.col("id"), k) >= c))
    first = joined.withColumn("u", uniform(seed, F.col("id"), F.lit(1)))
    n = F.size(F.filter("cdf", lambda c: F.col("u") >= c)) + F.when(F.col("n_parts") > 1, F.aggregate(F.sequence(F.lit(2), F.greatest("n_parts", F.lit(2))), F.lit(0), lambda s, k: s + part(k))).otherwise(0)
    counted = first.withColumn("n", n).where("n > 0")
    copies = counted.select("row", "id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    dealt = copies.withColumn("at", F.xxhash64(F.lit(seed), F.col("id"), F.col("copy"))).repartition(F.col("at")).sortWithinPartitions("at")
    return dealt.select("row.*", *([F.col("copy").alias(copy_col)] if copy_col else []))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return mix(docs, copy_col="copy")


MIX_SQL = """
n AS (SELECT coalesce('s' || source, 'null') AS k, count(*) AS n FROM {docs} GROUP BY 1),
r AS (SELECT k, pow(n::DOUBLE, 0.5) / sum(pow(n::DOUBLE, 0.5)) OVER () * sum(n) OVER () / n AS mean FROM n),
terms AS (SELECT k, i, CASE WHEN i = 0 THEN exp(-mean) ELSE exp(i * ln(mean) - mean - lgamma(i + 1)) END AS p FROM r, (SELECT unnest(range(161)) AS i)),
cdf AS (SELECT k, i, sum(p) OVER (PARTITION BY k ORDER BY i) AS c FROM terms),
u AS (SELECT *, ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null') || ':1'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u, coalesce('s' || source, 'null') AS k FROM {docs}),
counts AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, (SELECT count(*) FROM cdf WHERE cdf.k = u.k AND cdf.c <= u.u) AS n FROM u),
mixed AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n + 1))::INT AS copy FROM counts)
"""
OP5_SQL = "WITH " + MIX_SQL.format(docs="documents").strip() + "\nSELECT doc_id, text, lang, source, n_chars, copy FROM mixed\n"
