"""Files, envelopes, snapshots and merges at work on the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from orderlake.operators import merge, shapes
from orderlake.plans import marts
from orderlake.plans.twins import CTE, sql
from orderlake.sources import adapters as A, envelope, files, snapshots
from orderlake.sources.contracts import BRONZE, project
from orderlake.sources.paths import fresh

DAYS = ["2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-03 00:00:00"]


def csv_round_trip(spark, sf):
    rows = A.raw(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"), "o_totalprice")
    files.write_delimited(rows, path := fresh(spark, "orders-tsv"))
    return files.read_delimited(spark, path, rows.schema)


def items_table(spark, sf) -> snapshots.Table:
    items = A.raw(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    t = snapshots.Table(spark, fresh(spark, "items"), items.schema)
    return snapshots.commit_parts(t, [items.where(F.col("l_orderkey") % 3 == k) for k in range(3)], DAYS)


def snapshot_list(spark, sf):
    t = items_table(spark, sf)
    each = [t.between(k, k + 1).agg(F.count("*").alias("n_rows")).select(F.lit(k + 1).cast("long").alias("commit_id"), "n_rows") for k in range(3)]
    return t.log().select("commit_id", F.date_format("committed_at", "yyyy-MM-dd").alias("committed_on")).join(reduce(DataFrame.unionByName, each), "commit_id")


def incremental_runs(spark, sf):
    """Three runs of a job on the table: the earliest commit, the others, nothing."""
    t, last, out = items_table(spark, sf), None, []
    for run in (1, 2, 3):
        rows, last = snapshots.incremental(t, last)
        out.append(rows.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("l_quantity"), F.lit(0.0)).alias("quantity")).select(F.lit(run).alias("run"), "n_rows", "quantity", F.lit(last).cast("long").alias("read_to")))
    return reduce(DataFrame.unionByName, out)


def compacted(spark, sf):
    t = items_table(spark, sf)
    t.compact(2, "2024-01-04 00:00:00", files=2)
    commits = t.log().agg(F.count("*").alias("n_commits"))
    rows = t.read()
    return shapes.dealt(rows, rows, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")).crossJoin(F.broadcast(commits))  # one row


def watermark_upsert(spark, sf):
    """Progress marks of two apps, one of which has run twice."""
    t = items_table(spark, sf)
    marks = spark.createDataFrame([], "app_name string, src string, last_processed_snapshot_id long")
    edge = t.boundary().first()
    for app, commit in (("silver_user", edge["earliest"]), ("silver_event", edge["earliest"]), ("silver_user", edge["latest"])):
        marks = snapshots.upsert_mark(marks, app, "items", commit)
    return marks


def envelope_log(spark, sf):
    """Customers and payments in one log."""
    payment = A.payment(spark, sf)
    return envelope.encode(A.customer(spark, sf), "bronze.customer", ["customer_id"]).unionByName(envelope.encode(payment, "bronze.payment", ["order_id"], 2))


def envelope_encode(spark, sf):
    log = envelope.encode(A.customer(spark, sf), "bronze.customer", ["customer_id"], 7)
    return log.select(F.col("key").cast("string").alias("key"), F.hex(F.substring("value", 1, 5)).alias("header"), F.substring("value", 6, 1000).cast("string").alias("body"), "topic")


def envelope_decode(spark, sf):
    rows = envelope.decode(envelope_log(spark, sf), "bronze.payment", envelope.contract_of("bronze.payment"))
    return rows.where(F.col(envelope.CORRUPT).isNull()).drop(envelope.CORRUPT)


def partition_overwrite(spark, sf):
    o = A.raw(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    o.write.partitionBy("o_orderstatus").parquet(path := fresh(spark, "orders-by-status"))
    files.overwrite_partitions(o.where("o_orderstatus = 'P' AND o_orderkey % 2 = 0"), path, ["o_orderstatus"])
    return spark.read.schema(o.schema).parquet(path).select("o_orderkey", "o_totalprice", "o_orderstatus")


def sides(spark, sf):
    """A target and a source of order lines that overlap; the source has other quantities, categories and nulls."""
    d = marts.detail(spark, sf)
    one = d.groupBy("order_id", "product_id").agg(F.max("category").alias("category"), F.sum("quantity").alias("quantity"), F.max("unit_price").alias("unit_price"))
    key = F.col("order_id").cast("long")
    target = one.where(key % 10 <= 6)
    changed = one.where(key % 10 >= 5).withColumn("quantity", F.when(key % 4 == 0, F.col("quantity") + 1).otherwise(F.col("quantity"))).withColumn("category", F.when(key % 3 == 0, None).otherwise(F.col("category"))).withColumn("unit_price", F.col("unit_price") + 1)
    return target, changed


LINE_KEY = ["order_id", "product_id"]


def merge_insert_only(spark, sf):
    customers = A.customer(spark, sf)
    key = F.col("customer_id").cast("long")
    return merge.insert_only(customers.where(key % 3 == 0), customers.withColumn("zip_code", F.lit(99)), ["customer_id"])


def merge_insert_only_2key(spark, sf):
    u = marts.users(spark, sf)
    key = F.col("user_id").cast("long")
    return merge.insert_only(u.where(key % 3 == 0), u.withColumn("zip_code", F.lit(99)), ["user_type", "user_id"])


CTE |= {
    "m_one": "SELECT order_id, product_id, max(category) AS category, sum(quantity)::BIGINT AS quantity, max(unit_price) AS unit_price FROM g_detail GROUP BY 1, 2",
    "m_t": "SELECT * FROM m_one WHERE order_id::BIGINT % 10 <= 6",
    "m_s": "SELECT order_id, product_id, CASE WHEN order_id::BIGINT % 3 = 0 THEN NULL ELSE category END AS category, CASE WHEN order_id::BIGINT % 4 = 0 THEN quantity + 1 ELSE quantity END AS quantity, unit_price + 1 AS unit_price FROM m_one WHERE order_id::BIGINT % 10 >= 5",
}
FULL = "SELECT coalesce(t.order_id, s.order_id) AS order_id, coalesce(t.product_id, s.product_id) AS product_id, {} FROM m_t AS t FULL JOIN m_s AS s ON t.order_id = s.order_id AND t.product_id = s.product_id"
MEASURES = ["category", "quantity", "unit_price"]
INSERT = "SELECT {c}, zip_code FROM {t} WHERE {k}::BIGINT % 3 = 0 UNION ALL SELECT {c}, 99 FROM {t} WHERE {k}::BIGINT % 3 <> 0"

QUERIES = {
    "csv_round_trip": csv_round_trip,
    "snapshot_as_of": lambda s, d: items_table(s, d).as_of(2),
    "snapshot_incremental": lambda s, d: items_table(s, d).between(1, 3),
    "snapshot_list": snapshot_list,
    "snapshot_boundary": lambda s, d: items_table(s, d).boundary(),
    "incremental_runs": incremental_runs,
    "contract_project": lambda s, d: project(A.payment(s, d), BRONZE["payment"]),
    "compact_table": compacted,
    "watermark_upsert": watermark_upsert,
    "envelope_encode": envelope_encode,
    "envelope_decode": envelope_decode,
    "composite_key": lambda s, d: marts.detail(s, d).select(envelope.composite_key(["order_id", "product_id", "seller_id"]).alias("key"), "quantity"),
    "partition_overwrite": partition_overwrite,
    "merge_insert_only": merge_insert_only,
    "merge_insert_only_2key": merge_insert_only_2key,
    "merge_coalesce": lambda s, d: merge.coalesce(*sides(s, d), LINE_KEY),
    "merge_conditional": lambda s, d: merge.conditional(*sides(s, d), LINE_KEY, ["quantity", "category"]),
    "merge_overwrite": lambda s, d: merge.overwrite(*sides(s, d), LINE_KEY),
}
ITEMS = "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey % 3 IN ({})"
ORACLE_SQL = {
    "csv_round_trip": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE o_orderpriority END AS o_orderpriority, o_totalprice FROM orders",
    "snapshot_as_of": ITEMS.format("0, 1"),
    "snapshot_incremental": ITEMS.format("1, 2"),
    "snapshot_list": "SELECT l_orderkey % 3 + 1 AS commit_id, '2024-01-0' || (l_orderkey % 3 + 1) AS committed_on, count(*) AS n_rows FROM lineitem GROUP BY 1, 2",
    "snapshot_boundary": "SELECT min(l_orderkey % 3 + 1) AS earliest, max(l_orderkey % 3 + 1) AS latest FROM lineitem",
    "incremental_runs": "SELECT 1 AS run, count(*) AS n_rows, sum(l_quantity) AS quantity, 1::BIGINT AS read_to FROM lineitem WHERE l_orderkey % 3 = 0 UNION ALL SELECT 2, count(*), sum(l_quantity), 3 FROM lineitem WHERE l_orderkey % 3 > 0 UNION ALL SELECT 3, 0, 0.0, 3",
    "contract_project": sql("SELECT * FROM b_payment"),
    "compact_table": "SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS quantity, 3::BIGINT AS n_commits FROM lineitem GROUP BY 1",
    "watermark_upsert": "SELECT * FROM (SELECT 'silver_user' AS app_name, 'items' AS src, max(l_orderkey % 3 + 1) AS last_processed_snapshot_id FROM lineitem UNION ALL SELECT 'silver_event', 'items', min(l_orderkey % 3 + 1) FROM lineitem)",
    "envelope_encode": sql("SELECT customer_id AS key, '0000000007' AS header, '{\"zip_code\":' || zip_code || '}' AS body, 'bronze.customer' AS topic FROM b_customer"),
    "envelope_decode": sql("SELECT * FROM b_payment"),
    "composite_key": sql("SELECT order_id || '-' || product_id || '-' || seller_id AS key, quantity FROM g_detail"),
    "partition_overwrite": "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus <> 'P' OR o_orderkey % 2 = 0",
    "merge_insert_only": sql(INSERT.format(c="customer_id", k="customer_id", t="b_customer")),
    "merge_insert_only_2key": sql(INSERT.format(c="user_type, user_id", k="user_id", t="s_users")),
    "merge_coalesce": sql(FULL.format(", ".join(f"coalesce(s.{c}, t.{c}) AS {c}" for c in MEASURES))),
    "merge_conditional": sql(FULL.format(", ".join(f"CASE WHEN t.order_id IS NULL OR (s.order_id IS NOT NULL AND (s.quantity <> t.quantity OR s.category <> t.category)) THEN s.{c} ELSE t.{c} END AS {c}" for c in MEASURES))),
    "merge_overwrite": sql(FULL.format(", ".join(f"CASE WHEN s.order_id IS NOT NULL THEN s.{c} ELSE t.{c} END AS {c}" for c in MEASURES))),
}
