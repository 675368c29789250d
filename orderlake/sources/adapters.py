"""The bronze tables, out of the driver's tables by plain arithmetic; timestamps stay without zone.

``SQL`` has the same tables as common table expressions, for the SQL twins of the queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def days_later(ts: str, n: Column) -> Column:
    return F.timestamp_add("DAY", n, F.col(ts))


def customer(spark, sf):
    return raw(spark, sf, "customer").select(text("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("zip_code"))


def seller(spark, sf):
    return raw(spark, sf, "supplier").select(text("s_suppkey").alias("seller_id"), F.col("s_nationkey").alias("zip_code"))


def geolocation(spark, sf):
    n, r = raw(spark, sf, "nation"), raw(spark, sf, "region")
    key = F.col("n_nationkey")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(key.alias("zip_code"), (2.0 * key - 40.0).alias("lat"), (2.0 * key - 80.0).alias("lng"), F.col("r_name").alias("state"), F.col("n_name").alias("city"))


def order_item(spark, sf):
    i, o = raw(spark, sf, "lineitem"), raw(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    product = F.col("l_partkey") % 40
    return i.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        text("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("order_item_id"),
        days_later("o_orderdate", (3 + F.col("l_orderkey") % 5).cast("int")).alias("shipping_limit_date"),
        (10.0 + product).alias("price"), (F.col("l_tax") * 100).alias("freight_value"), text(product).alias("product_id"), text(F.col("l_suppkey") % 2).alias("seller_id"),
    )


def order_item_plain(spark, sf):
    """Items without the shipping limit: no join, for queries that don't ask for it."""
    product = F.col("l_partkey") % 40
    return raw(spark, sf, "lineitem").select(text("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("order_item_id"), (10.0 + product).alias("price"), (F.col("l_tax") * 100).alias("freight_value"), text(product).alias("product_id"), text(F.col("l_suppkey") % 2).alias("seller_id"))


def product(spark, sf):
    p = raw(spark, sf, "lineitem").select((F.col("l_partkey") % 40).alias("p")).distinct()
    return p.select(text("p").alias("product_id"), F.concat(F.lit("C"), text(F.col("p") % 8)).alias("category"))


def payment(spark, sf):
    return raw(spark, sf, "orders").select(
        text("o_orderkey").alias("order_id"), F.lit(1).alias("payment_sequential"), F.col("o_orderdate").alias("timestamp"), F.col("o_totalprice").alias("payment_value"),
        F.col("o_orderpriority").alias("payment_type"), (1 + F.col("o_orderkey") % 12).cast("int").alias("payment_installments"), text("o_custkey").alias("customer_id"),
    )


def order_times(spark, sf):
    """One row per order: order_id, customer_id, order_status and its times."""
    o, key = raw(spark, sf, "orders"), F.col("o_orderkey")
    open_, done = F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F"
    carrier = (2 + key % 10).cast("int")
    return o.select(
        text("o_orderkey").alias("order_id"), text("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("order_status"), F.col("o_orderdate").alias("order_purchase_timestamp"),
        F.when(open_, days_later("o_orderdate", F.lit(1))).alias("order_approved_timestamp"),
        F.when(open_, days_later("o_orderdate", carrier)).alias("order_delivered_carrier_timestamp"),
        F.when(done, days_later("o_orderdate", (carrier + key * 7 % 36).cast("int"))).alias("order_delivered_customer_timestamp"),
        days_later("o_orderdate", F.lit(30)).alias("order_estimated_delivery_timestamp"),
    )


STATUS = ["purchase", "approved", "delivered_carrier", "delivered_customer"]


def order_status(spark, sf):
    t = order_times(spark, sf)
    long = t.unpivot(["order_id"], [f"order_{s}_timestamp" for s in STATUS], "column", "timestamp").where("timestamp IS NOT NULL")
    return long.select("order_id", F.regexp_extract("column", "^order_(.*)_timestamp$", 1).alias("status"), "timestamp")


def estimated_delivery_date(spark, sf):
    return order_times(spark, sf).select("order_id", F.col("order_estimated_delivery_timestamp").alias("estimated_delivery_date"))


def review(spark, sf):
    d, lab, o = raw(spark, sf, "documents"), raw(spark, sf, "labels"), raw(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    rows = d.join(lab, "doc_id", "left").join(o, F.col("doc_id") == F.col("o_orderkey"))
    q, x = F.col("quality"), F.col("toxic")
    score = F.when(q.isNull(), 4).when((q == 1) & (x == 0), 5).when((q == 1) & (x == 1), 3).when((q == 0) & (x == 0), 2).otherwise(1)
    return rows.select(
        text("doc_id").alias("review_id"), text("doc_id").alias("order_id"), F.col("o_orderdate").alias("review_creation_date"), days_later("o_orderdate", (F.col("doc_id") % 9).cast("int")).alias("review_answer_timestamp"),
        score.alias("review_score"), F.col("source").alias("review_comment_title"), F.col("text").alias("review_comment_message"),
    )


SQL = {
    "b_customer": "SELECT c_custkey::VARCHAR AS customer_id, c_nationkey AS zip_code FROM customer",
    "b_seller": "SELECT s_suppkey::VARCHAR AS seller_id, s_nationkey AS zip_code FROM supplier",
    "b_geo": "SELECT n_nationkey AS zip_code, 2.0::DOUBLE * n_nationkey - 40 AS lat, 2.0::DOUBLE * n_nationkey - 80 AS lng, r_name AS state, n_name AS city FROM nation JOIN region ON n_regionkey = r_regionkey",
    "b_item": "SELECT l_orderkey::VARCHAR AS order_id, l_linenumber AS order_item_id, o_orderdate + to_days((3 + l_orderkey % 5)::INT) AS shipping_limit_date, 10.0::DOUBLE + l_partkey % 40 AS price, l_tax * 100 AS freight_value, (l_partkey % 40)::VARCHAR AS product_id, (l_suppkey % 2)::VARCHAR AS seller_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "b_product": "SELECT DISTINCT (l_partkey % 40)::VARCHAR AS product_id, 'C' || (l_partkey % 40 % 8)::VARCHAR AS category FROM lineitem",
    "b_payment": "SELECT o_orderkey::VARCHAR AS order_id, 1 AS payment_sequential, o_orderdate AS timestamp, o_totalprice AS payment_value, o_orderpriority AS payment_type, (1 + o_orderkey % 12)::INT AS payment_installments, o_custkey::VARCHAR AS customer_id FROM orders",
    "b_times": """SELECT o_orderkey::VARCHAR AS order_id, o_custkey::VARCHAR AS customer_id, o_orderstatus AS order_status, o_orderdate AS order_purchase_timestamp,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + to_days(1) END AS order_approved_timestamp,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + to_days((2 + o_orderkey % 10)::INT) END AS order_delivered_carrier_timestamp,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_days((2 + o_orderkey % 10 + o_orderkey * 7 % 36)::INT) END AS order_delivered_customer_timestamp,
  o_orderdate + to_days(30) AS order_estimated_delivery_timestamp FROM orders""",
    "b_status": """SELECT order_id, 'purchase' AS status, order_purchase_timestamp AS timestamp FROM b_times WHERE order_purchase_timestamp IS NOT NULL
  UNION ALL SELECT order_id, 'approved', order_approved_timestamp FROM b_times WHERE order_approved_timestamp IS NOT NULL
  UNION ALL SELECT order_id, 'delivered_carrier', order_delivered_carrier_timestamp FROM b_times WHERE order_delivered_carrier_timestamp IS NOT NULL
  UNION ALL SELECT order_id, 'delivered_customer', order_delivered_customer_timestamp FROM b_times WHERE order_delivered_customer_timestamp IS NOT NULL""",
    "b_review": """SELECT d.doc_id::VARCHAR AS review_id, d.doc_id::VARCHAR AS order_id, o_orderdate AS review_creation_date, o_orderdate + to_days((d.doc_id % 9)::INT) AS review_answer_timestamp,
  CASE WHEN quality IS NULL THEN 4 WHEN quality = 1 AND toxic = 0 THEN 5 WHEN quality = 1 AND toxic = 1 THEN 3 WHEN quality = 0 AND toxic = 0 THEN 2 ELSE 1 END AS review_score, source AS review_comment_title, text AS review_comment_message
  FROM documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id JOIN orders ON d.doc_id = o_orderkey""",
}
