"""Cleaned tables. Every function takes and gives frames, for batch and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orderlake.operators import quality


def geo_coord(geolocation: DataFrame) -> DataFrame:
    """Coordinates inside the country, once each."""
    return geolocation.where(quality.in_bounds()).select(F.col("zip_code").cast("int").alias("zip_code"), F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng")).dropDuplicates()


def users(customer: DataFrame, seller: DataFrame) -> DataFrame:
    one = lambda df, key, kind: df.select(F.lit(kind).alias("user_type"), F.col(key).alias("user_id"), "zip_code")
    return one(customer, "customer_id", "customer").unionByName(one(seller, "seller_id", "seller")).dropDuplicates()


def order_events(status: DataFrame, estimated: DataFrame, items: DataFrame) -> DataFrame:
    """order_id, data_type, timestamp: of statuses, of estimated deliveries and of shipping limits, once each."""
    a = status.select("order_id", F.col("status").alias("data_type"), "timestamp").replace({"approved": "approve"}, subset=["data_type"])
    b = estimated.select("order_id", F.lit("estimated_delivery").alias("data_type"), F.col("estimated_delivery_date").alias("timestamp"))
    c = items.select("order_id", F.lit("shipping_limit").alias("data_type"), F.col("shipping_limit_date").alias("timestamp"))
    return a.unionByName(b).unionByName(c).dropDuplicates()


def product_metadata(product: DataFrame, items: DataFrame) -> DataFrame:
    """product_id, category, seller_id: once each."""
    known = product.dropna(subset=["product_id", "category"]).select("product_id", "category")
    sold = items.select("product_id", "seller_id").dropna().distinct()
    return known.join(sold, "product_id").select("product_id", "category", "seller_id").distinct()


def customer_orders(items: DataFrame, payment: DataFrame) -> DataFrame:
    """Items counted by order, product, seller and price, with the order's customer."""
    counted = items.select("order_id", "product_id", "seller_id", "price").dropna().groupBy("order_id", "product_id", "seller_id", "price").agg(F.count("*").alias("quantity"))
    payer = payment.select("order_id", "customer_id").dropna().distinct()
    return counted.join(payer, "order_id").select("order_id", "customer_id", "product_id", "seller_id", "quantity", F.col("price").alias("unit_price"))


def review_metadata(review: DataFrame) -> DataFrame:
    return review.drop("review_comment_title", "review_comment_message").dropDuplicates()
