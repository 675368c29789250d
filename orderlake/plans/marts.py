"""Silver and gold tables and the serving queries over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from orderlake.operators import gold, quality, silver
from orderlake.plans.twins import CTE, sql
from orderlake.sources import adapters as A
from orderlake.sources.paths import written

CTE |= {
    "s_geo": "SELECT DISTINCT zip_code, lat, lng FROM b_geo WHERE lat BETWEEN -33.69111 AND 2.81972 AND lng BETWEEN -72.89583 AND -34.80861",
    "s_users": "SELECT 'customer' AS user_type, customer_id AS user_id, zip_code FROM b_customer UNION SELECT 'seller', seller_id, zip_code FROM b_seller",
    "s_events": "SELECT order_id, CASE status WHEN 'approved' THEN 'approve' ELSE status END AS data_type, timestamp FROM b_status UNION SELECT order_id, 'estimated_delivery', order_estimated_delivery_timestamp FROM b_times UNION SELECT order_id, 'shipping_limit', shipping_limit_date FROM b_item",
    "s_product": "SELECT DISTINCT product_id, category, seller_id FROM b_product JOIN b_item USING (product_id)",
    "s_order": "SELECT order_id, customer_id, product_id, seller_id, count(*) AS quantity, price AS unit_price FROM b_item JOIN (SELECT DISTINCT order_id, customer_id FROM b_payment) USING (order_id) GROUP BY ALL",
    "g_wide": "SELECT order_id, " + ", ".join(f"max(CASE WHEN data_type = '{s}' THEN timestamp END) AS {s}" for s in gold.STAGES) + " FROM s_events GROUP BY order_id",
    "g_lead": "SELECT *, " + ", ".join(f"date_diff('day', {b}, {a})::INT AS {n}" for n, (a, b) in gold.DURATIONS.items()) + " FROM g_wide",
    "g_location": "SELECT user_type, user_id, zip_code, lat, lng FROM s_users JOIN s_geo USING (zip_code)",
    "g_detail": "SELECT order_id, customer_id, seller_id, product_id, category, quantity, unit_price FROM s_order JOIN s_product USING (product_id, seller_id)",
    "g_sums": "SELECT category, product_id, strftime(delivered_customer, '%Y-%m') AS sales_period, sum(quantity)::BIGINT AS q, sum(quantity * unit_price) AS a FROM g_detail JOIN g_lead USING (order_id) WHERE delivered_customer IS NOT NULL GROUP BY ALL",
    "g_mid": "SELECT *, a / q AS m, quantile_disc(q, 0.5) OVER w AS mq, quantile_disc(a / q, 0.5) OVER w AS mp FROM g_sums WINDOW w AS (PARTITION BY category, sales_period)",
    "g_sales": "SELECT category, product_id, sales_period, CASE WHEN q > mq AND m >= mp THEN 'Star Products' WHEN q > mq THEN 'Volume Drivers' WHEN m >= mp THEN 'Niche Gems' ELSE 'Question Marks' END AS \"group\", q AS total_sales_quantity, round(a, 2) AS total_sales_amount, round(m, 4) AS mean_sales FROM g_mid",
    "g_review": "SELECT DISTINCT * EXCLUDE (review_comment_title, review_comment_message), date_diff('day', review_creation_date, review_answer_timestamp)::INT AS until_answer_lead_days FROM b_review",
}


def geo(spark, sf):
    return silver.geo_coord(A.geolocation(spark, sf))


def users(spark, sf):
    return silver.users(A.customer(spark, sf), A.seller(spark, sf))


def events(spark, sf):
    return silver.order_events(A.order_status(spark, sf), A.estimated_delivery_date(spark, sf), A.order_item(spark, sf))


def products(spark, sf):
    return silver.product_metadata(A.product(spark, sf), A.order_item_plain(spark, sf))


def orders(spark, sf):
    return silver.customer_orders(A.order_item_plain(spark, sf), A.payment(spark, sf))


def lead_days(spark, sf):
    return gold.order_lead_days(events(spark, sf))


def locations(spark, sf):
    return gold.user_location(users(spark, sf), geo(spark, sf))


def detail(spark, sf):
    return gold.order_detail(orders(spark, sf), products(spark, sf))


def sales(spark, sf, lead: DataFrame | None = None, lines: DataFrame | None = None):
    return gold.monthly_sales(lead if lead is not None else lead_days(spark, sf), lines if lines is not None else detail(spark, sf))


def reviews(spark, sf):
    return gold.review_answer_days(silver.review_metadata(A.review(spark, sf)))


def part_of(df: DataFrame, which: str, key: str = "order_id") -> DataFrame:
    """Two sides that overlap and hold all rows together: batch has the keys that end in 0 to 6, the stream those in 5 to 9."""
    digit = F.col(key).cast("long") % 10
    return df.where(digit <= 6 if which == "batch" else digit >= 5)


def serving_locations(spark, sf):
    """Where the buyers and sellers of each order are, batch first."""
    d = written(detail(spark, sf), "detail")
    both = gold.batch_first(part_of(d, "batch"), part_of(d, "stream"), ["order_id", "product_id", "seller_id"])
    who = both.select("order_id", F.lit("customer").alias("user_type"), F.col("customer_id").alias("user_id")).unionByName(both.select("order_id", F.lit("seller").alias("user_type"), F.col("seller_id").alias("user_id"))).distinct()
    where = locations(spark, sf)
    return who.join(gold.known_locations(part_of(where, "batch", "user_id"), part_of(where, "stream", "user_id")), ["user_type", "user_id"]).select("order_id", "user_type", "user_id", "zip_code", "lat", "lng")


def stream_locations(spark, sf):
    d = detail(spark, sf)
    who = d.select("order_id", F.lit("customer").alias("user_type"), F.col("customer_id").alias("user_id")).distinct()
    return who.join(locations(spark, sf), ["user_type", "user_id"]).select("order_id", "user_id", "lat", "lng")


def serving_latest_group(spark, sf):
    """Order lines, batch first, with their product's group of the latest month; ties of months are kept."""
    d = written(detail(spark, sf), "detail")
    both = gold.batch_first(part_of(d, "batch"), part_of(d, "stream"), ["order_id", "product_id", "seller_id"])
    ranked = sales(spark, sf, lines=d).withColumn("rnk", F.rank().over(W.partitionBy("product_id").orderBy(F.desc("sales_period")))).where("rnk = 1").select("product_id", "group", "sales_period")
    return both.join(ranked, "product_id", "left").select("order_id", "product_id", "seller_id", "category", "quantity", "group", "sales_period")


def serving_lead_days(spark, sf):
    """Orders not delivered yet, batch first."""
    lead = written(lead_days(spark, sf), "lead-days")
    return gold.open_orders(part_of(lead, "batch"), part_of(lead, "stream"))


def stream_undelivered(spark, sf):
    return lead_days(spark, sf).where("delivered_customer IS NULL")


def serving_product_lead_days(spark, sf):
    lead, lines = written(lead_days(spark, sf), "lead-days"), written(detail(spark, sf), "detail")
    sold = sales(spark, sf, lead, lines)
    lead = lead.where("delivered_customer IS NOT NULL").withColumn("sales_period", gold.sales_period("delivered_customer"))
    return lead.join(lines.select("order_id", "product_id", "seller_id"), "order_id").join(sold.select("product_id", "sales_period", "group", "category"), ["product_id", "sales_period"]).select("order_id", "product_id", "seller_id", "category", "sales_period", "group", *gold.DURATIONS)


def serving_product_review(spark, sf):
    """Reviews of a product in the month of its sales, one row for each order line."""
    r = reviews(spark, sf).select("review_id", "order_id", "review_score", "until_answer_lead_days", gold.sales_period("review_creation_date").alias("sales_period"))
    lines = detail(spark, sf).select("order_id", "product_id", "seller_id")
    return r.join(lines, "order_id").join(sales(spark, sf), ["product_id", "sales_period"]).select("review_id", "order_id", "product_id", "seller_id", "category", "sales_period", "group", "review_score", "until_answer_lead_days").orderBy("category", "product_id", "sales_period", "review_id")


QUERIES = {
    "geo_bounds": geo, "user_union": users, "order_event_long": events, "product_metadata": products, "customer_order": orders, "review_metadata": lambda s, d: silver.review_metadata(A.review(s, d)),
    "user_location": locations, "order_lead_days": lead_days, "order_detail": detail, "monthly_sales": sales, "review_answer_days": reviews,
    "geo_bounds_reject": lambda s, d: A.geolocation(s, d).where(~quality.in_bounds(box=(quality.WIDE_LAT, quality.WIDE_LNG))),
    "serving_locations": serving_locations, "serving_stream_locations": stream_locations, "serving_latest_group": serving_latest_group, "serving_lead_days": serving_lead_days,
    "serving_stream_lead_days": stream_undelivered, "serving_product_lead_days": serving_product_lead_days, "serving_product_review": serving_product_review,
}

D10 = "order_id::BIGINT % 10"
CTE |= {
    "v_detail": f"SELECT * FROM g_detail WHERE {D10} <= 6 UNION ALL SELECT * FROM g_detail AS s WHERE {D10} >= 5 AND NOT EXISTS (SELECT 1 FROM g_detail AS b WHERE b.order_id::BIGINT % 10 <= 6 AND b.order_id = s.order_id AND b.product_id = s.product_id AND b.seller_id = s.seller_id)",
    "v_open": f"SELECT * FROM g_lead WHERE delivered_customer IS NULL AND {D10} <= 6 UNION ALL SELECT * FROM g_lead AS s WHERE delivered_customer IS NULL AND {D10} >= 5 AND NOT EXISTS (SELECT 1 FROM g_lead AS b WHERE b.order_id::BIGINT % 10 <= 6 AND b.order_id = s.order_id)",
    "v_latest": 'SELECT product_id, "group", sales_period FROM (SELECT *, rank() OVER (PARTITION BY product_id ORDER BY sales_period DESC) AS rnk FROM g_sales) WHERE rnk = 1',
}
ORACLE_SQL = {
    "geo_bounds": sql("SELECT * FROM s_geo"), "user_union": sql("SELECT * FROM s_users"), "order_event_long": sql("SELECT * FROM s_events"), "product_metadata": sql("SELECT * FROM s_product"),
    "customer_order": sql("SELECT * FROM s_order"), "review_metadata": sql("SELECT DISTINCT * EXCLUDE (review_comment_title, review_comment_message) FROM b_review"), "user_location": sql("SELECT * FROM g_location"),
    "order_lead_days": sql("SELECT * FROM g_lead"), "order_detail": sql("SELECT * FROM g_detail"), "monthly_sales": sql("SELECT * FROM g_sales"), "review_answer_days": sql("SELECT * FROM g_review"),
    "geo_bounds_reject": sql("SELECT * FROM b_geo WHERE NOT (lat BETWEEN -33.75 AND 5.27 AND lng BETWEEN -73.98 AND -34.79)"),
    "serving_locations": sql("SELECT order_id, user_type, user_id, zip_code, lat, lng FROM (SELECT order_id, 'customer' AS user_type, customer_id AS user_id FROM v_detail UNION SELECT order_id, 'seller', seller_id FROM v_detail) JOIN g_location USING (user_type, user_id)"),
    "serving_stream_locations": sql("SELECT order_id, user_id, lat, lng FROM (SELECT DISTINCT order_id, 'customer' AS user_type, customer_id AS user_id FROM g_detail) JOIN g_location USING (user_type, user_id)"),
    "serving_latest_group": sql('SELECT order_id, product_id, seller_id, category, quantity, "group", sales_period FROM v_detail LEFT JOIN v_latest USING (product_id)'),
    "serving_lead_days": sql("SELECT * FROM v_open"),
    "serving_stream_lead_days": sql("SELECT * FROM g_lead WHERE delivered_customer IS NULL"),
    "serving_product_lead_days": sql(
        'SELECT order_id, product_id, seller_id, category, sales_period, "group", ' + ", ".join(gold.DURATIONS) + " FROM t_sold JOIN t_group USING (product_id, sales_period)",
        t_delivered="SELECT order_id, strftime(delivered_customer, '%Y-%m') AS sales_period, " + ", ".join(gold.DURATIONS) + " FROM g_lead WHERE delivered_customer IS NOT NULL",
        t_sold="SELECT * FROM t_delivered JOIN (SELECT order_id, product_id, seller_id FROM g_detail) USING (order_id)",
        t_group='SELECT product_id, sales_period, category, "group" FROM g_sales',
    ),
    "serving_product_review": sql("SELECT review_id, order_id, s.product_id, seller_id, s.category, s.sales_period, s.\"group\", review_score, until_answer_lead_days FROM g_review AS r JOIN (SELECT order_id, product_id, seller_id FROM g_detail) AS d USING (order_id) JOIN g_sales AS s ON s.product_id = d.product_id AND s.sales_period = strftime(r.review_creation_date, '%Y-%m')"),
}
