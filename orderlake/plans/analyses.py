"""Analyses of orders, sales, delivery and reviews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from orderlake.functions.folding import fold_accents, middle_name, parse_timestamp
from orderlake.operators import gold, quality, relations, shapes
from orderlake.plans import marts
from orderlake.plans.twins import CTE, sql
from orderlake.sources import adapters as A

CTE |= {
    "a_city": "SELECT c_nationkey AS zip_code, CASE c_custkey % 4 WHEN 0 THEN 'São Paulo' WHEN 1 THEN 'sao paulo' WHEN 2 THEN c_mktsegment ELSE n_name END AS city, 2.0::DOUBLE * c_nationkey - 40 + c_custkey % 3 AS lat, 2.0::DOUBLE * c_nationkey - 80 + c_custkey % 5 AS lng FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "a_fold": "SELECT zip_code, translate(lower(city), 'ãáàâäéêèëíîìïóôõòöúûùüçñ', 'aaaaaeeeeiiiiooooouuuucn') AS city, lat, lng FROM a_city",
    "a_mode": "SELECT zip_code, city, n FROM (SELECT zip_code, city, count(*) AS n, row_number() OVER (PARTITION BY zip_code ORDER BY count(*) DESC, city) AS r FROM a_fold GROUP BY zip_code, city) WHERE r = 1",
    "a_line": "SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, p_type AS category, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey",
    "a_late": "SELECT *, CASE WHEN delivered_customer IS NULL OR estimated_delivery IS NULL THEN NULL WHEN date_diff('day', delivered_customer, estimated_delivery) < 0 THEN 'late' ELSE 'on_time' END AS delivery_flag, CASE WHEN delivered_carrier IS NULL OR shipping_limit IS NULL THEN NULL WHEN date_diff('day', delivered_carrier, shipping_limit) < 0 THEN 'late' ELSE 'on_time' END AS shipping_flag FROM g_lead",
}


def raw_city(spark, sf):
    """Customers as rows of a raw geolocation table, city names in several spellings."""
    c, n = A.raw(spark, sf, "customer"), A.raw(spark, sf, "nation")
    key = F.col("c_custkey") % 4
    city = F.when(key == 0, "São Paulo").when(key == 1, "sao paulo").when(key == 2, F.col("c_mktsegment")).otherwise(F.col("n_name"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_nationkey").alias("zip_code"), city.alias("city"), (2.0 * F.col("c_nationkey") - 40 + F.col("c_custkey") % 3).alias("lat"), (2.0 * F.col("c_nationkey") - 80 + F.col("c_custkey") % 5).alias("lng"))


def mode_city(df: DataFrame) -> DataFrame:
    """The most frequent city of each zip code, spellings folded; ties go by name."""
    counted = df.select("zip_code", fold_accents(F.col("city")).alias("city")).groupBy("zip_code", "city").agg(F.count("*").alias("n"))
    return shapes.best(counted, ["zip_code"], [F.desc("n"), F.asc("city")])


def city_normalised(df: DataFrame, known: DataFrame) -> DataFrame:
    """Each row's city as the mode of its zip code, 'unknown' where there is none."""
    return df.select("zip_code", "lat", "lng").join(known.select("zip_code", "city"), "zip_code", "left").select("zip_code", F.coalesce("city", F.lit("unknown")).alias("city"), "lat", "lng")


def line(spark, sf):
    i, p = A.raw(spark, sf, "lineitem"), A.raw(spark, sf, "part")
    return i.join(p, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", F.col("p_type").alias("category"), "p_brand")


def late_flags(lead: DataFrame) -> DataFrame:
    flag = lambda done, due: F.when(F.col(done).isNull() | F.col(due).isNull(), None).when(F.date_diff(due, done) < 0, "late").otherwise("on_time")
    return lead.withColumn("delivery_flag", flag("delivered_customer", "estimated_delivery")).withColumn("shipping_flag", flag("delivered_carrier", "shipping_limit"))


def timestamp_stats(spark, sf):
    """Orders with all their times: lead times in days, and labels by the times themselves, not by days. Labels are fixed values."""
    t = gather_timestamps(spark, sf).join(A.order_item(spark, sf).groupBy("order_id").agg(F.max("shipping_limit_date").alias("shipping_limit")), "order_id")
    late_delivery = F.when(F.col("delivered_customer") <= F.col("estimated_delivery"), "on_time_delivery").otherwise("late_deilvery")
    late_shipping = F.when(F.col("shipping_limit") < F.col("delivered_carrier"), "late_ship").otherwise("on_time_ship")
    return t.select("order_id", F.date_diff("approved", "purchase").alias("lead_time_approve_days"), F.date_diff("delivered_carrier", "approved").alias("lead_time_carrier_days"), F.date_diff("delivered_customer", "delivered_carrier").alias("lead_time_customer_days"), F.date_diff("delivered_customer", "purchase").alias("total_delivery_days"), late_delivery.alias("is_late_delivery"), late_shipping.alias("is_late_shipping"))


def late_rate_by_time(spark, sf):
    """How many deliveries came after the estimated time in each band of review scores."""
    r = A.review(spark, sf).select("order_id", F.when(F.col("review_score") <= 2, "low").when(F.col("review_score") == 3, "mid").otherwise("high").alias("band"))
    lead = marts.lead_days(spark, sf).where("delivered_customer IS NOT NULL AND estimated_delivery IS NOT NULL").select("order_id", (F.col("delivered_customer") > F.col("estimated_delivery")).alias("is_late"))
    return shapes.share(r.join(lead, "order_id").groupBy("band", "is_late").agg(F.count("*").alias("n")), "n", ["band"])


def sales_log10(spark, sf):
    """Monthly sales of the 16 categories with the most rows, on log scales."""
    s = marts.sales(spark, sf)
    top = s.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(16).select("category")
    log = lambda c, n: F.round(F.log10(c), 6).alias(n)
    return s.join(top, "category", "left_semi").select("category", "product_id", "sales_period", log("total_sales_quantity", "log_quantity"), log("total_sales_amount", "log_sales"), log("mean_sales", "log_price"))


def sales_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("product_id", "category", "seller_id").agg(F.count("*").alias("order_count"), F.round(F.sum("unit_price"), 4).alias("total_sales"), F.round(F.avg("unit_price"), 4).alias("mean_sales"))


def portfolio_group(stats: DataFrame) -> DataFrame:
    """Quadrants by global cuts: the upper quartile of counts, the median of means. The cuts are one row, joined, not collected."""
    cuts = stats.agg(F.percentile_approx("order_count", 0.75).alias("cq"), F.percentile_approx("mean_sales", 0.5).alias("cp"))
    return stats.crossJoin(F.broadcast(cuts)).select("product_id", "category", "seller_id", "order_count", "mean_sales", quality.portfolio(F.col("order_count"), F.col("mean_sales"), F.col("cq"), F.col("cp"), at_cut=True).alias("group"))


def purchase_stats(spark, sf):
    return A.payment(spark, sf).groupBy("customer_id").agg(F.count("*").alias("n_payments"), F.count_distinct("order_id").alias("n_orders"), F.min("timestamp").alias("first_purchase"), F.max("timestamp").alias("last_purchase"))


def purchase_intervals(spark, sf):
    """Mean seconds between purchases of customers with several."""
    p = A.payment(spark, sf).select("customer_id", "order_id", "timestamp")
    w = W.partitionBy("customer_id").orderBy("timestamp", "order_id")
    seconds = F.unix_timestamp(F.col("timestamp").cast("timestamp")) - F.unix_timestamp(F.lag("timestamp").over(w).cast("timestamp"))
    return p.withColumn("s", seconds).where("s IS NOT NULL").groupBy("customer_id").agg(F.count("*").alias("n_intervals"), F.round(F.avg("s"), 2).alias("mean_interval_seconds"))


def status_pivot(spark, sf):
    return A.order_status(spark, sf).groupBy("order_id").pivot("status", A.STATUS).agg(F.min("timestamp"))


def gather_timestamps(spark, sf):
    """Orders with all their times, from one table per time."""
    times = A.order_times(spark, sf)
    each = [times.where(F.col(f"order_{s}_timestamp").isNotNull()).select("order_id", F.col(f"order_{s}_timestamp").alias(s)) for s in [*A.STATUS, "estimated_delivery"]]
    return reduce(lambda a, b: a.join(b, "order_id", "outer"), each).dropna().dropDuplicates()


def quantity_pivot(spark, sf):
    rows = line(spark, sf).groupBy("l_orderkey", "category").agg(F.sum("l_quantity").alias("q")).select("category", quality.quantity_bucket(F.col("q")).alias("bucket"))
    wide = rows.groupBy("category").pivot("bucket", quality.BUCKETS).agg(F.count("bucket")).na.fill(0)
    total = sum((F.col(f"`{b}`") for b in quality.BUCKETS[1:]), F.col(f"`{quality.BUCKETS[0]}`"))
    return wide.select("category", *[F.col(f"`{b}`").alias(n) for b, n in zip(quality.BUCKETS, BUCKET_NAMES, strict=True)], total.alias("n_total")).orderBy(F.desc("n_total"), "category")


BUCKET_NAMES = ["q1", "q2", "q3", "q4", "q5", "q6_10", "q11_20", "q21_50", "q_over_50"]


def event_gap_quantiles(spark, sf):
    g = shapes.gaps(A.raw(spark, sf, "events"), "ts", "event_id")
    q = F.percentile_approx("gap_micros", F.array(*[F.lit(x) for x in QUANTILES]), 100_000)
    one = g.agg(F.count("*").alias("n"), F.round(F.avg("gap_micros") / 1e6, 4).alias("mean_seconds"), F.round(F.stddev("gap_micros") / 1e6, 4).alias("sd_seconds"), q.alias("q"))
    return one.select("n", "mean_seconds", "sd_seconds", *[F.round(F.col("q")[i] / 1e6, 4).alias(f"p{int(x * 100)}") for i, x in enumerate(QUANTILES)])


QUANTILES = [0.5, 0.75, 0.9, 0.95, 0.99]


def category_corr(spark, sf):
    """Correlation of quantity and price in the 16 largest categories."""
    rows = line(spark, sf)
    top = rows.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(16).select("category")
    return rows.join(top, "category", "left_semi").groupBy("category").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("corr"), F.count("*").alias("n"))


def category_revenue(spark, sf):
    """Of delivered orders, each category's revenue and its orders. Lines are dealt by their order, which the join and the distinct count
    share; the orders are made distinct and joined, as a semi join would go below the dealing."""
    items = A.raw(spark, sf, "lineitem")
    amount = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    lines = shapes.dealt(line(spark, sf).select("category", "l_orderkey", amount.alias("amount")), items, "l_orderkey")
    delivered = shapes.dealt(A.raw(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), items, "l_orderkey").distinct()
    return lines.join(delivered, "l_orderkey").groupBy("category").agg(F.round(F.sum("amount"), 2).alias("revenue"), F.count_distinct("l_orderkey").alias("n_orders"))


def late_rate_by_score(spark, sf):
    """How many deliveries were late in each band of review scores."""
    r = A.review(spark, sf).select("order_id", F.when(F.col("review_score") <= 2, "low").when(F.col("review_score") == 3, "mid").otherwise("high").alias("band"))
    flagged = late_flags(marts.lead_days(spark, sf)).where("delivery_flag IS NOT NULL").select("order_id", "delivery_flag")
    return shapes.share(r.join(flagged, "order_id").groupBy("band", "delivery_flag").agg(F.count("*").alias("n")), "n", ["band"])


def payment_reconcile(spark, sf):
    """Orders whose items and payments differ."""
    items = A.order_item_plain(spark, sf).groupBy("order_id").agg(F.sum(F.col("price") + F.col("freight_value")).alias("items"))
    paid = A.payment(spark, sf).groupBy("order_id").agg(F.sum("payment_value").alias("paid"))
    return paid.join(items, "order_id", "left").select("order_id", F.round(F.col("paid"), 2).alias("paid"), F.round("items", 2).alias("items"), F.round(F.col("paid") - F.col("items"), 2).alias("difference")).where("difference IS NULL OR difference <> 0")


def pareto(df: DataFrame, key: str, value: str) -> DataFrame:
    """Items by falling value with cumulative and rank shares, and whether they are within the first 80 %. Values are summed
    in whole cents, so that running sums come out the same however they are dealt."""
    sums = df.groupBy(key).agg(F.sum(F.round(F.col(value) * 100).cast("long")).alias("cents"))
    out = shapes.running(sums, [F.desc("cents"), F.asc(key)], "cents", 16)
    return out.select(key, (F.col("cents") / 100).alias("revenue"), F.round(F.col("running") / F.col("total"), 6).alias("cumulative_share"), F.round(F.col("row") / F.col("rows"), 6).alias("rank_share"), (10 * F.col("running") <= 8 * F.col("total")).alias("in_80"))


def top_seller_scores(spark, sf):
    """The scores of the seller with most reviews, in percent."""
    r = A.review(spark, sf).select("order_id", "review_id", "review_score").join(A.order_item_plain(spark, sf).select("order_id", "seller_id").distinct(), "order_id")
    top = r.groupBy("seller_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "seller_id").limit(1).select("seller_id")
    scores = counted(r.join(F.broadcast(top), "seller_id"), "seller_id", "review_score")  # one row
    total = scores.agg(F.sum("n").alias("total"))
    return scores.crossJoin(F.broadcast(total)).select("seller_id", "review_score", "n", F.round(100 * F.col("n") / F.col("total"), 2).alias("percent"))  # one row


def shared_columns(spark, sf):
    """Columns that several bronze tables have."""
    # the tables' own schemas, as Spark reads them; no data are touched
    found = [(n, c) for n in ("customer", "seller", "geolocation", "order_item", "product", "payment", "order_status", "estimated_delivery_date", "review") for c in getattr(A, n)(spark, sf).columns]
    return spark.createDataFrame(found, "table_name string, column_name string").groupBy("column_name").agg(F.count("*").alias("n_tables")).where("n_tables > 1")


RELATED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "labels", "pages", "benchmark")


def foreign_keys(spark, sf):
    """Which columns refer to which keys, by their values in the given tables."""
    return relations.foreign_keys({t: A.raw(spark, sf, t) for t in RELATED})


def uncategorised_sellers(spark, sf):
    """Sellers that sell a product without category (every 13th part has none): their lines and different categories."""
    rows = A.raw(spark, sf, "lineitem").join(A.raw(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 13 != 0, F.col("p_type")).alias("category")), F.col("l_partkey") == F.col("p_partkey"))
    bad = rows.where("category IS NULL").select("l_suppkey").distinct()
    return rows.join(bad, "l_suppkey", "left_semi").groupBy("l_suppkey").agg(F.count("*").alias("n_items"), F.count_distinct("category").alias("n_categories"))


def order_location(spark, sf):
    d, loc = marts.detail(spark, sf), marts.locations(spark, sf)
    side = lambda kind: loc.where(F.col("user_type") == kind).select(F.col("user_id").alias(f"{kind}_id"), F.col("lat").alias(f"{kind}_lat"), F.col("lng").alias(f"{kind}_lng"))
    rows = d.join(side("customer"), "customer_id").join(side("seller"), "seller_id")
    return rows.select(F.sha2(F.concat_ws("|", "order_id", "product_id", "seller_id"), 256).alias("row_key"), "order_id", "product_id", "customer_lat", "customer_lng", "seller_lat", "seller_lng")


def review_seller(spark, sf):
    """Reviews with their orders' sellers, over distinct pairs."""
    r = A.review(spark, sf).select("review_id", "order_id", "review_score")
    pairs = A.order_item_plain(spark, sf).select("order_id", "seller_id").distinct()
    return r.join(pairs, "order_id", "left").join(A.seller(spark, sf), "seller_id", "left").select("review_id", "order_id", "seller_id", "zip_code", "review_score")


def delivery_lag_stats(spark, sf):
    """Delivery lead days and the lag of answers behind deliveries: mean, deviation, quartiles."""
    lead = marts.lead_days(spark, sf).where("delivered_customer IS NOT NULL").select("order_id", "delivered_customer", F.date_diff("delivered_customer", "purchase").alias("lead_days"))
    r = A.review(spark, sf).select("order_id", "review_answer_timestamp")
    j = lead.join(r, "order_id", "left").withColumn("lag_days", F.date_diff("review_answer_timestamp", "delivered_customer"))
    return j.agg(F.count("*").alias("n"), F.round(F.avg("lead_days"), 4).alias("lead_mean"), F.round(F.stddev("lead_days"), 4).alias("lead_sd"), F.percentile_approx("lead_days", 0.5).alias("lead_median"), F.percentile_approx("lead_days", 0.75).alias("lead_q3"), F.round(F.avg("lag_days"), 4).alias("lag_mean"), F.round(F.stddev("lag_days"), 4).alias("lag_sd"))


def melted(spark, sf):
    """Orders' times in long form; the status is the middle of the column's name."""
    t = A.order_times(spark, sf)
    return t.unpivot(["order_id"], [c for c in t.columns if c.endswith("_timestamp")], "name", "timestamp").where("timestamp IS NOT NULL").select("order_id", middle_name(F.col("name")).alias("status"), "timestamp")


def category_lookup(spark, sf):
    """Products with translated categories; translations that the lookup lacks are patched by hand."""
    words = spark.createDataFrame([(f"C{i}", w) for i, w in enumerate(["toys", "books", "garden", "audio", "sports", "auto"])], "category string, category_english string")
    patched = F.when(F.col("category") == "C6", "patched_six").when(F.col("category") == "C7", "patched_seven").otherwise(F.col("category_english"))
    return A.product(spark, sf).join(F.broadcast(words), "category", "left").select("product_id", "category", patched.alias("category_english"))  # a fixed list


def rename_rule(spark, sf):
    p = A.raw(spark, sf, "part")
    fixed = {c: c.removeprefix("p_").replace("retailprice", "retail_price") for c in p.columns}
    return p.withColumnsRenamed(fixed)


def open_stage_age(spark, sf):
    """Undelivered orders: the last stage reached and its age in days at the newest purchase."""
    lead = marts.lead_days(spark, sf).where("delivered_customer IS NULL")
    now = A.raw(spark, sf, "orders").agg(F.max("o_orderdate").alias("now"))
    last = F.greatest("purchase", "approve", "delivered_carrier")
    stage = F.when(F.col("delivered_carrier").isNotNull(), "delivered_carrier").when(F.col("approve").isNotNull(), "approve").otherwise("purchase")
    return lead.crossJoin(F.broadcast(now)).select("order_id", stage.alias("open_since"), F.date_diff("now", last).alias("age_days"))  # one row


def parse_timestamps(spark, sf):
    """Times written as text, some with fractions and some that are no times, read again."""
    o = A.raw(spark, sf, "orders")
    t = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    said = F.when(F.col("o_orderkey") % 7 == 0, "n/a").when(F.col("o_orderkey") % 2 == 0, F.concat(t, F.lit(".123456 UTC"))).otherwise(t)
    return o.select("o_orderkey", F.date_format(parse_timestamp(said), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


def lead_time_long(spark, sf):
    lead = marts.lead_days(spark, sf)
    return lead.unpivot(["order_id"], list(gold.DURATIONS), "duration", "days").where("days IS NOT NULL")


def counted(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


QUERIES = {
    "timestamp_stats": timestamp_stats, "late_rate_by_time": late_rate_by_time, "sales_log10": sales_log10,
    "late_flags": lambda s, d: late_flags(marts.lead_days(s, d)),
    "quarantine_nulls": lambda s, d: quality.quarantine(marts.lead_days(s, d))[1],
    "null_audit": lambda s, d: quality.null_audit(marts.lead_days(s, d)),
    "integrity_report": lambda s, d: quality.integrity(A.geolocation(s, d), marts.geo(s, d), "zip_code"),
    "quantity_buckets": lambda s, d: counted(A.raw(s, d, "lineitem").select(quality.quantity_bucket(F.col("l_quantity")).alias("bucket")), "bucket"),
    "rename_rule": rename_rule,
    "mode_city": lambda s, d: mode_city(raw_city(s, d)),
    "city_normalised": lambda s, d: city_normalised(raw_city(s, d), mode_city(raw_city(s, d)).where("n > 1")),
    "geo_mean": lambda s, d: city_normalised(raw_city(s, d), mode_city(raw_city(s, d))).groupBy("zip_code", "city").agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lng"), 6).alias("lng")),
    "geo_median": lambda s, d: raw_city(s, d).select(fold_accents(F.col("city")).alias("city"), "lat", "lng").groupBy("city").agg(F.median("lat").alias("lat"), F.median("lng").alias("lng")),
    "category_lookup": category_lookup,
    "review_seller": review_seller,
    "gather_timestamps": gather_timestamps,
    "delivered_items_semi": lambda s, d: A.order_item_plain(s, d).join(A.order_times(s, d).where("order_status = 'F'").select("order_id"), "order_id", "left_semi"),
    "sales_stats": lambda s, d: sales_stats(marts.detail(s, d)),
    "portfolio_group": lambda s, d: portfolio_group(sales_stats(marts.detail(s, d))),
    "purchase_stats": purchase_stats,
    "purchase_intervals": purchase_intervals,
    "status_pivot": status_pivot,
    "quantity_pivot": quantity_pivot,
    "dedup_subset": lambda s, d: shapes.best(A.order_item_plain(s, d), ["order_id", "product_id"], [F.asc("order_item_id"), F.asc("freight_value"), F.asc("seller_id")]),
    "dedup_full_row": lambda s, d: A.order_item_plain(s, d).select("order_id", "product_id", "seller_id", "price").dropDuplicates(),
    "price_variants": lambda s, d: shapes.several(A.raw(s, d, "lineitem").select("l_partkey", shapes.rounded(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("p")), ["l_partkey"], "p", "n_prices"),
    "label_conflicts": lambda s, d: shapes.several(A.raw(s, d, "labels").join(A.raw(s, d, "documents"), "doc_id"), ["source"], "quality", "n_labels"),
    "multi_review_orders": lambda s, d: shapes.several(A.review(s, d).withColumn("order_id", (F.col("order_id").cast("long") / 3).cast("long")), ["order_id"], "review_id", "n_reviews"),
    "late_rate_by_score": late_rate_by_score,
    "category_share": lambda s, d: shapes.share(counted(line(s, d), "category"), "n"),
    "payment_reconcile": payment_reconcile,
    "sellers_per_category": lambda s, d: line(s, d).groupBy("category", "l_suppkey").agg(F.count("*").alias("n")).groupBy("category").agg(F.count("*").alias("n_sellers"), F.sum("n").alias("n_items")),
    "event_gap_quantiles": event_gap_quantiles,
    "category_corr": category_corr,
    "date_range": lambda s, d: shapes.date_range([(A.raw(s, d, "orders"), "o_orderdate"), (A.raw(s, d, "lineitem"), "l_shipdate"), (A.raw(s, d, "events"), "ts")]),
    "shared_columns": shared_columns,
    "category_revenue": category_revenue,
    "text_length_hist": lambda s, d: A.raw(s, d, "documents").select((F.floor(F.length("text") / 100) * 100).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")),
    "uncategorised_sellers": uncategorised_sellers,
    "pareto_category": lambda s, d: pareto(line(s, d), "category", "l_extendedprice"),
    "pareto_product": lambda s, d: pareto(A.raw(s, d, "lineitem"), "l_partkey", "l_extendedprice"),
    "top_sellers": lambda s, d: shapes.best(counted(line(s, d), "category", "l_suppkey"), ["category"], [F.desc("n"), F.asc("l_suppkey")], 10),
    "top_customers": lambda s, d: counted(A.payment(s, d), "customer_id").orderBy(F.desc("n"), "customer_id").limit(20),
    "top_seller_scores": top_seller_scores,
    "unpaid_orders": lambda s, d: A.raw(s, d, "orders").select(F.col("o_orderkey").alias("order_key")).join(A.raw(s, d, "lineitem").select(F.col("l_orderkey").alias("order_key")), "order_key", "left_anti"),
    "parse_timestamps": parse_timestamps,
    "order_total_price": lambda s, d: A.order_item_plain(s, d).groupBy("order_id").agg(F.round(F.sum(F.col("price") + F.col("freight_value")), 4).alias("total_price")),
    "lead_time_long": lead_time_long,
    "status_melt": melted,
    "order_location": order_location,
    "review_product": lambda s, d: silver_reviews(s, d).join(marts.detail(s, d).select("order_id", "product_id", "category").distinct(), "order_id").select("review_id", "order_id", "product_id", "category", "review_score"),
    "delivery_lag_stats": delivery_lag_stats,
    "payment_log": lambda s, d: A.payment(s, d).drop("customer_id", "timestamp").join(A.order_times(s, d).select("order_id", "customer_id", F.col("order_purchase_timestamp").alias("timestamp")), "order_id", "left").join(A.customer(s, d), "customer_id", "left"),
    "open_stage_age": open_stage_age,
    "foreign_keys": foreign_keys,
}


def silver_reviews(spark, sf):
    return A.review(spark, sf).select("review_id", "order_id", "review_score")


BUCKET_CASE = "CASE WHEN {0} <= 5 THEN {0}::INT::VARCHAR WHEN {0} <= 10 THEN '6-10' WHEN {0} <= 20 THEN '11-20' WHEN {0} <= 50 THEN '21-50' ELSE '>50' END"
PARETO = "SELECT {k}, c / 100 AS revenue, round(sum(c) OVER w / sum(c) OVER (), 6) AS cumulative_share, round(row_number() OVER w / count(*) OVER (), 6) AS rank_share, 10 * sum(c) OVER w <= 8 * sum(c) OVER () AS in_80 FROM (SELECT {k}, sum(round(l_extendedprice * 100)::BIGINT) AS c FROM {t} GROUP BY {k}) WINDOW w AS (ORDER BY c DESC, {k} ROWS UNBOUNDED PRECEDING)"
LEAD_COLUMNS = ["order_id", *gold.STAGES, *gold.DURATIONS]
STATS = "SELECT product_id, category, seller_id, count(*) AS order_count, round(sum(unit_price), 4) AS total_sales, round(avg(unit_price), 4) AS mean_sales FROM g_detail GROUP BY ALL"
KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"], "documents": ["doc_id"], "labels": ["doc_id"], "pages": ["page_id"], "benchmark": ["item_id"]}
REFERS = " UNION ALL ".join(
    f"SELECT '{a}' AS from_table, '{x}' AS from_column, '{b}' AS to_table, '{y}' AS to_column, (SELECT count(DISTINCT {x}) FROM {a}) AS n_values, (SELECT count(DISTINCT {x}) FROM {a} WHERE {x} IN (SELECT {y} FROM {b})) AS n_found, (SELECT count(*) FROM {b}) AS n_rows, (SELECT count(DISTINCT {y}) FROM {b}) AS n_keys"
    for a in KEYS for x in KEYS[a] for b in KEYS for y in KEYS[b] if a != b and relations.key_name(x) == relations.key_name(y)
)
ORACLE_SQL = {
    "late_flags": sql("SELECT * FROM a_late"),
    "timestamp_stats": sql("SELECT t.order_id, date_diff('day', order_purchase_timestamp, order_approved_timestamp)::INT AS lead_time_approve_days, date_diff('day', order_approved_timestamp, order_delivered_carrier_timestamp)::INT AS lead_time_carrier_days, date_diff('day', order_delivered_carrier_timestamp, order_delivered_customer_timestamp)::INT AS lead_time_customer_days, date_diff('day', order_purchase_timestamp, order_delivered_customer_timestamp)::INT AS total_delivery_days, CASE WHEN order_delivered_customer_timestamp <= order_estimated_delivery_timestamp THEN 'on_time_delivery' ELSE 'late_deilvery' END AS is_late_delivery, CASE WHEN shipping_limit < order_delivered_carrier_timestamp THEN 'late_ship' ELSE 'on_time_ship' END AS is_late_shipping FROM b_times AS t JOIN (SELECT order_id, max(shipping_limit_date) AS shipping_limit FROM b_item GROUP BY 1) AS i ON t.order_id = i.order_id WHERE order_delivered_customer_timestamp IS NOT NULL AND order_approved_timestamp IS NOT NULL"),
    "late_rate_by_time": sql("SELECT band, is_late, n, round(n / sum(n) OVER (PARTITION BY band), 4) AS proportion FROM (SELECT band, is_late, count(*) AS n FROM (SELECT CASE WHEN review_score <= 2 THEN 'low' WHEN review_score = 3 THEN 'mid' ELSE 'high' END AS band, delivered_customer > estimated_delivery AS is_late FROM b_review JOIN g_lead USING (order_id) WHERE delivered_customer IS NOT NULL AND estimated_delivery IS NOT NULL) GROUP BY ALL)"),
    "sales_log10": sql("SELECT category, product_id, sales_period, round(log10(total_sales_quantity), 6) AS log_quantity, round(log10(total_sales_amount), 6) AS log_sales, round(log10(mean_sales), 6) AS log_price FROM g_sales WHERE category IN (SELECT category FROM g_sales GROUP BY 1 ORDER BY count(*) DESC, category LIMIT 16)"),
    "quarantine_nulls": sql("SELECT * FROM g_lead WHERE " + " OR ".join(f"{c} IS NULL" for c in LEAD_COLUMNS)),
    "null_audit": sql(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_nulls FROM g_lead" for c in LEAD_COLUMNS)),
    "integrity_report": sql("SELECT *, round(keys_after / keys_before, 4) AS kept_share, n_nulls = 0 AND n_outside = 0 AS is_sound FROM (SELECT count(DISTINCT zip_code) AS keys_before FROM b_geo), (SELECT count(DISTINCT zip_code) AS keys_after, 0::BIGINT AS n_nulls, 0::BIGINT AS n_outside FROM s_geo)"),
    "quantity_buckets": "SELECT " + BUCKET_CASE.format("l_quantity") + " AS bucket, count(*) AS n FROM lineitem GROUP BY 1",
    "rename_rule": "SELECT p_partkey AS partkey, p_name AS name, p_brand AS brand, p_type AS type, p_size AS size, p_retailprice AS retail_price FROM part",
    "mode_city": sql("SELECT * FROM a_mode"),
    "city_normalised": sql("SELECT c.zip_code, coalesce(m.city, 'unknown') AS city, lat, lng FROM a_city AS c LEFT JOIN (SELECT * FROM a_mode WHERE n > 1) AS m ON c.zip_code = m.zip_code"),
    "geo_mean": sql("SELECT c.zip_code, m.city, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng FROM a_city AS c JOIN a_mode AS m ON c.zip_code = m.zip_code GROUP BY ALL"),
    "geo_median": sql("SELECT city, median(lat) AS lat, median(lng) AS lng FROM a_fold GROUP BY city"),
    "category_lookup": sql("SELECT product_id, category, CASE category WHEN 'C0' THEN 'toys' WHEN 'C1' THEN 'books' WHEN 'C2' THEN 'garden' WHEN 'C3' THEN 'audio' WHEN 'C4' THEN 'sports' WHEN 'C5' THEN 'auto' WHEN 'C6' THEN 'patched_six' WHEN 'C7' THEN 'patched_seven' END AS category_english FROM b_product"),
    "review_seller": sql("SELECT review_id, order_id, p.seller_id, s.zip_code, review_score FROM b_review LEFT JOIN (SELECT DISTINCT order_id, seller_id FROM b_item) AS p USING (order_id) LEFT JOIN b_seller AS s ON p.seller_id = s.seller_id"),
    "gather_timestamps": sql("SELECT order_id, order_purchase_timestamp AS purchase, order_approved_timestamp AS approved, order_delivered_carrier_timestamp AS delivered_carrier, order_delivered_customer_timestamp AS delivered_customer, order_estimated_delivery_timestamp AS estimated_delivery FROM b_times WHERE order_delivered_customer_timestamp IS NOT NULL AND order_approved_timestamp IS NOT NULL"),
    "delivered_items_semi": sql("SELECT * EXCLUDE (shipping_limit_date) FROM b_item WHERE order_id IN (SELECT order_id FROM b_times WHERE order_status = 'F')"),
    "sales_stats": sql(STATS),
    "portfolio_group": sql("SELECT product_id, category, seller_id, order_count, mean_sales, CASE WHEN order_count >= cq AND mean_sales >= cp THEN 'Star Products' WHEN order_count >= cq THEN 'Volume Drivers' WHEN mean_sales >= cp THEN 'Niche Gems' ELSE 'Question Marks' END AS \"group\" FROM a_stats, (SELECT quantile_disc(order_count, 0.75) AS cq, quantile_disc(mean_sales, 0.5) AS cp FROM a_stats)", a_stats=STATS),
    "purchase_stats": sql("SELECT customer_id, count(*) AS n_payments, count(DISTINCT order_id) AS n_orders, min(timestamp) AS first_purchase, max(timestamp) AS last_purchase FROM b_payment GROUP BY 1"),
    "purchase_intervals": sql("SELECT customer_id, count(*) AS n_intervals, round(avg(s), 2) AS mean_interval_seconds FROM (SELECT customer_id, date_diff('second', lag(timestamp) OVER (PARTITION BY customer_id ORDER BY timestamp, order_id), timestamp) AS s FROM b_payment) WHERE s IS NOT NULL GROUP BY 1"),
    "status_pivot": sql("SELECT order_id, " + ", ".join(f"min(CASE WHEN status = '{s}' THEN timestamp END) AS {s}" for s in A.STATUS) + " FROM b_status GROUP BY 1"),
    "quantity_pivot": sql("SELECT category, " + ", ".join(f"count(*) FILTER (WHERE bucket = '{b}') AS {n}" for b, n in zip(quality.BUCKETS, BUCKET_NAMES, strict=True)) + ", count(*) AS n_total FROM (SELECT category, " + BUCKET_CASE.format("q") + " AS bucket FROM (SELECT l_orderkey, category, sum(l_quantity) AS q FROM a_line GROUP BY ALL)) GROUP BY category"),
    "dedup_subset": sql("SELECT order_id, order_item_id, price, freight_value, product_id, seller_id FROM (SELECT *, row_number() OVER (PARTITION BY order_id, product_id ORDER BY order_item_id, freight_value, seller_id) AS r FROM b_item) WHERE r = 1"),
    "dedup_full_row": sql("SELECT DISTINCT order_id, product_id, seller_id, price FROM b_item"),
    "price_variants": "SELECT l_partkey, count(DISTINCT round(l_extendedprice / l_quantity, 2)) AS n_prices FROM lineitem GROUP BY 1 HAVING n_prices > 1",
    "label_conflicts": "SELECT source, count(DISTINCT quality) AS n_labels FROM labels JOIN documents USING (doc_id) GROUP BY 1 HAVING n_labels > 1",
    "multi_review_orders": sql("SELECT order_id::BIGINT // 3 AS order_id, count(DISTINCT review_id) AS n_reviews FROM b_review GROUP BY 1 HAVING n_reviews > 1"),
    "late_rate_by_score": sql("SELECT band, delivery_flag, n, round(n / sum(n) OVER (PARTITION BY band), 4) AS proportion FROM (SELECT band, delivery_flag, count(*) AS n FROM (SELECT CASE WHEN review_score <= 2 THEN 'low' WHEN review_score = 3 THEN 'mid' ELSE 'high' END AS band, delivery_flag FROM b_review JOIN a_late USING (order_id) WHERE delivery_flag IS NOT NULL) GROUP BY ALL)"),
    "category_share": sql("SELECT category, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS proportion FROM a_line GROUP BY 1"),
    "payment_reconcile": sql("SELECT * FROM (SELECT order_id, round(paid, 2) AS paid, round(items, 2) AS items, round(paid - items, 2) AS difference FROM (SELECT order_id, sum(payment_value) AS paid FROM b_payment GROUP BY 1) LEFT JOIN (SELECT order_id, sum(price + freight_value) AS items FROM b_item GROUP BY 1) USING (order_id)) WHERE difference IS NULL OR difference <> 0"),
    "sellers_per_category": sql("SELECT category, count(DISTINCT l_suppkey) AS n_sellers, count(*) AS n_items FROM a_line GROUP BY 1"),
    "event_gap_quantiles": "SELECT count(*) AS n, round(avg(g) / 1e6, 4) AS mean_seconds, round(stddev(g) / 1e6, 4) AS sd_seconds, " + ", ".join(f"round(quantile_disc(g, {q}) / 1e6, 4) AS p{int(q * 100)}" for q in QUANTILES) + " FROM (SELECT date_diff('microsecond', lag(ts) OVER (ORDER BY ts, event_id), ts) AS g FROM events) WHERE g IS NOT NULL",
    "category_corr": sql("SELECT category, round(corr(l_quantity, l_extendedprice), 6) AS corr, count(*) AS n FROM a_line WHERE category IN (SELECT category FROM a_line GROUP BY 1 ORDER BY count(*) DESC, category LIMIT 16) GROUP BY 1"),
    "date_range": "SELECT min(t) AS min_ts, max(t) AS max_ts FROM (SELECT o_orderdate AS t FROM orders UNION ALL SELECT l_shipdate FROM lineitem UNION ALL SELECT ts FROM events)",
    "category_revenue": sql("SELECT category, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT l_orderkey) AS n_orders FROM a_line WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1"),
    "text_length_hist": "SELECT length(text) // 100 * 100 AS bucket, count(*) AS n FROM documents GROUP BY 1",
    "uncategorised_sellers": sql("SELECT l_suppkey, count(*) AS n_items, count(DISTINCT category) AS n_categories FROM a_cat WHERE l_suppkey IN (SELECT l_suppkey FROM a_cat WHERE category IS NULL) GROUP BY 1", a_cat="SELECT l_suppkey, CASE WHEN p_partkey % 13 <> 0 THEN p_type END AS category FROM lineitem JOIN part ON l_partkey = p_partkey"),
    "pareto_category": sql(PARETO.format(k="category", t="a_line")),
    "pareto_product": PARETO.format(k="l_partkey", t="lineitem"),
    "top_sellers": sql("SELECT category, l_suppkey, n FROM (SELECT category, l_suppkey, count(*) AS n, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, l_suppkey) AS r FROM a_line GROUP BY 1, 2) WHERE r <= 10"),
    "top_customers": sql("SELECT customer_id, count(*) AS n FROM b_payment GROUP BY 1 ORDER BY n DESC, customer_id LIMIT 20"),
    "top_seller_scores": sql("SELECT seller_id, review_score, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM a_rs WHERE seller_id = (SELECT seller_id FROM a_rs GROUP BY 1 ORDER BY count(*) DESC, seller_id LIMIT 1) GROUP BY 1, 2", a_rs="SELECT review_id, review_score, seller_id FROM b_review JOIN (SELECT DISTINCT order_id, seller_id FROM b_item) USING (order_id)"),
    "unpaid_orders": "SELECT o_orderkey AS order_key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "parse_timestamps": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS parsed FROM orders",
    "order_total_price": sql("SELECT order_id, round(sum(price + freight_value), 4) AS total_price FROM b_item GROUP BY 1"),
    "lead_time_long": sql(" UNION ALL ".join(f"SELECT order_id, '{n}' AS duration, {n} AS days FROM g_lead WHERE {n} IS NOT NULL" for n in gold.DURATIONS)),
    "status_melt": sql(" UNION ALL ".join(f"SELECT order_id, '{s}' AS status, order_{s}_timestamp AS timestamp FROM b_times WHERE order_{s}_timestamp IS NOT NULL" for s in [*A.STATUS, "estimated_delivery"])),
    "order_location": sql("SELECT sha256(order_id || '|' || product_id || '|' || seller_id) AS row_key, order_id, product_id, c.lat AS customer_lat, c.lng AS customer_lng, s.lat AS seller_lat, s.lng AS seller_lng FROM g_detail JOIN g_location AS c ON c.user_type = 'customer' AND c.user_id = customer_id JOIN g_location AS s ON s.user_type = 'seller' AND s.user_id = seller_id"),
    "review_product": sql("SELECT review_id, order_id, product_id, category, review_score FROM b_review JOIN (SELECT DISTINCT order_id, product_id, category FROM g_detail) USING (order_id)"),
    "delivery_lag_stats": sql("SELECT count(*) AS n, round(avg(a), 4) AS lead_mean, round(stddev(a), 4) AS lead_sd, quantile_disc(a, 0.5) AS lead_median, quantile_disc(a, 0.75) AS lead_q3, round(avg(b), 4) AS lag_mean, round(stddev(b), 4) AS lag_sd FROM (SELECT date_diff('day', purchase, delivered_customer)::INT AS a, date_diff('day', delivered_customer, review_answer_timestamp)::INT AS b FROM g_lead LEFT JOIN b_review USING (order_id) WHERE delivered_customer IS NOT NULL)"),
    "payment_log": sql("SELECT p.order_id, payment_sequential, payment_value, payment_type, payment_installments, t.customer_id, order_purchase_timestamp AS timestamp, zip_code FROM b_payment AS p LEFT JOIN b_times AS t ON p.order_id = t.order_id LEFT JOIN b_customer AS c ON t.customer_id = c.customer_id"),
    "open_stage_age": sql("SELECT order_id, CASE WHEN delivered_carrier IS NOT NULL THEN 'delivered_carrier' WHEN approve IS NOT NULL THEN 'approve' ELSE 'purchase' END AS open_since, date_diff('day', greatest(purchase, approve, delivered_carrier), (SELECT max(o_orderdate) FROM orders))::INT AS age_days FROM g_lead WHERE delivered_customer IS NULL"),
    "foreign_keys": f"SELECT * EXCLUDE (n_rows, n_keys) FROM ({REFERS}) WHERE n_found >= n_values AND n_keys >= 0.9 * n_rows",
    "shared_columns": "SELECT column_name, n_tables FROM (VALUES ('customer_id', 2::BIGINT), ('order_id', 5), ('product_id', 2), ('seller_id', 2), ('timestamp', 2), ('zip_code', 3)) AS t(column_name, n_tables)",
}
