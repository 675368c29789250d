"""The silver and gold tables made by incremental jobs: bronze tables come in three commits, and the jobs run until they have
read everything. What they end with equals the tables made at once. The last commit also repeats the first, but for tables
whose rows are counted; the sources of a join are dealt by different keys, so that partners come in different commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orderlake.operators import gold, jobs, merge, silver
from orderlake.plans import marts
from orderlake.plans.twins import sql
from orderlake.sources import adapters as A, snapshots
from orderlake.sources.paths import fresh, written

AT = "2024-01-01 00:00:00"


def table(spark, name: str, schema) -> snapshots.Table:
    return snapshots.Table(spark, fresh(spark, name), schema)


def bronze(spark, name: str, df: DataFrame, *key: str, again: bool = True) -> snapshots.Table:
    """The rows in three commits by hash of a key; the third brings the first one's rows ``again``."""
    t, third = table(spark, name, df.schema), F.pmod(F.xxhash64(*key), F.lit(3))
    for part in (third == 0, third == 1, third != 1 if again else third == 2):
        t.commit(df.where(part), AT)
    return t


def silver_job(spark, name: str, sources: dict[str, tuple], keys: list[str], transform, how: str = "rows", touched: tuple[str, ...] = ()) -> jobs.SilverJob:
    target = table(spark, name, transform(**{n: df for n, (df, *_) in sources.items()}).schema)
    tables = {n: bronze(spark, n, df, *key, again=how != "recount") for n, (df, *key) in sources.items()}
    return jobs.SilverJob(name, tables, target, table(spark, "marks", snapshots.MARKS), keys, transform, how, touched)


def geo_job(spark, sf):
    return silver_job(spark, "geo_coord", {"geolocation": (A.geolocation(spark, sf), "zip_code")}, ["zip_code"], silver.geo_coord)


def user_job(spark, sf):
    return silver_job(spark, "user", {"customer": (A.customer(spark, sf), "customer_id"), "seller": (A.seller(spark, sf), "seller_id")}, ["user_type", "user_id"], silver.users)


def event_job(spark, sf):
    sources = {"status": (A.order_status(spark, sf), "status"), "estimated": (A.estimated_delivery_date(spark, sf), "order_id"), "items": (A.order_item(spark, sf), "order_id")}
    return silver_job(spark, "order_event", sources, ["order_id", "data_type", "timestamp"], silver.order_events)


def product_job(spark, sf):
    sources = {"product": (A.product(spark, sf), "product_id"), "items": (A.order_item_plain(spark, sf), "order_id", "product_id", "seller_id")}
    return silver_job(spark, "product_metadata", sources, ["product_id", "category", "seller_id"], silver.product_metadata, "join")


def order_job(spark, sf):
    sources = {"items": (A.order_item_plain(spark, sf), "order_id", "order_item_id"), "payment": (A.payment(spark, sf), "customer_id")}
    return silver_job(spark, "customer_order", sources, ["order_id", "product_id", "seller_id", "customer_id", "unit_price"], silver.customer_orders, "recount", ("order_id",))


def review_job(spark, sf):
    return silver_job(spark, "review_metadata", {"review": (A.review(spark, sf), "review_id")}, ["review_id"], silver.review_metadata)


def finished(job: jobs.SilverJob) -> DataFrame:
    job.catch_up(AT)
    return job.target.read()


def job_runs(spark, sf):
    """What each run of the user job added, by its commits."""
    job = user_job(spark, sf)
    job.catch_up(AT)
    each = [job.target.between(k - 1, k).agg(F.count("*").alias("n_rows")).select(F.lit(k).alias("run"), "n_rows") for k in range(1, job.target.last() + 1)]
    rows = each[0]
    for one in each[1:]:
        rows = rows.unionByName(one)
    return rows.agg(F.count("*").alias("n_runs"), F.sum("n_rows").alias("n_rows"))


def merged(spark, name: str, states: list, on: list[str], how) -> DataFrame:
    """A gold table after a merge of each state of its sources, which rewrites the files that hold one of its keys."""
    t = table(spark, name, states[0].schema)
    for rows in states:
        jobs.merge_changes(t, lambda rows=rows: rows, on, lambda target, source: how(target, source, on), AT)
    return t.read()


def growing(job: jobs.SilverJob) -> list[DataFrame]:
    """The job's target after its first run, and after all."""
    job.run(AT)
    first = job.target.last()
    job.catch_up(AT)
    return [job.target.as_of(first), job.target.read()]


def gold_lead_days(spark, sf):
    states = [gold.order_lead_days(e) for e in growing(event_job(spark, sf))]
    return merged(spark, "lead_days", states, ["order_id"], merge.coalesce)


def gold_locations(spark, sf):
    geo = marts.geo(spark, sf)
    states = [gold.user_location(u, geo) for u in growing(user_job(spark, sf))]
    return merged(spark, "user_location", states, ["user_type", "user_id"], merge.insert_only)


def gold_detail(spark, sf):
    products = written(marts.products(spark, sf), "products")
    states = [gold.order_detail(o, products) for o in growing(order_job(spark, sf))]
    return merged(spark, "order_detail", states, ["order_id", "product_id", "seller_id", "unit_price"], lambda t, s, on: merge.conditional(t, s, on, ["quantity", "category"]))


def gold_sales(spark, sf):
    """Sales by month: the second merge overwrites the months and products that have grown."""
    lead, products = written(marts.lead_days(spark, sf), "lead-days"), written(marts.products(spark, sf), "products")
    states = [gold.monthly_sales(lead, gold.order_detail(o, products)) for o in growing(order_job(spark, sf))]
    return merged(spark, "monthly_sales", states, ["product_id", "sales_period"], merge.overwrite)


def gold_reviews(spark, sf):
    states = [gold.review_answer_days(r) for r in growing(review_job(spark, sf))]
    return merged(spark, "review_answer", states, ["review_id", "order_id"], merge.insert_only)


QUERIES = {
    "job_geo_coord": lambda s, d: finished(geo_job(s, d)), "job_user": lambda s, d: finished(user_job(s, d)), "job_order_event": lambda s, d: finished(event_job(s, d)), "job_product_metadata": lambda s, d: finished(product_job(s, d)),
    "job_customer_order": lambda s, d: finished(order_job(s, d)), "job_review_metadata": lambda s, d: finished(review_job(s, d)), "job_runs": job_runs,
    "gold_lead_days_merged": gold_lead_days, "gold_user_location_merged": gold_locations, "gold_order_detail_merged": gold_detail, "gold_monthly_sales_merged": gold_sales, "gold_review_answer_merged": gold_reviews,
}
ORACLE_SQL = {
    "job_geo_coord": sql("SELECT * FROM s_geo"), "job_user": sql("SELECT * FROM s_users"), "job_order_event": sql("SELECT * FROM s_events"), "job_product_metadata": sql("SELECT * FROM s_product"),
    "job_customer_order": sql("SELECT * FROM s_order"), "job_review_metadata": sql("SELECT DISTINCT * EXCLUDE (review_comment_title, review_comment_message) FROM b_review"), "job_runs": sql("SELECT 2::BIGINT AS n_runs, count(*) AS n_rows FROM s_users"),
    "gold_lead_days_merged": sql("SELECT * FROM g_lead"), "gold_user_location_merged": sql("SELECT * FROM g_location"), "gold_order_detail_merged": sql("SELECT * FROM g_detail"),
    "gold_monthly_sales_merged": sql("SELECT * FROM g_sales"), "gold_review_answer_merged": sql("SELECT * FROM g_review"),
}
