"""Streams over the given tables, run until they have read everything, each with the batch result that it must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderlake.operators import gold, jobs, merge, quality, shapes, silver
from orderlake.plans import marts
from orderlake.plans.twins import sql
from orderlake.sources import adapters as A, envelope, snapshots
from orderlake.sources.contracts import BRONZE
from orderlake.sources.paths import CLEANED, configured, fresh
from orderlake.streaming.lead_state import SIXTY_DAYS, STEP_SECONDS, timeline
from orderlake.streaming.packed import counts, pack, unpack
from orderlake.streaming.sources import PARTS, drain, folder_stream, start, table_stream, unzoned, zoned
from orderlake.streaming.supervise import Supervisor, watched

#: When the logs of these streams begin, and a day, in seconds.
START, DAY = 1_704_067_200, 86_400


def event_stream(spark, sf):
    return zoned(table_stream(spark, sf, "events"), "ts")


def order_stream(spark, sf):
    """Orders' times as the stream of purchases, approvals and deliveries: the batch transform on a stream."""
    key = F.col("o_orderkey")
    o = table_stream(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("order_id"), "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("purchase"), "o_orderstatus")
    later = lambda n: F.timestamp_add("DAY", n, F.col("purchase"))
    carrier = (2 + key % 10).cast("int")
    done, open_ = F.col("o_orderstatus") == "F", F.col("o_orderstatus") != "P"
    times = {"purchase": F.col("purchase"), "approved": F.when(open_, later(F.lit(1))), "delivered_carrier": F.when(open_, later(carrier)), "delivered_customer": F.when(done, later((carrier + key * 7 % 36).cast("int")))}
    long = o.select("order_id", F.explode(F.array(*[F.struct(F.lit(k).alias("status"), v.alias("timestamp")) for k, v in times.items()])).alias("e")).select("order_id", "e.*").where("timestamp IS NOT NULL")
    due = o.select("order_id", later(F.lit(30)).alias("estimated_delivery_date"))
    return long, due


def stream_source_count(spark, sf):
    """Events by type, counted by a stream in complete mode; the last state."""
    path = fresh(spark, "counts")
    counted = table_stream(spark, sf, "events", 1).groupBy("event_type").agg(F.count("*").alias("n"))
    start(counted, "stream_source_count", mode="complete", each=lambda df, _: df.write.mode("overwrite").parquet(path)).awaitTermination()
    return spark.read.schema(counted.schema).parquet(path)


def stream_append(spark, sf):
    return unzoned(drain(event_stream(spark, sf).where("event_type <> 'view'"), "stream_append"))


def cdc_fanout(spark, sf):
    """One stream of a log of two topics; every micro-batch is split by topic, decoded and committed once to its table.
    A payload that can't be decoded fails the batch, so that its offsets stay where they are."""
    folder = fresh(spark, "log")
    log = envelope.encode(A.customer(spark, sf), "bronze.customer", ["customer_id"]).unionByName(envelope.encode(A.seller(spark, sf), "bronze.seller", ["seller_id"]))
    log.repartition(F.col("topic"), F.pmod(F.xxhash64("key"), F.lit(64))).write.parquet(folder)
    tables = {t: snapshots.Table(spark, fresh(spark, t), BRONZE[t].schema) for t in ("customer", "seller")}

    def fan_out(batch, number):
        batch.persist()
        try:
            for name, table in tables.items():
                rows = envelope.decode(batch, f"bronze.{name}", BRONZE[name])
                good = rows.withColumn("zip_code", F.when(F.col(envelope.CORRUPT).isNotNull(), F.raise_error(F.concat(F.lit("not decoded: "), F.col(envelope.CORRUPT))).cast("int")).otherwise(F.col("zip_code")))
                table.commit(good, "2024-01-01 00:00:00", "cdc", number)
        finally:
            batch.unpersist()

    start(folder_stream(spark, folder, log.schema, 1), "cdc_fanout", each=fan_out).awaitTermination()
    return tables["customer"].read().select(F.lit("customer").alias("topic"), F.col("customer_id").alias("key"), "zip_code").unionByName(tables["seller"].read().select(F.lit("seller").alias("topic"), F.col("seller_id").alias("key"), "zip_code"))


def stream_tumbling(spark, sf):
    """Windows of five minutes by type: those that the watermark of a day has closed."""
    w = event_stream(spark, sf).withWatermark("ts", "1 day").groupBy(F.window("ts", "5 minutes"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("max_value"))
    return unzoned(drain(w.select(F.col("window.start").alias("window_start"), "event_type", "n", "max_value"), "stream_tumbling"))


def stream_dedup(spark, sf):
    """Users seen, once each within the watermark; expiry can bring one again, so they are counted distinct."""
    seen = event_stream(spark, sf).withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type", "ts")
    return drain(seen, "stream_dedup").select("user_id", "event_type").distinct()


def interval_sides(spark, sf):
    one = lambda kind, name: event_stream(spark, sf).where(F.col("event_type") == kind).select(F.col("event_id").alias(f"{name}_id"), F.col("user_id").alias(f"{name}_user"), F.col("ts").alias(f"{name}_ts"))
    return one("purchase", "p").withWatermark("p_ts", "3 days"), one("click", "c").withWatermark("c_ts", "3 days")


BAND = "p_user = c_user AND c_ts BETWEEN p_ts - INTERVAL 3 DAYS AND p_ts + INTERVAL 3 DAYS"


def stream_interval_join(spark, sf):
    p, c = interval_sides(spark, sf)
    return unzoned(drain(p.join(c, F.expr(BAND)).select("p_id", "c_id", "p_ts", "c_ts"), "stream_interval_join"))


def stream_outer_join(spark, sf):
    """Full outer: rows without partner come once the watermark has passed them."""
    p, c = interval_sides(spark, sf)
    return unzoned(drain(p.join(c, F.expr(BAND), "full_outer").select("p_id", "c_id", "p_ts", "c_ts"), "stream_outer_join"))


def stream_events(spark, sf):
    status, due = order_stream(spark, sf)
    none = status.where("false").select("order_id", F.col("timestamp").alias("shipping_limit_date"))
    return silver.order_events(status, due, none)


def stream_union_events(spark, sf):
    """The batch transform of order events, on streams."""
    return unzoned(drain(stream_events(spark, sf), "stream_union_events"))


def event_log(spark, sf):
    """Order events as a log that takes each in at its own time: so many files for each year, a year for each micro-batch, so that
    the watermark moves on with them."""
    rows = zoned(silver.order_events(A.order_status(spark, sf), A.estimated_delivery_date(spark, sf), A.order_item(spark, sf)), "timestamp").withColumn("ingest_time", F.col("timestamp"))
    rows.withColumn("year", F.year("ingest_time")).write.partitionBy("year").parquet(staged := fresh(spark, "events-by-year"))
    table, folder = spark.read.parquet(staged), fresh(spark, "event-log")
    years = table.where("year IS NOT NULL").groupBy("year").agg(F.count("*").alias("n")).orderBy("year").collect()  # years
    files = files_each([r["n"] for r in years])
    for r in years:
        table.where(F.col("year") == r["year"]).select(*rows.columns).repartition(files).write.mode("append").parquet(folder)
    return folder_stream(spark, folder, rows.schema, files).withWatermark("ingest_time", "60 days")


#: Rows of a file of the logs that queries here write, and the fewest of them.
FILE_ROWS, FEWEST = 500_000, 1000


def files_each(sizes: list[int]) -> int:
    """Into how many files each of several micro-batches of these sizes is dealt, the same for all, so that a trigger of that many files
    is one micro-batch: as many as the largest needs, but no more than leave the smallest so many rows a file that none is empty."""
    return max(1, min(-(-max(sizes, default=0) // FILE_ROWS), min(sizes, default=0) // FEWEST))


def last_rows(spark, updates, name: str):
    """Of each order, its last row of an update stream."""
    path = fresh(spark, name)
    start(updates, name, mode="update", each=lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/batch={n}")).awaitTermination()
    return shapes.best(spark.read.parquet(path), ["order_id"], [F.desc("batch")])


def stream_lead_days(spark, sf):
    """The stateful timeline in update mode, with all six times; of each order, its last row. An order without events for 60
    days of the log's time is forgotten, so the state is what the watermark still holds."""
    updates = timeline(event_log(spark, sf), "first", expire_ms=SIXTY_DAYS, clock="event")
    return unzoned(last_rows(spark, updates, "stream_lead_days").select("order_id", *gold.STAGES, *gold.DURATIONS))


def stream_open_stages(spark, sf):
    """Undelivered orders and the seconds that timeouts have added to their open stage: two hours for each day of the log's
    time without an event, until the order expires."""
    updates = timeline(event_log(spark, sf), "first", STEP_SECONDS, 86_400_000, SIXTY_DAYS, "event", seconds=True)
    return last_rows(spark, updates, "stream_open_stages").where("delivered_customer IS NULL").select("order_id", "open_seconds")


def stream_merge_matches_batch(spark, sf):
    """Micro-batches of order events merged into the lead-days mart, each once: what a batch knows of an order fills in the
    order's row, in the files that hold it. Every so many batches the mart is compacted, and older states expire. A batch takes two
    files in, or an eighth of a longer log, as each merge rewrites the files of all orders that are in it."""
    folder = fresh(spark, "event-files")
    events = zoned(silver.order_events(A.order_status(spark, sf), A.estimated_delivery_date(spark, sf), A.order_item(spark, sf)), "timestamp")
    events.write.parquet(folder)
    files = sum(s.getPath().getName().startswith("part-") for s in snapshots.Store(spark, folder).list(folder))
    wide = lambda rows: gold.order_lead_days(rows).select("order_id", *gold.STAGES)
    mart = snapshots.Table(spark, fresh(spark, "mart"), wide(events).schema)

    def merge_in(batch, number):
        batch.persist()
        try:
            jobs.merge_changes(mart, lambda: wide(batch), ["order_id"], lambda t, s: merge.coalesce(t, s, ["order_id"]), "2024-01-01 00:00:00", "stream_merge", number)
        finally:
            batch.unpersist()
        if number % 4 == 3:
            tidied(mart)

    start(folder_stream(spark, folder, events.schema, max(2, -(-files // 8))), "stream_merge", each=merge_in).awaitTermination()
    return unzoned(gold.durations(mart.read()))


def tidied(mart: snapshots.Table) -> None:
    """A mart in few files, without its older states: what its readers open stays bounded while a stream runs. One of several full
    files is left as it is while it has no more than ``MANY`` for each of these."""
    files = mart.files()
    fewest = -(-sum(mart.store.size(f"{mart.path}/{f}") for f in files) // snapshots.FILE_BYTES)
    if 1 < fewest and len(files) <= MANY * fewest:
        mart.expire(mart.last())
    else:
        mart.expire(snapshots.retried(lambda: mart.compact(mart.last(), "2024-01-01 00:00:00")))


#: Files of a mart for each that its bytes fill, up to which it isn't compacted.
MANY = 16


def as_batch(stream, session):
    """What is done with a micro-batch is planned as other batches are: adaptively, over as many partitions as the session has, and
    shuffles go as their actions end. The stream's own settings come back for the next micro-batch."""
    return configured(stream, {PARTS: session.conf.get(PARTS), "spark.sql.adaptive.enabled": session.conf.get("spark.sql.adaptive.enabled"), **CLEANED})


def stream_chain(spark, sf):
    """Bronze to silver to gold, stage by stage: the first stream's files are the second one's source."""
    stage, events = fresh(spark, "silver-events"), stream_events(spark, sf)
    start(events, "chain_silver", stage).awaitTermination()
    path = fresh(spark, "gold")
    wide = folder_stream(spark, stage, events.schema).groupBy("order_id").agg(*[F.max(F.when(F.col("data_type") == s, F.col("timestamp"))).alias(s) for s in gold.STAGES])
    start(gold.durations(wide), "chain_gold", mode="complete", each=lambda df, _: df.write.mode("overwrite").parquet(path)).awaitTermination()
    return unzoned(spark.read.parquet(path))


def stream_reviews(spark, sf):
    """Reviews without their texts, once each."""
    docs = table_stream(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("review_id"), F.col("source").alias("review_comment_title"), F.col("text").alias("review_comment_message"), "lang", F.timestamp_seconds(10**9 + F.col("doc_id") % 1000).alias("at"))
    seen = silver.review_metadata(docs.unionByName(docs)).withWatermark("at", "60 days").dropDuplicatesWithinWatermark(["review_id"])
    return drain(seen.select("review_id", "lang"), "stream_reviews")


def bronze_stream(spark, name: str, df, key: str):
    """A bronze table as a log's stream: every row comes twice, with the time at which the log took it in, within one hour."""
    taken = F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.xxhash64(key), F.lit(3600)))
    rows = df.withColumn("ingest_time", taken)
    rows.unionByName(rows).write.parquet(path := fresh(spark, f"bronze-{name}"))
    return folder_stream(spark, path, rows.schema)


def once(df, delay: str, *keys: str):
    """Each key once within the watermark on the time of ingestion; its state goes with the watermark."""
    return df.withWatermark("ingest_time", delay).dropDuplicatesWithinWatermark(list(keys))


def geo_stream(spark, sf, delay: str = "1 day"):
    rows = bronze_stream(spark, "geolocation", A.geolocation(spark, sf), "zip_code").where(quality.in_bounds())
    return once(rows.select(F.col("zip_code").cast("int").alias("zip_code"), "lat", "lng", "ingest_time"), delay, "zip_code")


def user_stream(spark, sf, delay: str = "1 day"):
    one = lambda df, kind: bronze_stream(spark, kind, df, f"{kind}_id").select(F.lit(kind).alias("user_type"), F.col(f"{kind}_id").alias("user_id"), "zip_code", "ingest_time")
    return once(one(A.customer(spark, sf), "customer").unionByName(one(A.seller(spark, sf), "seller")), delay, "user_type", "user_id")


def stream_geo_coord(spark, sf):
    return drain(geo_stream(spark, sf), "stream_geo_coord").drop("ingest_time")


def stream_users(spark, sf):
    return drain(user_stream(spark, sf), "stream_users").drop("ingest_time")


def stream_product_metadata(spark, sf):
    """Products and who sells them: an interval join on the times of ingestion."""
    product = once(bronze_stream(spark, "product", A.product(spark, sf), "product_id").select("product_id", "category", "ingest_time").dropna(), "30 days", "product_id")
    sold = once(bronze_stream(spark, "items", A.order_item_plain(spark, sf), "product_id").select("product_id", "seller_id", "ingest_time").dropna(), "30 days", "product_id", "seller_id")
    near = F.expr("p.product_id = s.product_id AND p.ingest_time BETWEEN s.ingest_time - INTERVAL 30 DAYS AND s.ingest_time + INTERVAL 30 DAYS")
    return drain(product.alias("p").join(sold.alias("s"), near).select("p.product_id", "p.category", "s.seller_id"), "stream_product_metadata")


def stream_user_location(spark, sf):
    """Users and coordinates joined as streams; a user without coordinates has no location."""
    users, geo = user_stream(spark, sf, "30 days"), geo_stream(spark, sf, "30 days")
    near = F.expr("u.zip_code = g.zip_code AND g.ingest_time BETWEEN u.ingest_time - INTERVAL 30 DAYS AND u.ingest_time + INTERVAL 30 DAYS")
    return drain(users.alias("u").join(geo.alias("g"), near).select("u.user_type", "u.user_id", "u.zip_code", "g.lat", "g.lng"), "stream_user_location")


def taken_in(spark, name: str, df, at):
    """Rows as a log's stream, taken in at given times, and one row far later, which lets the watermark pass them all."""
    rows = df.withColumn("ingest_time", at)
    end = spark.range(1).select(*[F.lit("end" if t == "string" else 1).cast(t).alias(c) for c, t in df.dtypes], F.timestamp_seconds(F.lit(START + 60 * DAY)).alias("ingest_time"))
    rows.unionByName(end).write.parquet(path := fresh(spark, f"bronze-{name}"))
    return folder_stream(spark, path, rows.schema, 1000)


#: Into how many packs the orders of a window are dealt.
BUCKETS = 16


def stream_customer_orders(spark, sf):
    """Items counted in windows of five minutes, whose state is packs of many orders' items that are counted as the window closes. The
    count's window goes on, an order's lines in one row, into a full outer join with payments taken in within three days. Some
    orders' items fall in two windows; some payments are late, some missing: these come without a partner and are dropped."""
    key = F.col("order_id").cast("long")
    minute = START + 60 * (key % 600)
    items = taken_in(spark, "order-items", A.order_item_plain(spark, sf).drop("freight_value"), F.timestamp_seconds(minute + F.when(key % 10 == 0, 600 * (F.col("order_item_id") % 2)).otherwise(0)))
    paid = taken_in(spark, "payments", A.payment(spark, sf).select("order_id", "customer_id").where(key % 11 != 0), F.timestamp_seconds(minute + F.when(key % 7 == 0, 4 * DAY).otherwise(300)))
    slot = F.timestamp_seconds(F.unix_seconds("ingest_time") - F.pmod(F.unix_seconds("ingest_time"), F.lit(300)))
    lines = items.dropna().select(slot.alias("slot"), F.pmod(F.xxhash64("order_id"), F.lit(BUCKETS)).alias("bucket"), "order_id", "product_id", "seller_id", F.col("price").alias("unit_price"))
    packs = pack(lines, ["slot", "bucket"], 1_000_000).withWatermark("slot", "3 days").groupBy(F.window("slot", "5 minutes"), "bucket").agg(F.collect_list("packed").alias("packed"))
    counted = packs.select(F.window_time("window").alias("counted_at"), F.explode(counts("order_id string", "product_id string, seller_id string, unit_price double")("packed")).alias("order"))
    counted = counted.select("counted_at", F.col("order.order_id").alias("c_order"), "order.lines")
    payer = once(paid, "3 days", "order_id").select("order_id", "customer_id", "ingest_time")
    near = F.expr("c_order = order_id AND counted_at BETWEEN ingest_time - INTERVAL 3 DAYS AND ingest_time + INTERVAL 3 DAYS")
    both = counted.join(payer, near, "full_outer").select("order_id", "customer_id", F.explode_outer("lines").alias("line")).select("order_id", "customer_id", "line.product_id", "line.seller_id", "line.quantity", "line.unit_price")
    return drain(both.dropna(), "stream_customer_orders", rows=A.raw(spark, sf, "lineitem").count())


def order_detail_source(spark, sf):
    """Order lines and products as silver streams. Every third order's lines come with one piece more first, and as they are
    a day later, in a micro-batch of their own. What the join holds of the lines are packs of many with one product and seller."""
    order, third, at = F.col("order_id"), F.col("order_id").cast("long") % 3 == 0, lambda s: F.timestamp_seconds(F.lit(START + s))
    orders = silver.customer_orders(A.order_item_plain(spark, sf).repartition(order), A.payment(spark, sf).select("order_id", "customer_id").repartition(order))  # dealt once, for counts and join
    first = orders.withColumn("quantity", F.col("quantity") + F.when(third, 1).otherwise(0)).withColumn("ingest_time", at(0))
    products = marts.products(spark, sf).withColumn("ingest_time", at(3600))
    first.write.parquet(folder := fresh(spark, "customer-order"))
    files = max(1, sum(s.getPath().getName().startswith("part-") for s in snapshots.Store(spark, folder).list(folder)))
    again = spark.read.schema(first.schema).parquet(folder).where(third).withColumn("quantity", F.col("quantity") - 1).withColumn("ingest_time", at(DAY))
    again.coalesce(files).write.mode("append").parquet(folder)  # no more files than the first micro-batch has
    products.coalesce(1).write.parquet(metadata := fresh(spark, "product-metadata"))
    o = pack(folder_stream(spark, folder, first.schema, files), ["product_id", "seller_id", "ingest_time"]).withWatermark("ingest_time", "30 days")
    p = folder_stream(spark, metadata, products.schema, 1).withWatermark("ingest_time", "30 days")
    near = F.expr("o.product_id = p.product_id AND o.seller_id = p.seller_id AND o.ingest_time BETWEEN p.ingest_time - INTERVAL 30 DAYS AND p.ingest_time + INTERVAL 30 DAYS")
    both = o.alias("o").join(p.alias("p"), near).select("o.seller_id", "o.product_id", "p.category", F.greatest("o.ingest_time", "p.ingest_time").alias("ingest_time"), "o.packed")
    return unpack(both, "order_id string, customer_id string, quantity bigint, unit_price double").select("order_id", "customer_id", "seller_id", "product_id", "category", "quantity", "unit_price", "ingest_time")


DETAIL_KEY = ["order_id", "product_id", "seller_id", "unit_price"]


def detail_sink(mart: snapshots.Table, every: int = 2):
    """Merges micro-batches into the order-detail mart, each once: lines whose quantity or category differs are replaced, in the
    files that hold them. Every so many batches the mart is compacted and older states expire, so that a reader opens few files."""

    def merge_in(batch, number):
        with as_batch(batch.sparkSession, mart.spark):
            merged(batch, number)

    def merged(batch, number):
        batch.persist()
        try:
            rows = lambda: merge.single(batch, DETAIL_KEY, [F.desc("ingest_time"), F.desc("quantity")]).select(*mart.schema.names)
            jobs.merge_changes(mart, rows, DETAIL_KEY, lambda t, s: merge.conditional(t, s, DETAIL_KEY, ["quantity", "category"]), "2024-01-01 00:00:00", "order_detail", number)
        finally:
            batch.unpersist()
        if number % every == every - 1:
            tidied(mart)

    return merge_in


def stream_order_detail(spark, sf):
    """The order-detail mart, merged from micro-batches of a join of two streams."""
    source = order_detail_source(spark, sf)
    mart = snapshots.Table(spark, fresh(spark, "order-detail"), source.drop("ingest_time").schema)
    start(source, "stream_order_detail", each=detail_sink(mart), rows=0).awaitTermination()  # its state has few rows
    return mart.read()


def cdc_topics(spark, sf):
    """A log of two topics, each with a query of its own under one supervisor. The sellers' fails once on its first batch, is
    started again from its checkpoint, and both end with all rows."""
    folder = fresh(spark, "topics-log")
    log = envelope.encode(A.customer(spark, sf), "bronze.customer", ["customer_id"]).unionByName(envelope.encode(A.seller(spark, sf), "bronze.seller", ["seller_id"]))
    log.repartition(4, "key").write.parquet(folder)
    tables = {t: snapshots.Table(spark, fresh(spark, t), BRONZE[t].schema) for t in ("customer", "seller")}
    checkpoints, failed = {t: fresh(spark, f"checkpoint-{t}") for t in tables}, []

    def begin(topic: str):
        def commit(batch, number):
            if topic == "seller" and not failed:
                failed.append(number)
                raise RuntimeError("killed on purpose")
            tables[topic].commit(envelope.decode(batch, f"bronze.{topic}", BRONZE[topic]), "2024-01-01 00:00:00", f"cdc-{topic}", number)

        return start(folder_stream(spark, folder, log.schema, 2).where(F.col("topic") == f"bronze.{topic}"), f"cdc-{topic}", each=commit, checkpoint=checkpoints[topic])

    Supervisor(spark, {t: (lambda t=t: begin(t)) for t in tables}, report=lambda said: None).run()
    return tables["customer"].read().select(F.lit("customer").alias("topic"), F.col("customer_id").alias("key"), "zip_code").unionByName(tables["seller"].read().select(F.lit("seller").alias("topic"), F.col("seller_id").alias("key"), "zip_code"))


def stream_late_rows(spark, sf):
    """Events by day, the newest quarter taken in first, then the one before, then the older half, with a watermark of ten days:
    how many of each day it let in, and how many of all the query says that it dropped. A micro-batch drops by the watermark
    that the one before it began with, so the second quarter is whole."""
    folder, e = fresh(spark, "events-by-age"), zoned(A.raw(spark, sf, "events"), "ts")
    at = F.unix_micros("ts")
    lo, hi = e.agg(F.min(at), F.max(at)).first()
    mid, late = (lo + hi) // 2, (lo + 3 * hi) // 4
    for name, part in (("a", at >= late), ("b", (at >= mid) & (at < late)), ("c", at < mid)):
        e.where(part).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
    seen = folder_stream(spark, folder + "/*", e.schema, 1).withWatermark("ts", "10 days").dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "ts")
    path = fresh(spark, "let-in")
    watch = watched(spark, lambda: start(seen, "stream_late_rows", path).awaitTermination())
    day = lambda df, n: unzoned(df.groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias(n)))
    rows = day(e, "n_rows").join(day(spark.read.schema(seen.schema).parquet(path), "n_let_in"), "day", "left")
    return rows.select("day", "n_rows", F.coalesce("n_let_in", F.lit(0)).alias("n_let_in"), F.lit(watch.dropped["stream_late_rows"]).cast("long").alias("n_dropped_of_all"))


CLOSED = "(SELECT max(ts) - INTERVAL 1 DAY FROM events)"
SIDES = {"t_p": "SELECT event_id AS p_id, user_id AS p_user, ts AS p_ts FROM events WHERE event_type = 'purchase'", "t_c": "SELECT event_id AS c_id, user_id AS c_user, ts AS c_ts FROM events WHERE event_type = 'click'"}
STREAM_EVENTS = "SELECT * FROM s_events WHERE data_type <> 'shipping_limit'"
S_LEAD = {"t_wide": "SELECT order_id, " + ", ".join(f"max(CASE WHEN data_type = '{s}' AND data_type <> 'shipping_limit' THEN timestamp END) AS {s}" for s in gold.STAGES) + " FROM s_events WHERE data_type <> 'shipping_limit' GROUP BY order_id", "t_lead": "SELECT *, " + ", ".join(f"date_diff('day', {b}, {a})::INT AS {n}" for n, (a, b) in gold.DURATIONS.items()) + " FROM t_wide"}

QUERIES = {
    "stream_source_count": stream_source_count, "stream_append": stream_append, "cdc_fanout": cdc_fanout, "stream_tumbling": stream_tumbling, "stream_dedup": stream_dedup, "stream_interval_join": stream_interval_join,
    "stream_outer_join": stream_outer_join, "stream_union_events": stream_union_events, "stream_lead_days": stream_lead_days, "stream_merge_matches_batch": stream_merge_matches_batch, "stream_chain": stream_chain,
    "stream_reviews": stream_reviews, "stream_geo_coord": stream_geo_coord, "stream_users": stream_users, "stream_product_metadata": stream_product_metadata, "stream_user_location": stream_user_location, "stream_late_rows": stream_late_rows,
    "stream_customer_orders": stream_customer_orders, "stream_order_detail": stream_order_detail, "stream_open_stages": stream_open_stages, "cdc_topics": cdc_topics,
}
ORACLE_SQL = {
    "stream_source_count": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "stream_append": "SELECT * FROM events WHERE event_type <> 'view'",
    "cdc_fanout": sql("SELECT 'customer' AS topic, customer_id AS key, zip_code FROM b_customer UNION ALL SELECT 'seller', seller_id, zip_code FROM b_seller"),
    "stream_tumbling": f"SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type, count(*) AS n, max(value) AS max_value FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 5 MINUTE, min(ts)) + INTERVAL 5 MINUTE <= {CLOSED}",
    "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_interval_join": sql("SELECT p_id, c_id, p_ts, c_ts FROM t_p JOIN t_c ON p_user = c_user AND c_ts BETWEEN p_ts - INTERVAL 3 DAY AND p_ts + INTERVAL 3 DAY", **SIDES),
    "stream_union_events": sql(STREAM_EVENTS),
    "stream_lead_days": sql("SELECT * FROM g_lead"),
    "stream_order_detail": sql("SELECT * FROM g_detail"),
    "stream_customer_orders": sql(
        "SELECT order_id, customer_id, product_id, seller_id, quantity, price AS unit_price FROM t_counted JOIN t_paid USING (order_id) WHERE counted_at BETWEEN paid_at - INTERVAL 3 DAY AND paid_at + INTERVAL 3 DAY",
        t_counted=f"SELECT order_id, product_id, price, seller_id, w + INTERVAL 5 MINUTE - INTERVAL 1 MICROSECOND AS counted_at, count(*) AS quantity FROM (SELECT *, time_bucket(INTERVAL 5 MINUTE, make_timestamp(1000000 * ({START} + 60 * (order_id::BIGINT % 600) + CASE WHEN order_id::BIGINT % 10 = 0 THEN 600 * (order_item_id % 2) ELSE 0 END))) AS w FROM b_item) GROUP BY order_id, product_id, price, seller_id, w",
        t_paid=f"SELECT order_id, customer_id, make_timestamp(1000000 * ({START} + 60 * (order_id::BIGINT % 600) + CASE WHEN order_id::BIGINT % 7 = 0 THEN {4 * DAY} ELSE 300 END)) AS paid_at FROM b_payment WHERE order_id::BIGINT % 11 <> 0",
    ),
    "stream_open_stages": sql(
        f"SELECT order_id, greatest(0, least(60, floor((epoch((SELECT max(timestamp) FROM s_events)) - epoch(seen)) / {DAY}) - 60))::BIGINT * 7200 AS open_seconds FROM t_seen JOIN g_lead USING (order_id) WHERE delivered_customer IS NULL",
        t_seen="SELECT order_id, max(timestamp) AS seen FROM s_events GROUP BY order_id",
    ),
    "cdc_topics": sql("SELECT 'customer' AS topic, customer_id AS key, zip_code FROM b_customer UNION ALL SELECT 'seller', seller_id, zip_code FROM b_seller"),
    "stream_late_rows": """WITH m AS (SELECT (epoch_us(min(ts)) + epoch_us(max(ts))) // 2 AS mid, epoch_us(date_trunc('milliseconds', max(ts))) - 864000000000 AS wm FROM events),
l AS (SELECT ts, epoch_us(ts) >= mid OR epoch_us(ts) > wm AS let_in FROM events, m)
SELECT date_trunc('day', ts) AS day, count(*) AS n_rows, count(*) FILTER (let_in) AS n_let_in, (SELECT count(*) FROM l WHERE NOT let_in) AS n_dropped_of_all FROM l GROUP BY 1""",
    "stream_merge_matches_batch": sql("SELECT * FROM g_lead"),
    "stream_chain": sql("SELECT * FROM t_lead", **S_LEAD),
    "stream_geo_coord": sql("SELECT * FROM s_geo"), "stream_users": sql("SELECT * FROM s_users"), "stream_product_metadata": sql("SELECT * FROM s_product"), "stream_user_location": sql("SELECT * FROM g_location"),
    "stream_reviews": "SELECT doc_id::VARCHAR AS review_id, lang FROM documents",
}
