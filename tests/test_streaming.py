import datetime as dt

import oracle
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orderlake.operators import gold
from orderlake.plans import streams
from orderlake.sources import snapshots
from orderlake.sources.paths import fresh
from orderlake.streaming import sources
from orderlake.streaming.lead_state import OPEN, SIXTY_DAYS, STEP_SECONDS, days, timeline
from orderlake.streaming.sources import drain, folder_stream, log_stream, start, supervise
from orderlake.streaming.supervise import Supervisor, watched

SCHEMA = "order_id string, data_type string, timestamp timestamp"
DAY = dt.datetime(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def files(spark, *batches, schema=SCHEMA):
    """A folder of one file per batch, and its stream, a file at a time."""
    folder = fresh(spark, "batches")
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(folder)
    return folder_stream(spark, folder, schema, 1)


def last_states(spark, df, name):
    seen = {}

    def note(batch, _):
        for r in batch.collect():
            seen.setdefault(r["order_id"], []).append(r.asDict())

    start(df, name, mode="update", each=note).awaitTermination()
    return seen


BATCHES = [[("a", "purchase", day(0)), ("a", "approve", day(3)), ("b", "purchase", None)], [("a", "approve", day(1)), ("a", "unknown", day(9))], [("a", s, day(10 + i)) for i, s in enumerate(gold.STAGES[2:])]]


@pytest.mark.parametrize("keep,approved", [("max", 3), ("first", 3)])
def test_timeline_keeps(spark, keep, approved):
    seen = last_states(spark, timeline(files(spark, *BATCHES), keep), f"keep_{keep}")
    last = seen["a"][-1]
    assert last["approve"] == day(approved) and last["purchase_to_approval_days"] == approved
    assert last["delivered_customer"] == day(13) and last["customer_delivery_delay_days"] == 1
    assert seen["b"][-1]["purchase"] is None and seen["b"][-1]["purchase_to_approval_days"] is None


def test_timeline_takes_later_or_first(spark):
    batches = [[("a", "purchase", day(1))], [("a", "purchase", day(4))]]
    assert last_states(spark, timeline(files(spark, *batches)), "later")["a"][-1]["purchase"] == day(4)
    assert last_states(spark, timeline(files(spark, *batches), "first"), "first")["a"][-1]["purchase"] == day(1)


def test_an_event_after_completion_changes_nothing(spark):
    full = [("a", s, day(i)) for i, s in enumerate(gold.STAGES)]
    seen = last_states(spark, timeline(files(spark, full, [("a", "approve", day(50))], [("a", "purchase", day(9))]), "first"), "complete")
    assert len(seen["a"]) == 3 and seen["a"][0] == seen["a"][1] == seen["a"][2] and seen["a"][0]["delivered_customer"] == day(5)


LOGGED = SCHEMA + ", ingest_time timestamp"


def logged(spark, *batches):
    """Events that the log takes in at their own time; a mark lets the watermark move."""
    return files(spark, *[[(o, k, t, t) for o, k, t in b] for b in batches], schema=LOGGED).withWatermark("ingest_time", "60 days")


def test_state_ends_behind_the_watermark(spark):
    """Orders expire 60 days after their last event, complete or not; what came before is forgotten, and no state is left of them."""
    orders = [(f"o{k}", s, day(k)) for k in range(5) for s in ("purchase", "approve")] + [("full", s, day(i)) for i, s in enumerate(gold.STAGES)]
    stream = logged(spark, orders, [("mark", "purchase", day(100))], [("mark", "approve", day(300))], [("mark", "shipping_limit", day(301))])
    said = {}
    watch = watched(spark, lambda: said.update(last_states(spark, timeline(stream, "first", expire_ms=SIXTY_DAYS, clock="event"), "expired")))
    assert max(watch.state_rows["expired"]) >= 7 and watch.state_rows["expired"][-1] == 1  # the mark's own
    assert said["full"][-1]["customer_delivery_delay_days"] == 1 and len(said["full"]) == 1


@pytest.mark.parametrize("until,ticks", [(61, 1), (67, 7), (100, 40), (400, 60)])
def test_timeouts_are_as_many_as_the_clock_says(spark, until, ticks):
    """Each day of the log's time adds two hours to the open stage, up to the expiry, in however many micro-batches it passes."""
    marks = [[("mark", "purchase", day(n))] for n in ([until] if until != 100 else [70, 80, 100])]
    updates = timeline(logged(spark, [("a", "purchase", day(0)), ("b", "purchase", day(0)), ("b", "approve", day(0))], *marks), "first", STEP_SECONDS, 86_400_000, SIXTY_DAYS, "event", seconds=True)
    seen = last_states(spark, updates, f"ticks_{until}")
    assert seen["a"][-1]["open_seconds"] == ticks * 7200 and seen["a"][-1]["purchase_to_approval_days"] == (ticks * 7200 // 86400 or 0)
    assert seen["b"][-1]["open_seconds"] == ticks * 7200 and seen["b"][-1]["approval_to_carrier_days"] == ticks * 7200 // 86400


def test_orders_of_a_bucket_keep_their_own_clocks(spark):
    """Orders share states, as many as there are buckets; each has its own timeouts and expiry, also where others of its bucket have events."""
    orders = [(f"o{k}", "purchase", day(k)) for k in range(10)]
    stream = logged(spark, orders, [("mark", "purchase", day(75))], [("mark", "approve", day(300))])
    said = {}
    updates = timeline(stream, "first", STEP_SECONDS, 86_400_000, SIXTY_DAYS, "event", seconds=True, buckets=1)
    watch = watched(spark, lambda: said.update(last_states(spark, updates, "shared")))
    assert max(watch.state_rows["shared"]) == 1
    assert all([r["open_seconds"] for r in said[f"o{k}"]] == [0, (15 - k) * 7200, 60 * 7200] for k in range(10))
    assert said["mark"][-1]["purchase_to_approval_days"] == 225


def test_a_query_goes_on_after_failures(spark):
    """Two topics: one fails in the middle of a batch, after its commit, and comes back from its checkpoint; nothing is twice."""
    folders, tables, left, said = {}, {}, {"one": 2, "two": 0}, []
    for t in left:
        folders[t], tables[t] = fresh(spark, t), snapshots.Table(spark, fresh(spark, f"table-{t}"), spark.range(0).schema)
        for k in range(3):
            spark.range(10 * k, 10 * k + 4).coalesce(1).write.mode("append").parquet(folders[t])
    checkpoints = {t: fresh(spark, "checkpoint") for t in left}

    def begin(topic):
        def sink(batch, number):
            tables[topic].commit(batch, "2024-01-01 00:00:00", topic, number)
            if number == 1 and left[topic]:
                left[topic] -= 1
                raise RuntimeError("killed")

        return start(folder_stream(spark, folders[topic], "id long", 1), f"topic-{topic}", each=sink, checkpoint=checkpoints[topic])

    boss = Supervisor(spark, {t: (lambda t=t: begin(t)) for t in left}, report=said.append)
    boss.run()
    for t in tables.values():
        assert sorted(r["id"] for r in t.read().collect()) == [k * 10 + j for k in range(3) for j in range(4)]
    assert boss.failures == {"one": 2} and any("failed 2 times" in x for x in said)


def test_a_query_that_fails_too_often_stops_all(spark):
    def begin():
        def sink(batch, number):
            raise RuntimeError("always")

        return start(files(spark, [("a", "purchase", day(0))]), "hopeless", each=sink)

    with pytest.raises(Exception, match="always"):
        Supervisor(spark, {"x": begin}, restarts=1, report=lambda s: None).run()
    assert not spark.streams.active


def test_order_detail_merges_once_and_is_compacted(spark):
    """A batch is merged, then the query dies; it comes back, another writer comes in between, and the mart has each line once."""
    schema = "order_id string, customer_id string, seller_id string, product_id string, category string, quantity long, unit_price double, ingest_time timestamp"
    line = lambda o, n, d, c="c": (o, "u", "s", "p", c, n, 1.0, day(d))
    folder = fresh(spark, "lines")
    for rows in ([line("a", 1, 0), line("b", 1, 0)], [line("a", 2, 1), line("a", 3, 2), line("b", 1, 1)], [line("c", 5, 3)], [line("c", 5, 4, "other")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    mart = snapshots.Table(spark, fresh(spark, "mart"), spark.createDataFrame([], schema).drop("ingest_time").schema)
    sink, state = streams.detail_sink(mart), {"dies": True, "meets": True}

    def each(batch, number):
        if number == 2 and state.pop("meets", False):
            mart.commit(spark.createDataFrame([("z", "u", "s", "p", "c", 9, 1.0)], mart.schema), "2024-01-01 00:00:00")
        sink(batch, number)
        if number == 1 and state.pop("dies", False):
            raise RuntimeError("killed after its merge")

    checkpoint = fresh(spark, "checkpoint")
    begin = lambda: start(folder_stream(spark, folder, schema, 1), "detail", each=each, checkpoint=checkpoint)
    Supervisor(spark, {"detail": begin}, report=lambda s: None).run()
    got = {r["order_id"]: (r["quantity"], r["category"]) for r in mart.read().collect()}
    assert got == {"a": (3, "c"), "b": (1, "c"), "c": (5, "other"), "z": (9, "c")} and mart.read().count() == 4
    assert len(mart.lines()) == 1 and len(mart.files()) == 1


def test_open_stages_grow_by_timeouts(spark):
    folder = fresh(spark, "open")
    spark.createDataFrame([("a", "purchase", day(0))], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    grown = []
    q = start(timeline(folder_stream(spark, folder, SCHEMA, 1), open_stage_step_seconds=86400, timeout_ms=200), "open", mode="update", each=lambda b, _: grown.extend(r[OPEN[0]] for r in b.collect()), seconds=1)
    try:
        for _ in range(60):
            if any(g and g >= 2 for g in grown):
                break
            q.awaitTermination(0.5)
    finally:
        q.stop()
    assert grown[0] is None and max(g or 0 for g in grown) >= 2


def test_orders_without_events_expire(spark):
    """The first event is forgotten before the second comes, so that the second order's row doesn't know it."""
    folder, seen = fresh(spark, "expire"), []
    add = lambda *row: spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    add("a", "purchase", day(0))
    q = start(timeline(folder_stream(spark, folder, SCHEMA, 1), "first", expire_ms=1), "expire", mode="update", each=lambda b, _: seen.extend(b.collect()), seconds=1)
    try:
        for _ in range(30):
            if seen and q.lastProgress and q.lastProgress["batchId"] >= 2:
                break
            q.awaitTermination(1)
        add("a", "approve", day(3))
        for _ in range(30):
            if len(seen) > 1:
                break
            q.awaitTermination(1)
    finally:
        q.stop()
    assert seen[0]["purchase"] == day(0) and seen[1]["purchase"] is None and seen[1]["approve"] == day(3)


def test_days_are_whole_and_rounded_down():
    at = lambda h: pd.Timestamp(DAY) + pd.Timedelta(hours=h)
    assert [days(at(h), at(20)) for h in (43, 44, 20, 19)] == [0, 1, 0, -1]


def test_late_rows_are_dropped_at_the_watermark(spark):
    schema = "k string, ts timestamp"
    at = lambda h: DAY + dt.timedelta(hours=h)
    # a batch drops what is behind the watermark that the batch before it began with
    s = files(spark, [("a", at(0)), ("b", at(100))], [("b", at(100))], [("on", at(76)), ("late", at(70))], [("end", at(400))], schema=schema)
    got = drain(s.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 hour"), "k").agg(F.count("*").alias("n")).select("k", "n"), "late")
    kept = {r["k"] for r in got.collect()}
    assert "late" not in kept and {"a", "b", "on"} <= kept


def test_supervisor_reports_and_raises(spark):
    said = []
    ok = start(files(spark, [("a", "purchase", day(0))]), "supervised_ok", fresh(spark, "out"))
    supervise(spark, [ok], 1, said.append)

    def fail(batch, _):
        raise ValueError("no")

    bad = start(files(spark, [("a", "purchase", day(0))]), "supervised_bad", each=fail)
    with pytest.raises(Exception):  # noqa: B017  Spark's own class
        supervise(spark, [bad], 1, said.append)


def test_log_source_asks_for_what_it_must(spark):
    """The Kafka reader's options, taken down by a stand-in, as the package isn't here: all topics, from the start, so many
    offsets at a time, and lost data don't stop it."""

    class Reader:
        def __init__(self):
            self.kind, self.options = None, {}

        def format(self, kind):
            self.kind = kind
            return self

        def option(self, name, value):
            self.options[name] = value
            return self

        def load(self):
            return spark.createDataFrame([(b"k", b"v", "t", 3)], "key binary, value binary, topic string, offset long")

    reader = Reader()
    rows = log_stream(type("Session", (), {"readStream": reader}), "host:1", ["a", "b"], 7)
    assert reader.kind == "kafka" and rows.columns == ["key", "value", "topic"]
    assert reader.options == {"kafka.bootstrap.servers": "host:1", "subscribe": "a,b", "startingOffsets": "earliest", "failOnDataLoss": "false", "maxOffsetsPerTrigger": 7}


def test_console(spark):
    start(files(spark, [("a", "purchase", day(0))]), "console_out", console=True).awaitTermination()


def test_a_year_of_the_log_is_one_micro_batch_in_any_number_of_files(spark, monkeypatch):
    assert streams.files_each([10_000_000, 3_000_000]) == 20 and streams.files_each([9_000_000, 3500]) == 3 and streams.files_each([500, 20]) == 1
    monkeypatch.setattr(streams, "FILE_ROWS", 300)
    monkeypatch.setattr(streams, "FEWEST", 100)
    years = []
    start(streams.event_log(spark, oracle.DATA), "years", each=lambda b, _: years.append((b.select(F.spark_partition_id()).distinct().count(), [r[0] for r in b.select(F.year("ingest_time")).distinct().collect()]))).awaitTermination()
    assert all(len(y) == 1 for _, y in years if y) and len([y for _, y in years if y]) == len({y[0] for _, y in years if y}) >= 7
    monkeypatch.undo()
    monkeypatch.setattr(streams, "FEWEST", 100)
    oracle.assert_same(spark, streams.stream_open_stages, streams.ORACLE_SQL["stream_open_stages"])


def test_a_log_has_its_state_in_partitions_by_its_rows(spark, monkeypatch):
    """No more of them than its rows ask for, but as many as there are cores; the session's number is as it was."""
    monkeypatch.setattr(sources, "STATE_ROWS", 100)
    before = spark.conf.get(sources.PARTS)
    spark.conf.set(sources.PARTS, "40")
    try:
        spark.range(50).write.parquet(path := fresh(spark, "rows"))
        for rows, want in ((50, spark.sparkContext.defaultParallelism), (850, 9), (None, 40)):
            counted = sources.folder_stream(spark, path, spark.range(0).schema).groupBy("id").count()
            query = sources.start(counted, f"rows_{want}", mode="complete", each=lambda df, _: df.count(), rows=rows)
            query.awaitTermination()
            assert query.lastProgress["stateOperators"][0]["numShufflePartitions"] == want
            assert spark.conf.get(sources.PARTS) == "40"
    finally:
        spark.conf.set(sources.PARTS, before)


def test_what_a_window_holds_are_packs(spark, monkeypatch):
    """Its state has a row for each window and bucket, not for each line, and the rows are the SQL's."""
    seen, begin = [], streams.drain

    def watch(df, name, **kwargs):
        out = []
        seen.append(watched(spark, lambda: out.append(begin(df, name, **kwargs))))
        return out[0]

    monkeypatch.setattr(streams, "drain", watch)
    monkeypatch.setattr(streams, "BUCKETS", 2)
    oracle.assert_same(spark, streams.stream_customer_orders, streams.ORACLE_SQL["stream_customer_orders"])
    lines, orders = (spark.read.parquet(f"{oracle.DATA}/{t}.parquet").count() for t in ("lineitem", "orders"))
    assert lines > 2 * orders > 0 and max(seen[0].state_rows["stream_customer_orders"]) < 2 * orders + 500


def test_what_a_join_holds_of_order_lines_are_packs(spark):
    """Its state has a row for each pack, not for each line, and the rows are the SQL's."""
    watch = watched(spark, lambda: oracle.assert_same(spark, streams.stream_order_detail, streams.ORACLE_SQL["stream_order_detail"]))
    assert max(watch.state_rows["stream_order_detail"]) < spark.read.parquet(f"{oracle.DATA}/lineitem.parquet").count() / 4
