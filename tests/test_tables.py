import random

import duckdb
import oracle
import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from orderlake.functions import bayes, scoring
from orderlake.operators import gold, jobs, merge, quality, relations, shapes, silver
from orderlake.plans import analyses, tables, texts
from orderlake.sources import contracts, envelope, files, snapshots
from orderlake.sources.paths import fresh

DAYS = [f"2024-01-0{d} 00:00:00" for d in range(1, 6)]


def commits(spark, n):
    t = snapshots.Table(spark, fresh(spark, "t"), spark.range(0).schema)
    for k in range(n):
        t.commit(spark.range(10 * k, 10 * k + 3), DAYS[k])
    return t


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_incremental_equals_full(spark):
    t, last, seen = commits(spark, 0), None, []
    assert snapshots.incremental(t, None)[0].count() == 0
    for k in range(4):
        t.commit(spark.range(10 * k, 10 * k + 3), DAYS[k])
        if k != 1:  # so that one run finds two commits
            rows, last = snapshots.incremental(t, last)
            seen += ids(rows)
    rows, again = snapshots.incremental(t, last)
    assert rows.count() == 0 and again == last
    assert sorted(seen) == ids(t.read())
    assert ids(snapshots.incremental(t, None, "all")[0]) == ids(t.read())
    assert ids(snapshots.incremental(t, None)[0]) == [0, 1, 2]


def test_commit_once_per_batch(spark):
    t = commits(spark, 1)
    assert t.commit(spark.range(5), DAYS[1], "app", 7) == t.commit(spark.range(5), DAYS[2], "app", 7) == 2
    assert t.read().count() == 8


def test_compact_and_expire(spark):
    t = commits(spark, 3)
    whole = ids(t.read())
    t.compact(2, DAYS[4])
    assert ids(t.read()) == whole and ids(t.as_of(2)) == [0, 1, 2, 10, 11, 12]
    t.expire(3)
    assert ids(t.read()) == whole and [r["commit_id"] for r in t.log().collect()] == [3]


def test_history_around_merge_compaction_and_expiry(spark):
    """Every state is read as it was; what rewrites moved isn't new; what expired is an error, and its files go."""
    t = snapshots.Table(spark, fresh(spark, "history"), spark.range(0).selectExpr("id", "id AS v").schema)
    rows = lambda *pairs: spark.createDataFrame(list(pairs), t.schema)
    both = lambda df: sorted(map(tuple, df.collect()))
    t.commit(rows((1, 1), (2, 2)).repartition(1), DAYS[0])
    t.commit(rows((3, 3)), DAYS[1], "app", 4)
    assert jobs.merge_changes(t, lambda: rows((2, 20), (3, 3), (9, 9)), ["id"], lambda a, b: merge.overwrite(a, b, ["id"]), DAYS[2]) == 3
    assert t.compact(3, DAYS[3]) == 4
    t.commit(rows((5, 5)), DAYS[4])
    states = {0: [], 1: [(1, 1), (2, 2)], 2: [(1, 1), (2, 2), (3, 3)], 3: [(1, 1), (2, 20), (3, 3), (9, 9)]}
    states[4] = states[3]
    states[5] = sorted([*states[3], (5, 5)])
    for n, want in states.items():
        assert both(t.as_of(n)) == want
    changes = {(0, 1): states[1], (1, 2): [(3, 3)], (2, 3): [(2, 20), (9, 9)], (3, 4): [], (3, 5): [(5, 5)], (1, 5): [(2, 20), (3, 3), (5, 5), (9, 9)], (5, 5): []}
    for (a, b), want in changes.items():
        assert both(t.between(a, b)) == want
    for wrong in (lambda: t.as_of(6), lambda: t.between(4, 6), lambda: t.as_of(-1)):
        with pytest.raises(snapshots.Expired):
            wrong()
    first = t.files(1)
    assert set(first) & set(t.expire(3)) and not any(t.store.fs.exists(t.store.at(f"{t.path}/{f}")) for f in first)
    for wrong in (lambda: t.as_of(2), lambda: t.as_of(0), lambda: t.between(1, 4), lambda: snapshots.incremental(t, 1)):
        with pytest.raises(snapshots.Expired):
            wrong()
    assert [both(t.as_of(n)) for n in (3, 4, 5)] == [states[3], states[4], states[5]] and both(t.between(2, 5)) == [(2, 20), (5, 5), (9, 9)]
    assert t.commit(rows((7, 7)), DAYS[4], "app", 4) == 2 and both(t.read()) == states[5]
    again = snapshots.Table(spark, t.path, t.schema)
    assert again.expire(5) and both(again.read()) == states[5] and len(again.lines()) == 1


def test_lines_are_bounded_by_checkpoints(spark, monkeypatch):
    monkeypatch.setattr(snapshots, "EVERY", 3)
    t = commits(spark, 5)
    for k in range(5):
        t.commit(spark.range(100 + k, 101 + k), DAYS[k])
    fresh_reader = snapshots.Table(spark, t.path, t.schema)
    assert ids(fresh_reader.read()) == ids(t.read()) and len(fresh_reader.lines()) == 10 and len(fresh_reader.seen) == 2
    t.expire(9)
    names = [s.getPath().getName() for s in t.store.list(f"{t.path}/log")]
    assert len([n for n in names if n.endswith(".json")]) == 2 and t.last() == 10 and len(t.lines()) == 2


def test_expiry_removes_lost_attempts_and_torn_lines_dont_count(spark):
    t = commits(spark, 2)
    t.write(spark.range(3), "lost")
    assert len(t.store.list(f"{t.path}/data")) == 3
    t.expire(2)
    assert len(t.store.list(f"{t.path}/data")) == 3  # young
    t.expire(2, lost_after_ms=-60_000)
    assert len(t.store.list(f"{t.path}/data")) == 2 and len(ids(t.read())) == 6
    t.store.create(f"{t.path}/log/{3:020d}.json", '{"commit_id": 3, "new": [')
    assert len(ids(t.read())) == 6 and t.last() == 2


def test_rewrites_conflict_but_appends_pass(spark):
    t = commits(spark, 2)
    files = t.files()
    t.commit(spark.range(90, 91), DAYS[2])
    assert t.compact(2, DAYS[3]) == 4
    with pytest.raises(snapshots.Conflict):  # its files went into the compaction
        t.add({"committed_at": DAYS[3], "operation": "compact", "app": "", "batch": None, "new": [], "kept": [], "gone": files}, 2)
    with pytest.raises(snapshots.Conflict):
        t.rewrite(2, [], spark.range(1), spark.range(0), DAYS[3])


def test_merge_rewrites_only_files_with_its_keys(spark):
    t = commits(spark, 4)
    before = set(t.files())
    jobs.merge_changes(t, lambda: spark.range(11, 12).union(spark.range(77, 78)), ["id"], lambda a, b: merge.insert_only(a, b, ["id"]), DAYS[4])
    gone = before - set(t.files())
    assert ids(t.rows(sorted(gone))) and 11 in ids(t.rows(sorted(gone))) and len(gone) == 1
    assert ids(t.between(4, 5)) == [77] and ids(t.read()) == sorted([k * 10 + j for k in range(4) for j in range(3)] + [77])


def test_joins_lose_nothing_in_any_order_of_commits(spark):
    """Random splits of both sources over commits, one of them silent at times: the jobs end at the full result."""
    random.seed(7)
    products = [(f"p{k}", f"c{k % 3}") for k in range(8)]
    items = [(f"o{k % 6}", k, f"p{k % 5 if k % 4 else k % 8}", 1.0 + k % 2, f"s{k % 2}") for k in range(30)]
    paid = [(f"o{k}", f"u{k % 3}") for k in range(6)]
    schemas = {"product": "product_id string, category string", "items": "order_id string, order_item_id int, product_id string, price double, seller_id string", "payment": "order_id string, customer_id string"}
    empty = lambda name: spark.createDataFrame([], schemas[name]).schema
    for trial in range(3):
        sources = {n: snapshots.Table(spark, fresh(spark, n), empty(n)) for n in schemas}
        frames = {n: spark.createDataFrame(rows, schemas[n]) for n, rows in (("product", products), ("items", items), ("payment", paid))}
        make = {
            "products": (["product", "items"], ["product_id", "category", "seller_id"], silver.product_metadata, "join", ()),
            "orders": (["items", "payment"], ["order_id", "product_id", "seller_id", "customer_id", "unit_price"], silver.customer_orders, "recount", ("order_id",)),
        }
        marks = snapshots.Table(spark, fresh(spark, "marks"), snapshots.MARKS)
        todo = []
        for name, rows in (("product", products), ("items", items), ("payment", paid)):
            parts = [[] for _ in range(random.choice([1, 2, 3]))]
            for r in rows:
                random.choice(parts).append(r)
            todo += [(name, p) for p in parts if p]
        random.shuffle(todo)
        work = {}
        for key, (names, keys, transform, how, touched) in make.items():
            target = snapshots.Table(spark, fresh(spark, key), transform(**{n: frames[n] for n in names}).schema)
            work[key] = jobs.SilverJob(key, {n: sources[n] for n in names}, target, marks, keys, transform, how, touched)
        for name, part in todo:
            sources[name].commit(spark.createDataFrame(part, schemas[name]).coalesce(1), DAYS[0])
            if random.random() < 0.6 or (name, part) == todo[-1]:
                for job in work.values():
                    job.catch_up(DAYS[1])
        for key, (names, _, transform, *_rest) in make.items():
            want = transform(**{n: frames[n] for n in names})
            got = work[key].target.read().select(*want.columns)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), (trial, key, todo)


def test_compaction_keeps_batches_known(spark):
    t = commits(spark, 1)
    assert t.commit(spark.range(5), DAYS[1], "app", 7) == 2
    t.compact(2, DAYS[2])
    assert t.commit(spark.range(5), DAYS[3], "app", 7) == 2 and t.read().count() == 8


def test_a_number_taken_meanwhile(spark, monkeypatch):
    """Another writer commits between reading the log and writing the line."""
    t, other = commits(spark, 1), []
    put = t.put

    def late(number, *rest):
        if not other:
            other.append(snapshots.Table(spark, t.path, t.schema).commit(spark.range(100, 103), DAYS[1]))
        put(number, *rest)

    monkeypatch.setattr(t, "put", late)
    assert t.commit(spark.range(50, 53), DAYS[2], wait=0.01) == 3 and other == [2]
    assert ids(t.read()) == [0, 1, 2, 50, 51, 52, 100, 101, 102]


def test_last_processed(spark):
    marks = spark.createDataFrame([("a", "s", 3)], "app_name string, src string, last_processed_snapshot_id long")
    assert snapshots.last_processed(marks, "a", "s") == 3 and snapshots.last_processed(marks, "b", "s") is None


def test_corrupt_payload_is_kept_apart(spark):
    log = spark.createDataFrame([(b"c1", b"\0\0\0\0\1" + b'{"zip_code":5}', "bronze.customer"), (b"c2", b"\0\0\0\0\1" + b"{oops", "bronze.customer"), (b"c3", b"\0\0\0\0\1{}", "other")], "key binary, value binary, topic string")
    got = {r["customer_id"]: (r["zip_code"], r[envelope.CORRUPT]) for r in envelope.decode(log, "bronze.customer", envelope.contract_of("bronze.customer")).collect()}
    assert got == {"c1": (5, None), "c2": (None, "{oops")}


def test_composite_key_comes_back(spark):
    u = spark.createDataFrame([("customer", "7", 3)], "user_type string, user_id string, zip_code int")
    log = envelope.encode(u, "silver.user", ["user_type", "user_id"])
    assert tuple(envelope.decode(log, "silver.user", contracts.SILVER["user"]).select("user_type", "user_id", "zip_code").first()) == ("customer", "7", 3)


def test_contract_key_is_last_and_not_null(spark):
    c = contracts.BRONZE["customer"]
    assert [(f.name, f.nullable) for f in c.schema] == [("zip_code", True), ("customer_id", False)]
    assert contracts.project(spark.createDataFrame([("1", None), (None, "4")], "zip_code string, customer_id string"), c).count() == 1


def test_files(spark):
    folder = fresh(spark, "csv")
    for name in ("raw_orders_dataset", "raw_items_dataset"):
        spark.createDataFrame([("a", "n/a"), ("a", "n/a"), ("b", "2")], "k string, v string").coalesce(1).write.csv(f"{folder}/{name}", header=True)
    made = files.dedup_files(spark, [f"{folder}/raw_orders_dataset", f"{folder}/raw_items_dataset"], fresh(spark, "out"))
    assert [m.rpartition("/")[2] for m in made] == ["orders", "items"]
    assert sorted(tuple(r) for r in spark.read.parquet(made[0]).collect()) == [("a", "n/a"), ("b", "2")]
    assert len(files.list_files(spark, folder, "*.csv")) == 2


def test_tables_and_namespaces(spark):
    files.make_namespace(spark, "ns_test")
    files.write_table(spark.range(3), "ns_test.t")
    files.write_table(spark.range(2), "ns_test.t")
    assert spark.table("ns_test.t").count() == 5
    files.write_table(spark.range(1), "ns_test.t", "replace")
    assert spark.table("ns_test.t").count() == 1
    files.make_empty(spark, "ns_test.e", contracts.SILVER["watermark"].schema)
    assert spark.table("ns_test.e").count() == 0
    files.make_namespace(spark, "ns_test", drop=True)
    assert spark.sql("SHOW TABLES IN ns_test").count() == 0


def test_geography_edges(spark):
    df = spark.createDataFrame([(1, 2.81972, -72.89583), (2, 2.82, -50.0), (3, None, -50.0)], "zip_code int, lat double, lng double")
    assert ids(silver.geo_coord(df).select("zip_code")) == [1]
    assert df.where(~quality.in_bounds()).count() == 1


def test_quarantine_splits(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (None, None)], "a int, b string")
    good, bad = quality.quarantine(df)
    assert good.count() == 1 and bad.count() == 2
    assert {r[0]: r[1] for r in quality.null_audit(df).collect()} == {"a": 1, "b": 2}


@pytest.mark.parametrize("n,high", [(([1, 2, 3]), [3]), ([5], [])])
def test_portfolio_edges(spark, n, high):
    df = spark.createDataFrame([(x, 1.0) for x in n], "q long, p double")
    mid = sorted(n)[(len(n) - 1) // 2]
    got = {r["q"]: r["g"] for r in df.select("q", quality.portfolio(F.col("q"), F.col("p"), F.lit(mid), F.lit(1.0)).alias("g")).collect()}
    assert sorted(q for q, g in got.items() if g == "Star Products") == high and got[mid] == "Niche Gems"


def test_running_over_partitions(spark):
    df = spark.range(100).withColumn("v", F.col("id") % 7)
    got = {r["id"]: (r["running"], r["row"], r["total"], r["rows"]) for r in shapes.running(df, [F.asc("id")], "v", 8).collect()}
    s = 0
    for i in range(100):
        s += i % 7
        assert got[i][:2] == (s, i + 1) and got[i][3] == 100


def test_scores_stay_with_their_rows(spark):
    class Lengths:
        def __call__(self, texts):
            return pd.DataFrame({"n": [float(len(t)) for t in texts]})

    df = spark.createDataFrame([(i, "x" * (i % 11)) for i in range(200)] + [(999, None)], "i int, t string")
    got = scoring.score_distinct(df, "t", Lengths, ["n"], chunk=3)
    rows = {r["i"]: (r["t"], r["n"]) for r in got.collect()}
    assert len(rows) == 201 and rows[999] == (None, None)
    assert all(n == len(t) for t, n in rows.values() if t is not None)


def test_held_out_accuracy(spark):
    """The fitted model tells more held-out documents right than the most frequent label would."""
    rows = texts.held_out_accuracy(spark, "/root/testdata/sf0.01").collect()
    right, n = sum(r["n_right"] for r in rows), sum(r["n_rows"] for r in rows)
    assert n > 80 and right / n >= 0.85 > max(r["n_rows"] for r in rows) / n
    model = texts.judge(spark, oracle.DATA)()
    assert model(["", "plain words", None]).shape == (3, 3) and abs(model(["a"]).sum(axis=1)[0] - 1) < 1e-9


def test_a_model_of_nothing(spark):
    none = spark.createDataFrame([], "id long, t string, k string")
    assert bayes.fit(none, "t", "k", ["a", "b"], "id")(["x"]).iloc[0].tolist() == [0.5, 0.5]


def test_foreign_keys_are_counted(spark):
    a = spark.createDataFrame([(i, i % 7) for i in range(50)], "a_itemkey long, a_ownerkey long")
    b = spark.createDataFrame([(i, f"n{i}") for i in range(7)], "b_ownerkey long, name string")
    c = spark.createDataFrame([(i % 3,) for i in range(9)], "c_ownerkey long")  # no key: its values repeat
    few = spark.createDataFrame([(i,) for i in range(45)], "d_itemkey long")
    got = {tuple(r) for r in relations.foreign_keys({"a": a, "b": b, "c": c, "few": few}, 0.9).collect()}
    assert got == {("a", "a_ownerkey", "b", "b_ownerkey", 7, 7), ("c", "c_ownerkey", "b", "b_ownerkey", 3, 3), ("few", "d_itemkey", "a", "a_itemkey", 45, 45), ("a", "a_itemkey", "few", "d_itemkey", 50, 45)}
    assert relations.foreign_keys({"b": b}).count() == 0


def test_waiting_for_a_table(spark):
    with pytest.raises(TimeoutError):
        files.wait_for(spark, "never_made", 0.1, 0.05)
    spark.range(3).createOrReplaceTempView("made_already")
    files.wait_for(spark, "made_already", 0)


def test_outputs_of_workers_come_together(spark):
    rows = shapes.together([spark.createDataFrame([(1, "a")], "i int, x string"), spark.createDataFrame([(2, 0.5)], "i int, y double")]).orderBy("i").collect()
    assert [tuple(r) for r in rows] == [(1, "a", None), (2, None, 0.5)]


def test_conflicting_labels_fail(spark):
    s = spark.createDataFrame([("a", "p"), ("a", "n")], "text string, label string")
    with pytest.raises(Exception, match="conflicting labels"):
        scoring.combine(s, spark.createDataFrame([("a", "b")], "text string, por string"), "text", "label").collect()


def test_what_the_batch_knows_as_delivered_is_not_open(spark):
    batch = spark.createDataFrame([("1", "2024-02-03", "2024-01-30"), ("2", None, "2024-01-02")], "order_id string, d string, p string").selectExpr("order_id", "CAST(d AS timestamp) AS delivered_customer", "CAST(p AS timestamp) AS purchase")
    stream = spark.createDataFrame([("1",), ("2",), ("3",)], "order_id string").selectExpr("order_id", "CAST(NULL AS timestamp) AS delivered_customer", "CAST(NULL AS timestamp) AS purchase")
    assert sorted(r["order_id"] for r in gold.open_orders(batch, stream).collect()) == ["2", "3"]


def test_sales_month_is_that_of_delivery(spark):
    lead = spark.createDataFrame([("1", "2024-02-03", "2024-01-30"), ("2", None, "2024-01-02"), ("3", "2024-02-09", None)], "order_id string, d string, p string").selectExpr("order_id", "CAST(d AS timestamp) AS delivered_customer", "CAST(p AS timestamp) AS purchase")
    detail = spark.createDataFrame([("1", "p", "c", 2, 5.0), ("2", "p", "c", 1, 5.0), ("3", "q", "c", 1, 9.0)], "order_id string, product_id string, category string, quantity long, unit_price double")
    got = sorted((r["product_id"], r["sales_period"], r["total_sales_quantity"], r["total_sales_amount"], r["group"]) for r in gold.monthly_sales(lead, detail).collect())
    assert got == [("p", "2024-02", 2, 10.0, "Star Products"), ("q", "2024-02", 1, 9.0, "Niche Gems")]


def test_locations_of_the_batch_come_first(spark):
    kind = "user_type string, user_id string, zip_code int, lat double, lng double"
    batch = spark.createDataFrame([("customer", "1", 5, 1.0, 1.0), ("customer", "2", 5, None, 1.0)], kind)
    stream = spark.createDataFrame([("customer", "1", 5, 9.0, 9.0), ("customer", "2", 5, 9.0, 9.0), ("seller", "1", 5, 3.0, 3.0), ("seller", "2", 5, 3.0, None)], kind)
    got = sorted((r["user_type"], r["user_id"], r["lat"]) for r in gold.known_locations(batch, stream).collect())
    assert got == [("customer", "1", 1.0), ("seller", "1", 3.0)]


def test_silver_rows_come_once(spark):
    geo = spark.createDataFrame([(1, -10.0, -50.0)] * 2 + [(2, 3.0, -50.0), (3, -10.0, -73.5), (4, 2.81972, -34.80861)], "zip_code int, lat double, lng double")
    assert sorted(r["zip_code"] for r in silver.geo_coord(geo).collect()) == [1, 4]
    u = spark.createDataFrame([("a", 1), ("a", 1)], "customer_id string, zip_code int")
    assert silver.users(u, u.withColumnRenamed("customer_id", "seller_id")).count() == 2


def test_portfolio_at_the_cut(spark):
    df = spark.createDataFrame([(4, 1.0), (5, 1.0), (5, 0.5)], "q long, p double")
    got = [r[0] for r in df.select(quality.portfolio(F.col("q"), F.col("p"), F.lit(5), F.lit(1.0), at_cut=True)).collect()]
    assert got == ["Niche Gems", "Star Products", "Volume Drivers"]


def test_a_replacing_commit_is_the_table(spark):
    t = commits(spark, 2)
    assert t.commit(spark.range(3), DAYS[3], after=2) == 3 and ids(t.read()) == [0, 1, 2]
    with pytest.raises(AnalysisException):  # made of a state that another writer has left behind
        t.commit(spark.range(9), DAYS[4], after=2)
    t.commit(spark.range(50, 51), DAYS[4])
    assert ids(t.read()) == [0, 1, 2, 50]


def test_silver_job_reads_once_and_repeats_safely(spark):
    source, schema = commits(spark, 3), spark.range(0).schema
    job = jobs.SilverJob("j", {"rows": source}, snapshots.Table(spark, fresh(spark, "target"), schema), snapshots.Table(spark, fresh(spark, "marks"), snapshots.MARKS), ["id"], lambda rows: rows.where("id <> 1"))
    assert job.run(DAYS[0]) == 2  # the first run takes the earliest commit
    assert job.catch_up(DAYS[1]) == [6] and job.run(DAYS[2]) is None
    job.marks = snapshots.Table(spark, fresh(spark, "lost-marks"), snapshots.MARKS)
    assert job.catch_up(DAYS[3]) == [0, 0] and ids(job.target.read()) == [0, 2, 10, 11, 12, 20, 21, 22]


def test_merge_into_again_after_another_writer(spark, monkeypatch):
    t, once = commits(spark, 1), []

    def how(target, source):
        if not once:
            once.append(t.commit(spark.range(70, 71), DAYS[1]))
        return target.union(source)

    assert jobs.merge_into(t, lambda: spark.range(90, 91), how, DAYS[2]) == 3
    assert ids(t.read()) == [0, 1, 2, 70, 90]


def test_prices_are_rounded_as_in_sql(spark, tmp_path):
    """77710.15 / 14 and 5550.73 are one price in SQL, which scales doubles before it rounds; by their digits they were two."""
    rows = [(1, 77710.15, 14.0), (1, 5550.73, 1.0), (2, 74953.18, 4.0), (2, 18738.30, 1.0), (3, -77710.15, 14.0), (3, -5550.73, 1.0)]
    spark.createDataFrame(rows, "l_partkey long, l_extendedprice double, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    want = con.sql(analyses.ORACLE_SQL["price_variants"].replace("lineitem", f"'{tmp_path}/lineitem.parquet/*.parquet'")).fetchall()
    assert [tuple(r) for r in analyses.QUERIES["price_variants"](spark, str(tmp_path)).collect()] == want == [(2, 2)]


def test_a_merge_makes_its_source_once(spark):
    """Rows of the source, as many of one key and value as they were, and no more work than one pass over it."""
    t, made = snapshots.Table(spark, fresh(spark, "once"), spark.createDataFrame([], "id long, v long").schema), spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(x):
        made.add(1)
        return x

    t.commit(spark.createDataFrame([(1, 1), (2, 2), (2, 2), (3, 3), (None, 7)], "id long, v long"), DAYS[0])
    source = spark.range(2, 6).select("id", seen.asNondeterministic()(F.when(F.col("id") == 3, 3).otherwise(9)).alias("v"))
    jobs.merge_changes(t, lambda: source, ["id"], lambda a, b: merge.overwrite(a, b, ["id"]), DAYS[1])
    assert sorted(map(tuple, t.read().collect()), key=repr) == [(1, 1), (2, 9), (2, 9), (3, 3), (4, 9), (5, 9), (None, 7)]
    assert sorted(map(tuple, t.between(1, 2).collect())) == [(2, 9), (2, 9), (4, 9), (5, 9)]
    assert made.value == 4


def test_what_a_model_is_fitted_on_is_found_by_hashes(spark):
    """The first by hash, as an ordered limit gives them, without gathering rows in one task; of equal ones no more than asked for."""
    rows = spark.range(5000).select(F.when(F.col("id") > 3, F.col("id")).alias("id"), F.lit("text").alias("t"))
    for most in (0, 1, 3, 4, 5, 37, 1000, 4999, 5000, 6000):
        want = sorted(r["id"] or -1 for r in rows.orderBy(F.md5(F.col("id").cast("string"))).limit(most).collect())
        found = bayes.least(rows, "id", most)
        assert sorted(r["id"] or -1 for r in found.collect()) == want
        if most > 4:
            assert "Limit" not in found._jdf.queryExecution().toString() and "TakeOrdered" not in found._jdf.queryExecution().toString()
    twice = rows.union(rows)
    assert bayes.least(twice, "id", 1001).count() == 1001


def test_revenue_is_made_in_parts_that_stay_small(spark, monkeypatch):
    """The join and the distinct count of orders work on what is dealt by order, over more parts where there are more lines."""
    monkeypatch.setattr(shapes, "PART_ROWS", 500)
    oracle.assert_same(spark, analyses.QUERIES["category_revenue"], analyses.ORACLE_SQL["category_revenue"])
    n = -(-spark.read.parquet(f"{oracle.DATA}/lineitem.parquet").count() // 500)
    plan = analyses.QUERIES["category_revenue"](spark, oracle.DATA)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert n > 10 and "Aggregate" in plan[0]
    join, parts = next(k for k, x in enumerate(plan) if "Join" in x), [k for k, x in enumerate(plan) if "RepartitionByExpression [l_orderkey#" in x and x.endswith(f", {n}")]
    assert len(parts) == 2 and join < min(parts)


def test_what_is_compacted_has_as_many_files_as_its_bytes_fill(spark, monkeypatch):
    """A number of files is the fewest: where these would be too large there are more, so that no task writes a share that grows."""
    t = commits(spark, 3)
    before, sizes = ids(t.read()), [t.store.size(f"{t.path}/{f}") for f in t.files(2)]
    monkeypatch.setattr(snapshots, "FILE_BYTES", sum(sizes) // 3)
    rest = len(t.files()) - len(sizes)
    t.compact(2, DAYS[4], files=2)
    compacted = t.lines()[-1]
    assert len(compacted["gone"]) == len(sizes) and len(t.files()) - rest == len(compacted["kept"]) > 2 and ids(t.read()) == before


def test_lines_of_compacted_orders_are_counted_in_parts_that_stay_small(spark, monkeypatch):
    monkeypatch.setattr(shapes, "PART_ROWS", 500)
    oracle.assert_same(spark, tables.QUERIES["compact_table"], tables.ORACLE_SQL["compact_table"])
    n = -(-spark.read.parquet(f"{oracle.DATA}/lineitem.parquet").count() // 500)
    plan = tables.QUERIES["compact_table"](spark, oracle.DATA)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert n > 10 and any("RepartitionByExpression [l_orderkey#" in x and x.endswith(f", {n}") for x in plan)


@pytest.mark.parametrize("name", ["argmax_label", "held_out_accuracy"])
def test_a_model_is_fitted_on_all_labelled_documents(spark, monkeypatch, name):
    """Neither the query nor its SQL takes the first so many by hash."""
    monkeypatch.setattr(bayes, "least", lambda rows, order, most: rows.limit(5))
    assert "LIMIT" not in texts.ORACLE_SQL[name]
    oracle.assert_same(spark, texts.QUERIES[name], texts.ORACLE_SQL[name])
