import pytest
from pyspark.errors import PySparkException

from orderlake.operators import merge


def table(spark, rows):
    return spark.createDataFrame(rows, "k string, a long, b string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


T = [("x", 1, "p"), ("y", 2, None), (None, 9, "n")]


def test_insert_only(spark):
    out = merge.insert_only(table(spark, T), table(spark, [("x", 7, "q"), ("z", 3, "r"), ("z", 2, "s"), (None, 5, "m")]), ["k"])
    assert rows(out) == sorted([*T, ("z", 2, "s"), (None, 5, "m")], key=repr)


def test_insert_only_is_idempotent(spark):
    s = table(spark, [("x", 7, "q"), ("z", 3, "r")])
    once = merge.insert_only(table(spark, T), s, ["k"])
    assert rows(merge.insert_only(once, s, ["k"])) == rows(once)


@pytest.mark.parametrize("target", [T, []])
@pytest.mark.parametrize("source", [[("x", None, "q"), ("z", 3, "r")], []])
def test_coalesce(spark, target, source):
    out = merge.coalesce(table(spark, target), table(spark, source), ["k"])
    want = {r[0]: r for r in target if r[0]}
    for k, a, b in source:
        old = want.get(k, (k, None, None))
        want[k] = (k, old[1] if a is None else a, old[2] if b is None else b)
    assert rows(out) == sorted([*want.values(), *[r for r in target if r[0] is None]], key=repr)
    assert rows(merge.coalesce(out, table(spark, source), ["k"])) == rows(out)


def test_conditional(spark):
    s = table(spark, [("x", 1, "p2"), ("y", 2, "w"), ("z", 3, "r")])
    assert rows(merge.conditional(table(spark, T), s, ["k"], ["a"])) == sorted([*T, ("z", 3, "r")], key=repr)
    assert ("x", 1, "p2") in rows(merge.conditional(table(spark, T), s, ["k"], ["a", "b"]))


def test_overwrite_and_null_keys(spark):
    out = merge.overwrite(table(spark, T), table(spark, [("x", None, None), (None, 4, "o")]), ["k"])
    assert rows(out) == sorted([("x", None, None), ("y", 2, None), (None, 9, "n"), (None, 4, "o")], key=repr)


def test_duplicate_source_keys_fail(spark):
    with pytest.raises(PySparkException, match="several source rows"):
        merge.overwrite(table(spark, T), table(spark, [("x", 1, "a"), ("x", 2, "b")]), ["k"]).collect()


def test_single(spark):
    from pyspark.sql import functions as F

    s = table(spark, [("x", 1, "a"), ("x", 2, "b"), ("y", 1, "c")])
    assert rows(merge.single(s, ["k"], [F.desc("a")])) == [("x", 2, "b"), ("y", 1, "c")]


def test_latest_equals_merges_one_after_another(spark):
    batches = [[("x", 1, None), ("y", 2, "p")], [("x", None, "q")], [("x", 3, None), ("z", None, None)]]
    state = table(spark, [])
    for b in batches:
        state = merge.coalesce(state, table(spark, b), ["k"])
    rows_of = spark.createDataFrame([(*r, n) for n, b in enumerate(batches) for r in b], "k string, a long, b string, n int")
    assert rows(merge.latest(rows_of, ["k"], "n")) == rows(state) == rows(table(spark, [("x", 3, "q"), ("y", 2, "p"), ("z", None, None)]))
