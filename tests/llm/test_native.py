"""Chat formatting, exact dedup, mixing, quality rules."""

import math
import random

import helpers as H
import oracle
import pytest
from pyspark.sql import functions as F

from orderlake.llm import chat, exact, mixing, quality, registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, name):
    oracle.assert_same(spark, registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["op1_chat_formatting", "op3_exact_dedup", "op5_mixing", "op10_quality_rules", "op12_decontamination"])
def test_no_python_in_the_plan(spark, name):
    plan = registry.QUERIES[name](spark, oracle.DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


CONV = "conv_id long, turn long, role string, text string"


def turns(spark, rows):
    return spark.createDataFrame(rows, CONV)


def read(win):
    """conv_id -> turns read back, targets read back."""
    got = {}
    for r in chat.read_back(win).orderBy("conv_id", "window").collect():
        t, loss = got.setdefault(r["conv_id"], ([], []))
        t += [(x["role"], x["text"]) for x in r["turns"]]
        loss.append(r["loss_text"])
    return {k: (t, "".join(x)) for k, (t, x) in got.items()}


def test_chat_round_trip_over_many_windows(spark):
    random.seed(5)
    bits = ["</s>", "[INST]", "<s>", "\\", "<\\s>", "[\\\\/INST]", "a b", "\n", "<", "[", "<<SYS>>", "é\U0001f600"]
    rows = []
    for c in range(30):
        if c % 3 == 0:
            rows.append((c, -1, "system", f"be kind {c} [INST]"))
        for t in range(c * 9):
            rows.append((c, t, random.choice(["user", "assistant", "tool/x\n"]), "".join(random.choice(bits) for _ in range(random.randrange(40)))))
    win = chat.windows(turns(spark, rows), budget=80, history=20).cache()
    got = read(win)
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2], r[3]))
        assert got[c][0] == [(r[2], r[3]) for r in mine]
        assert got[c][1] == "".join(r[3] for r in mine if r[2] == "assistant")
    assert win.groupBy("conv_id").count().agg(F.max("count")).first()[0] > 5
    later = win.where("window > 0 AND conv_id = 27")
    assert later.count() > 1 and later.where(~F.col("text").startswith("<s>system\n")).count() == 0
    assert later.where("n_context > 1").count() > 0


def test_chat_budget_holds_for_short_turns(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", "w " * (t % 12)) for t in range(400)]
    win = chat.windows(turns(spark, rows), budget=100, history=20)
    used = win.select(F.aggregate(F.split("text", "</s>"), F.lit(0), lambda s, x: s + F.when(x == "", 0).otherwise(F.regexp_count(F.regexp_extract(x, r"(?s)\n(.*)", 1), F.lit(chat.WORD)) + chat.MARKS)).alias("n"))
    assert used.agg(F.max("n")).first()[0] <= 100


def test_chat_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (1, None, None, None), (1, 2, "assistant", "b"), (1, 2, "assistant", "a"), (1, 2, "assistant", "a"), (2, 0, "system", "only"), (3, 5, "assistant", H.LONG)]
    got = read(chat.windows(turns(spark, rows).withColumn("window", F.lit("mine"))))
    assert got[None] == ([("user", "x")], "")
    assert got[1] == ([("", ""), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")], "aab")
    assert got[2] == ([("system", "only")], "") and got[3][1] == H.LONG
    assert chat.windows(turns(spark, [])).count() == 0
    with pytest.raises(ValueError):
        chat.windows(turns(spark, rows), 10, 10)


def test_chat_long_system_turn_goes_to_windows_with_turns_only(spark):
    rows = [(1, 0, "system", "s " * 20_000), (1, 1, "user", "q"), (1, 2, "assistant", "a " * 40_000), (1, 3, "user", "r")]
    s = chat.spans(turns(spark, rows))
    owned = s.where("role <> 'system' AND NOT repeated").select("window").distinct().count()
    assert s.where("role = 'system'").count() == owned <= 3
    assert read(chat.windows(turns(spark, rows)))[1] == ([(r[2], r[3]) for r in rows], rows[2][3])


def test_exact_rounds_sort_and_do_not_hash(spark):
    rows = exact.digests(H.docs(spark, [f"t{i % 10}" for i in range(200)]).repartition(9))
    plan = exact.merge_runs(rows, "min", fan_in=2)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and plan.count("Sort [run") >= 3 and plan.count("Window [row_number") == 3


def test_exact_groups(spark):
    texts = ["Ab", "aB", "ab ", None, "", "É", "é", H.LONG, H.LONG, (2, "ab ")]
    for keep, best in (("min", min), ("max", max)):
        rows = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact.groups(H.clashing(H.docs(spark, texts)), keep=keep).collect()]
        want = []
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        for i, t in pairs:
            same = [j for j, u in pairs if (u or "").translate(H.LOWER) == (t or "").translate(H.LOWER)]
            want.append((i, best(same), len(same), i == best(same)))
        assert sorted(rows) == sorted(want)
    assert exact.groups(H.docs(spark, [])).count() == 0


@pytest.mark.parametrize("parts,fan_in", [(1, 2), (7, 2), (7, 64)])
def test_exact_tree_of_any_shape(spark, parts, fan_in):
    rows = exact.digests(H.docs(spark, [f"t{i % 10}" for i in range(200)]).repartition(parts))
    got = exact.merge_runs(rows, "min", fan_in=fan_in)
    assert sorted(r["keep_id"] for r in got.collect()) == list(range(10)) and {r["group_size"] for r in got.collect()} == {20}


def test_exact_drop(spark):
    left = exact.drop(H.clashing(H.docs(spark, ["a", "A", "b", (None, "a"), (None, None)])))
    assert sorted((r["doc_id"] for r in left.collect()), key=repr) == [0, 2, None, None] and left.columns == H.clashing(H.docs(spark, [])).columns


def test_mixing_counts(spark):
    src = {i: "big" if i % 3 else None if i % 2 else "small" for i in range(6000)}
    d = H.docs(spark, ["x"] * 6000, source=src)
    n = {k: sum(1 for v in src.values() if v == k) for k in ("big", "small", None)}
    got = mixing.mix(H.clashing(d).drop("copy"), targets={"big": 1.0, "small": 1.0}, copy_col="copy")
    by = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert None not in by and all(abs(by[k] - 3000) < 5 * math.sqrt(3000) for k in ("big", "small"))
    salted = mixing.mix(d, targets={"big": 1.0, "small": 1.0}, broadcast_rows=0)
    assert {r["source"]: r["count"] for r in salted.groupBy("source").count().collect()} == by
    free = {r["source"]: r["count"] for r in mixing.mix(d).groupBy("source").count().collect()}
    q = {k: math.sqrt(v) for k, v in n.items()}
    assert all(abs(free[k] - q[k] / sum(q.values()) * 6000) < 6 * math.sqrt(3000) for k in n)


def test_mixing_follows_poisson(spark):
    d = H.docs(spark, ["x"] * 20000)
    for mean in (1.0, 70.0):
        other = H.docs(spark, [(i, "y") for i in range(20000, 20000 + 200)], source={i: "o" for i in range(20000, 20200)})
        share = mean * 200 / 20200
        if mean > 1:  # 200 documents that come 70 times each, from several parts of the mean
            c = mixing.mix(d.unionByName(other), targets={"o": share, "s": 1 - share}).where("source = 'o'").groupBy("doc_id").count()
            m = c.agg(F.avg("count").alias("m"), F.variance("count").alias("v")).first()
            assert abs(m["m"] - mean) < 3 and 40 < m["v"] < 110
        else:
            c = dict(mixing.mix(d).groupBy("doc_id").count().groupBy("count").agg(F.count("*").alias("n")).collect())
            for k in range(1, 5):
                p = math.exp(-1) / math.factorial(k)
                assert abs(c[k] / 20000 - p) < 0.02


def test_mixing_odd_rows(spark):
    assert mixing.mix(H.docs(spark, [])).count() == 0
    twice = H.docs(spark, ["a", (0, "a"), None, H.LONG])
    got = {r["doc_id"]: r["count"] for r in mixing.mix(twice).groupBy("doc_id").count().collect()}
    assert got.get(0, 0) % 2 == 0
    assert mixing.mix(twice, targets={}).count() == 0


def brute_quality(t):
    w = H.WORD.findall(t or "")
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    cover = {k for i, x in enumerate(win) if win.count(x) > 1 for k in range(i, i + 3)}
    lines = [x for x in (t or "").split("\n") if H.WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t or ""), len(lines) - len(set(lines)), len(cover))


def test_quality_measures(spark):
    random.seed(3)
    texts = [None, "", " \n\t", "a", "a b c", "a b c a b c", "x " * 30, "#$%&|<>* é\x0b\x0cé\x85\xa0z", "l\nl\n \nl x\nl"] + ["".join(random.choice("ab \n") for _ in range(random.randrange(120))) for _ in range(60)]
    got = H.collected(quality.ledger(H.clashing(H.docs(spark, texts))), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for i, t in enumerate(texts):
        assert got[i] == brute_quality(t), t
    assert quality.ledger(H.docs(spark, [])).count() == 0
    assert quality.ledger(H.docs(spark, [H.LONG])).first()["n_words"] == 40_000


def test_quality_policies_and_ablations(spark):
    good = " ".join(f"good{i}" for i in range(60))
    d = H.clashing(H.docs(spark, [good, "short", good + " ###### #", (9, good), (9, good), (None, good)]))
    kept = quality.reject(d)
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == [0, 9, 9, None] and kept.columns == d.columns
    led = quality.ledger(d)
    got = {r["rule"]: (r["n_failed"], r["n_regained"]) for r in quality.ablations(led, "web-2").collect()}
    assert got["few_words"] == (1, 1) and got["symbols"] == (1, 1) and got["word_length"] == (0, 0)
    assert set(got) == set(quality.RULES) and led.where(quality.passes("base-1")).count() == 5
