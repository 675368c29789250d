import json

import pytest
from pyspark.sql import functions as F

from orderlake.functions import text
from orderlake.plans import texts

PAIRS = [
    ("BOM \U0001f600 demais", "bom. demais"), ("ok :) veja", "ok. veja"), ("http://a.com", "http://a.com"), ("https://a.com", "https./a.com"), ("a 'b", "a b"), ('diz ""', "diz"), ("que!!!", "que"), ("muuuito", "muito"),
    ("ab", None), ("fim .,+", "fim"), ("a  b\nc", "a b c"), ("x ' y  ' z", "x 'y' z"), (None, None), ("não ,sim", "não,sim"), ("um -- dois", "um - dois"), ("", None),
]


@pytest.mark.parametrize("given,want", PAIRS)
def test_clean(spark, given, want):
    got = text.clean_rows(spark.createDataFrame([(given,)], "t string"), "t").collect()
    assert [r[0] for r in got] == ([] if want is None else [want])


def test_corrections(spark):
    df = spark.createDataFrame([("1", "title", "bad"), ("2", "title", "x")], "review_id string, message_type string, text string")
    fixes = spark.createDataFrame([("1", "title", "good"), ("2", "title", " ")], "review_id string, message_type string, fixed string")
    for most in (10, 0):
        assert [tuple(r) for r in text.corrected(df, fixes, ["review_id", "message_type"], "text", most).collect()] == [("1", "title", "good")]


def test_all_steps_of_the_whole_job(spark, tmp_path):
    """Corrections beside the tables are put in, ends are trimmed after the last step, a run of slashes of an address is left to the next step, and an emoji is what Unicode says."""
    said = {0: "fim +", 1: "http:///a  //b", 2: "voltei \u2192 \u00a9 \u2713", 3: "um \U0001f468\u200d\U0001f469\u200d\U0001f467x", 4: "wrong text", 5: "goes away", 6: "n\u00e3o 1\ufe0f\u20e3", 7: "stays"}
    spark.createDataFrame([(i, t, "en", "http") for i, t in said.items()], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.range(8).select(F.col("id").alias("o_orderkey"), F.lit("2024-01-01").cast("timestamp_ntz").alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    got = lambda: {r["review_id"]: r["text"] for r in texts.clean_text(spark, str(tmp_path)).where("message_type = 'message'").collect()}
    plain = {"0": "fim", "1": "http:/a /b", "2": "voltei \u2192. \u2713", "3": "um.x", "4": "wrong text", "5": "goes away", "6": "n\u00e3o", "7": "stays"}
    assert got() == plain
    (tmp_path / "manual_fix_reviews.json").write_text(json.dumps({"review_comment_message": {"4": "right text", "5": " ", "99": "nobody"}, "review_comment_title": {"7": "a title"}}, indent=1))
    assert got() == {k: t for k, t in (plain | {"4": "right text"}).items() if k != "5"}
    assert [r["text"] for r in texts.clean_texts_distinct(spark, str(tmp_path)).collect()] == ["voltei \u2192. \u2713", "http:/a /b", "right text", "a title", "stays", "http", "um.x", "fim", "n\u00e3o"]


def test_texts_are_cleaned_once(spark):
    """What is left of a text is asked after the steps, which stand in the plan once."""
    df = text.clean_rows(spark.createDataFrame([("a  b!!! ",), ("!",), (None,)], "t string").repartition(2), "t")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 and [r["t"] for r in df.collect()] == ["a b"]
