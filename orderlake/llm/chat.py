r"""Chat formatting in budgeted windows.

A turn is written as ``<s>role\ntext</s>``. Control strings inside a text get a backslash after their first character
(one more if there are some already), which ``unescape`` takes away again; roles are URL-encoded.

Windows come from prefix sums of turn tokens. A conversation's stride is half of what the budget leaves after its system
turn and the history; a turn belongs to the window in whose stride it starts. A span is thus whole turns, and a window
keeps within the budget unless one turn alone is longer than a stride (it is never cut). Each window begins with the
system turn, then repeats those turns of the span before that start within the last ``history`` tokens before its own
stride; repeated assistant turns are outside the loss mask, so that each one is a target exactly once.

Prefix sums have two levels, segments of 64 turn numbers and their totals, so a very long conversation is dealt over
many tasks; nothing holds it whole but the digest of the thin query, whose SHA-256 asks for one string.

Defined results: null role or text counts as empty; null turns come first; turns with equal numbers go by role, then
text; repeated rows are turns of their own; a null conv_id is one conversation; no rows give no windows; further columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from orderlake.llm.common import table

BUDGET, HISTORY, SEGMENT = 1024, 128, 64
#: Tokens that the marks of a turn take.
MARKS = 4
WORD = r"[^\x20\x09-\x0D]+"
#: <s> </s> <<SYS>> <</SYS>> [INST] [/INST], with any number of backslashes after their first character.
CONTROL = r"([<\[])(\\*)(/?(?:s>|SYS>|INST\]))"
ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|SYS>|INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def turn_tokens(text: Column) -> Column:
    """Words and the marks of a turn."""
    return (F.regexp_count(text, F.lit(WORD)) + MARKS).cast("long")


def spans(conv: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row for each turn of each window: conv_id, window, idx, role, text, repeated."""
    if budget <= history:
        raise ValueError("the budget must exceed the history")
    t = conv.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("tokens", turn_tokens(F.col("text"))).withColumn("seg", F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(-(2**62))))
    inside = W.partitionBy("conv_id", "seg").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = t.withColumn("rn", F.row_number().over(inside)).withColumn("before", F.sum("tokens").over(inside.rowsBetween(W.unboundedPreceding, -1)))
    totals = t.groupBy("conv_id", "seg").agg(F.count("*").alias("n"), F.sum("tokens").alias("seg_tokens"), F.max(F.when((F.col("rn") == 1) & (F.col("role") == "system"), F.col("tokens"))).alias("sys"))
    along = W.partitionBy("conv_id").orderBy("seg")
    earlier, whole = along.rowsBetween(W.unboundedPreceding, -1), W.partitionBy("conv_id")
    totals = totals.select(
        F.col("conv_id").alias("c"), F.col("seg").alias("s"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("seg_tokens").over(earlier), F.lit(0)).alias("seg_before"),
        F.coalesce(F.first("sys").over(along), F.lit(0)).alias("sys"),
        F.sum("seg_tokens").over(whole).alias("all_tokens"),
    )
    t = t.join(totals, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("seg") == F.col("s")))
    t = t.withColumn("idx", F.col("n_before") + F.col("rn") - 1).withColumn("is_sys", (F.col("idx") == 0) & (F.col("sys") > 0))
    t = t.withColumn("start", F.col("seg_before") + F.coalesce("before", F.lit(0)) - F.when(F.col("idx") > 0, F.col("sys")).otherwise(0))
    t = t.withColumn("stride", F.greatest(F.floor((F.lit(budget - history) - F.col("sys")) / 2), F.lit(1)))
    t = t.withColumn("own", F.floor(F.col("start") / F.col("stride")))
    again = F.col("start") >= (F.col("own") + 1) * F.col("stride") - history
    own = F.struct(F.col("own").alias("window"), F.lit(False).alias("repeated"))
    where = F.when(again, F.array(own, F.struct((F.col("own") + 1).alias("window"), F.lit(True).alias("repeated")))).otherwise(F.array(own))
    turns = t.where("NOT is_sys").select("conv_id", F.inline(where), "idx", "role", "text")
    # the system turn goes to windows that own a turn, and to the first of a conversation without any other
    owned = t.where("NOT is_sys").select(F.col("conv_id").alias("c"), F.col("own").alias("window")).distinct()
    system = t.where("is_sys").select("conv_id", "idx", "role", "text").join(owned, F.col("conv_id").eqNullSafe(F.col("c")), "left").withColumn("window", F.coalesce("window", F.lit(0).cast("long")))
    return turns.unionByName(system.select("conv_id", "window", (F.col("window") > 0).alias("repeated"), "idx", "role", "text"))


def windows(conv: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window, text, loss (array of start and length in code points of text), n_context
    (turns at its head that an earlier window has too)."""
    turn = F.struct("idx", "repeated", F.concat(F.lit("<s>"), F.url_encode("role"), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("answer"))
    w = spans(conv, budget, history).groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(turn)).alias("t"), F.min("repeated").alias("only_context"))
    w = w.where("NOT only_context")
    step = lambda s, x: F.struct((s["at"] + F.length(x["head"]) + F.length(x["body"]) + 4).cast("long").alias("at"), F.when(x["answer"] & ~x["repeated"], F.concat(s["loss"], F.array(F.struct((s["at"] + F.length(x["head"])).cast("long").alias("start"), F.length(x["body"]).cast("long").alias("length"))))).otherwise(s["loss"]).alias("loss"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("loss"))
    return w.select(
        "conv_id", "window",
        F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit("</s>"))), "").alias("text"),
        F.aggregate("t", zero, step, lambda s: s["loss"]).alias("loss"),
        F.size(F.filter("t", lambda x: x["repeated"])).alias("n_context"),
    )


def read_back(win: DataFrame) -> DataFrame:
    """Per window, from its text alone: the turns that are new in it as role, text; the text under the mask; its length."""
    pieces = F.slice(F.split("text", "</s>"), F.col("n_context") + 1, F.greatest(F.size(F.split("text", "</s>")) - 1 - F.col("n_context"), F.lit(0)))
    turns = F.transform(pieces, lambda p: F.struct(F.url_decode(p.substr(F.lit(4), F.locate("\n", p) - 4)).alias("role"), unescape(p.substr(F.locate("\n", p) + 1, F.length(p))).alias("text")))
    loss = F.array_join(F.transform("loss", lambda x: unescape(F.col("text").substr((x["start"] + 1).cast("int"), x["length"].cast("int")))), "")
    return win.select("conv_id", "window", turns.alias("turns"), loss.alias("loss_text"), F.length("text").cast("long").alias("n_chars"))


def with_probe(conv: DataFrame) -> DataFrame:
    """The conversations and conversation -1, whose texts are control strings."""
    said = F.lit("</s>[INST] ok [/INST]")
    probe = conv.sparkSession.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return conv.select("conv_id", "turn", "role", "text").unionByName(probe)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = read_back(windows(with_probe(table(spark, sf_dir, "conversations"))))
    part = F.struct("window", F.size("turns").alias("n"), F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"), F.col("loss_text").alias("loss"))
    whole = back.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("p"), F.sum("n_chars").alias("formatted_chars"), F.count("*").alias("n_windows"))
    loss = F.array_join(F.transform("p", lambda x: x["loss"]), "")
    return whole.select(
        "conv_id",
        F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("n_turns"),
        F.sha2(F.array_join(F.transform("p", lambda x: x["turns"]), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars", "n_windows",
    )


OP1_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 AS tokens,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS idx,
  length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|SYS>|INST\]))', '\1\\\2\3', 'g')) + length(url_encode(role)) + 8 AS n_chars FROM c),
s AS (SELECT *, max(CASE WHEN idx = 0 AND role = 'system' THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS sys,
  sum(tokens) OVER (PARTITION BY conv_id ORDER BY idx) - tokens AS before FROM t),
p AS (SELECT *, greatest((1024 - 128 - sys) // 2, 1) AS stride, CASE WHEN idx > 0 THEN before - sys ELSE before END AS start, idx = 0 AND sys > 0 AS is_sys FROM s),
o AS (SELECT *, start // stride AS own FROM p),
w AS (SELECT conv_id, own AS wn, n_chars FROM o WHERE NOT is_sys
  UNION ALL SELECT conv_id, own + 1, n_chars FROM o WHERE NOT is_sys AND start >= (own + 1) * stride - 128 AND EXISTS (SELECT 1 FROM o AS x WHERE x.conv_id = o.conv_id AND NOT x.is_sys AND x.own = o.own + 1)
  UNION ALL SELECT DISTINCT o.conv_id, x.own, o.n_chars FROM o JOIN o AS x ON x.conv_id = o.conv_id AND NOT x.is_sys WHERE o.is_sys
  UNION ALL SELECT conv_id, 0, n_chars FROM o WHERE is_sys AND NOT EXISTS (SELECT 1 FROM o AS x WHERE x.conv_id = o.conv_id AND NOT x.is_sys)),
f AS (SELECT conv_id, sum(n_chars)::BIGINT AS formatted_chars, count(DISTINCT wn) AS n_windows FROM w GROUP BY conv_id),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY idx) FILTER (WHERE role = 'assistant'), '') AS loss FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, n_windows FROM g JOIN f USING (conv_id)
"""
