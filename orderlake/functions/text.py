r"""Cleaning of review texts, as column expressions only.

Java's ``\s`` and ``\w`` are ASCII unless the pattern says ``(?U)``.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Unicode's characters that are an emoji alone; what counts as an emoji (those, with modifiers and joined; flags, keycaps),
#: an emoticon, and an emphasis or quote mark.
PICTURES = """
A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA 24C2 25AA-25AB 25B6 25C0 25FB-25FE 2600-2604 260E 2611 2614-2615
2618 261D 2620 2622-2623 2626 262A 262E-262F 2638-263A 2640 2642 2648-2653 265F-2660 2663 2665-2666 2668 267B 267E-267F 2692-2697 2699 269B-269C
26A0-26A1 26A7 26AA-26AB 26B0-26B1 26BD-26BE 26C4-26C5 26C8 26CE-26CF 26D1 26D3-26D4 26E9-26EA 26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F 2712
2714 2716 271D 2721 2728 2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2764 2795-2797 27A1 27B0 27BF 2934-2935 2B05-2B07 2B1B-2B1C 2B50 2B55 3030
303D 3297 3299 1F004 1F0CF 1F170-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F201-1F202 1F21A 1F22F 1F232-1F23A 1F250-1F251 1F300-1F321 1F324-1F393
1F396-1F397 1F399-1F39B 1F39E-1F3F0 1F3F3-1F3F5 1F3F7-1F4FD 1F4FF-1F53D 1F549-1F54E 1F550-1F567 1F56F-1F570 1F573-1F57A 1F587 1F58A-1F58D 1F590
1F595-1F596 1F5A4-1F5A5 1F5A8 1F5B1-1F5B2 1F5BC 1F5C2-1F5C4 1F5D1-1F5D3 1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3 1F5FA-1F64F 1F680-1F6C5 1F6CB-1F6D2
1F6D5-1F6D9 1F6DC-1F6E5 1F6E9 1F6EB-1F6EC 1F6F0 1F6F3-1F6FC 1F7E0-1F7EB 1F7F0 1F90C-1F93A 1F93C-1F945 1F947-1F9FF 1FA70-1FA7C 1FA80-1FAC6 1FAC8
1FACC-1FADD 1FADF-1FAEB 1FAEF-1FAFA
"""
ONE = "[" + "".join(re.sub("[0-9A-F]+", r"\\x{\g<0>}", PICTURES).split()) + r"][\x{FE0F}\x{1F3FB}-\x{1F3FF}\x{E0020}-\x{E007F}]*"
EMOJI = rf"[0-9#*]\x{{FE0F}}?\x{{20E3}}|(?=[\xA9-\x{{1FAFF}}])(?:{ONE}(?:\x{{200D}}{ONE})*|[\x{{1F1E6}}-\x{{1F1FF}}]{{2}})"
EMOTICON = r":\)|;\)|:-\)|:\(|:\\|(?<!http):/|\^_+\^|\*__*\*"
MARKS = "[`´\"“”‘’'*^]"


def lowered(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[\r\n]", " ")


def without_lone_quote(c: Column) -> Column:
    bare = F.replace(c, F.lit("'"), F.lit(""))
    return F.when(F.length(c) - F.length(bare) == 1, bare).otherwise(c)


#: Step -> function, in order.
STEPS = {
    "lower": lowered,
    "emoji": lambda c: F.regexp_replace(c, EMOJI, "."),
    "emoticon": lambda c: F.regexp_replace(c, EMOTICON, "."),
    "emphasis": lambda c: F.regexp_replace(c, MARKS, "'"),
    "empty_quotes": lambda c: F.regexp_replace(c, r"(?U)'\s*'", ""),
    "lone_quote": without_lone_quote,
    "repeated_special": lambda c: F.regexp_replace(c, r"(?U)(/(?<=https?:/)/+)|([^\w\s])\2+", "$1$2"),
    "exclamation": lambda c: F.replace(c, F.lit("!"), F.lit(".")),
    "space_before": lambda c: F.regexp_replace(c, r"(?U)\s+([!?.,])", "$1"),
    "repeated_char": lambda c: F.regexp_replace(c, r"(.)\1{2,}", "$1"),
    "spaces": lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " ")),
    "trailing": lambda c: F.regexp_replace(c, "[.,+]+$", ""),
    "short": lambda c: F.when(F.length(c) <= 2, "").otherwise(c),
    "inside_quotes": lambda c: F.regexp_replace(c, r"(?Us)'\s*(.*?)\s*'", "'$1'"),
    "ends": F.trim,
}
#: The steps that every SQL engine can do.
BASIC = ["lower", "emphasis", "exclamation", "space_before", "spaces", "trailing"]


def clean(c: Column, steps: list[str] | None = None) -> Column:
    return reduce(lambda x, name: STEPS[name](x), steps or list(STEPS), c)


def clean_rows(df: DataFrame, column: str, steps: list[str] | None = None) -> DataFrame:
    """The rows with their text cleaned, without those of which nothing is left. Each step is a projection of its own, so
    that steps that use their input twice don't multiply. A condition on the text would be moved before the steps and do them all
    again, with those multiplied; a generator stays where it is."""
    for name in steps or list(STEPS):
        df = df.withColumn(column, STEPS[name](F.col(column)))
    return df.withColumn(column, F.explode(F.filter(F.array(column), lambda t: t != "")))


def corrected(df: DataFrame, fixes: DataFrame, keys: list[str], column: str, most: int = 10_000) -> DataFrame:
    """With hand-made corrections (keys and ``fixed``) put in; blanks go then. Corrections are broadcast while they are few."""
    few = fixes.limit(most + 1).count() <= most
    joined = df.join(F.broadcast(fixes) if few else fixes, keys, "left").withColumn(column, F.coalesce("fixed", column)).drop("fixed")
    return joined.where(F.trim(column) != "")


def fixes(spark: SparkSession, path: str) -> DataFrame | None:
    """Hand-made corrections of a JSON file: of each column, the reviews' texts by their ids. None where there is no such file."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    columns = F.explode(F.from_json("value", "map<string, map<string, string>>")).alias("message_type", "texts")
    rows = spark.read.text(path, wholetext=True).select(columns).select(F.regexp_replace("message_type", "^review_comment_", "").alias("message_type"), F.explode("texts").alias("review_id", "fixed"))
    return rows.select("review_id", "message_type", "fixed")


def melt(review: DataFrame) -> DataFrame:
    """review_id, message_type, text: titles and messages in long form."""
    rows = review.select("review_id", F.col("review_comment_title").alias("title"), F.col("review_comment_message").alias("message"))
    return rows.unpivot(["review_id"], ["title", "message"], "message_type", "text").where("text IS NOT NULL")


def preprocess(review: DataFrame, fixes: DataFrame | None = None) -> DataFrame:
    """Melted, cleaned, corrected reviews, each once."""
    rows = clean_rows(melt(review), "text")
    if fixes is not None:
        rows = corrected(rows, fixes, ["review_id", "message_type"], "text")
    return rows.dropDuplicates()


def texts(rows: DataFrame, column: str = "text") -> DataFrame:
    """The texts alone, each once, the longest first."""
    return rows.select(column).distinct().orderBy(F.desc(F.length(column)), column)


def keywords(df: DataFrame, column: str, stop_words: list[str], top: int = 20) -> DataFrame:
    """The most frequent words of a-z, of three letters or more, but the stop words."""
    words = F.split(F.regexp_replace(F.lower(column), "[^a-z\\s]", ""), "\\s+")
    rows = df.select(F.explode(words).alias("word")).where((F.length("word") > 2) & ~F.col("word").isin(stop_words))
    return rows.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(top)
