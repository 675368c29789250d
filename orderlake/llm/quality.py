"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps the measurements and one failure bit for each rule;
a policy is a named, versioned mask over those bits, so that policies are applied, compared and ablated later by
bitwise operations on the ledger alone, without the text.

Defined results: a null text counts as a text without words; repeated rows are judged alike, each on its own; further
columns of the input are ignored by ``ledger`` and kept by ``reject``; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orderlake.llm.common import WHITE, table

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Rule -> its bit. Bits are part of the stored ledger: new rules get new bits, old ones keep theirs.
RULES: dict[str, int] = {"few_words": 1, "repeated_words": 2, "symbols": 4, "duplicate_lines": 8, "word_length": 16}
BASE = RULES["few_words"] | RULES["repeated_words"]
#: Policy version -> the bits that reject.
POLICIES: dict[str, int] = {"base-1": BASE, "web-1": BASE | RULES["symbols"], "web-2": sum(RULES.values())}


def repeated_words(w: Column, n: Column) -> Column:
    """Words in those 3-word windows that occur twice or more. Windows are sorted together with their places; equal
    neighbours give the repeated places, and places less than three apart share words."""
    places = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    windows = F.arrays_zip(w.alias("a"), F.slice(w, F.lit(2), n).alias("b"), F.slice(w, F.lit(3), n).alias("c"), places.alias("p"))
    windows = F.sort_array(F.slice(windows, F.lit(1), F.greatest(n - 2, F.lit(0))))
    let = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  binds a value once
    pairs = let(windows, lambda s: F.zip_with(s, F.slice(s, F.lit(2), F.greatest(F.size(s), F.lit(1))), lambda x, y: F.when((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.array(x["p"], y["p"]))))
    found = F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))
    count = let(found, lambda p: F.aggregate(F.zip_with(p, F.slice(p, F.lit(2), F.greatest(F.size(p), F.lit(1))), lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3)))), F.lit(0), lambda s, x: s + x))
    return F.when(n >= 4, count).otherwise(0).cast("long")


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    df = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    df = df.select(id_col, "t", F.array_remove(F.split("t", WHITE), "").alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    df = df.withColumn("n", F.size("w"))
    return df.select(
        id_col,
        F.col("n").cast("long").alias("n_words"),
        F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w"), F.col("n")).alias("n_repeat_words"),
    )


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements and ``fail_bits``, the sum of the bits of the rules that the document fails. Rules are integer
    comparisons, so that they come out alike everywhere."""
    m = measures(df, id_col, text_col)
    n = F.col("n_words")
    fails = {
        "few_words": n < MIN_WORDS,
        "repeated_words": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "duplicate_lines": 100 * F.col("n_dup_lines") > 50 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
    }
    bits = [F.when(fails[name], F.lit(bit)).otherwise(F.lit(0)) for name, bit in RULES.items()]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return m.withColumn("fail_bits", total.cast("long"))


def passes(policy: str, bits: Column | str = "fail_bits", policies: Mapping[str, int] = POLICIES) -> Column:
    bits = F.col(bits) if isinstance(bits, str) else bits
    return bits.bitwiseAND(F.lit(policies[policy])) == 0


def ablations(led: DataFrame, policy: str, policies: Mapping[str, int] = POLICIES, rules: Mapping[str, int] = RULES) -> DataFrame:
    """For each rule of the policy: documents that fail it, and documents that the policy would keep without it. One
    pass over the ledger; a row per rule."""
    mask = policies[policy]
    used = [(name, bit) for name, bit in rules.items() if bit & mask]
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask))
    sums = led.agg(F.count("*").alias("n"), *[F.sum((failed.bitwiseAND(F.lit(bit)) != 0).cast("long")).alias(f"f{bit}") for _, bit in used], *[F.sum((failed == bit).cast("long")).alias(f"o{bit}") for _, bit in used])
    each = F.array(*[F.struct(F.lit(policy).alias("policy"), F.lit(name).alias("rule"), F.coalesce(F.col(f"f{bit}"), F.lit(0)).alias("n_failed"), F.coalesce(F.col(f"o{bit}"), F.lit(0)).alias("n_regained")) for name, bit in used])
    return sums.select(F.inline(each))


def reject(df: DataFrame, policy: str = "web-2", text_col: str = "text") -> DataFrame:
    """The rows that the policy keeps, with their columns as they came. Rows are judged where they stand: no shuffle,
    and repeated or null ids don't matter."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    led = ledger(df.select(whole.alias("row"), F.col(text_col).alias("text")), "row", "text")
    return led.where(passes(policy)).select("row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    base_failed = F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0
    return ledger(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fail_bits", base_failed.alias("base_failed"), (~base_failed & passes("web-2")).alias("kept"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS p FROM d),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
win AS (SELECT *, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
rep AS (SELECT doc_id, p, CASE WHEN c IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w, b, c) >= 2 THEN 1 ELSE 0 END AS f FROM win),
cov AS (SELECT doc_id, greatest(f, coalesce(lag(f, 1) OVER o, 0), coalesce(lag(f, 2) OVER o, 0)) AS f FROM rep WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
reps AS (SELECT doc_id, sum(f)::BIGINT AS n_rep FROM cov GROUP BY doc_id),
m AS (SELECT doc_id, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS n_words,
  length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_rep, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN reps USING (doc_id)),
b AS (SELECT *, ((n_words < 50)::INT * 1 + (100 * n_repeat_words > 50 * n_words)::INT * 2 + (10 * n_symbols > n_words)::INT * 4
  + (100 * n_dup_lines > 50 * n_lines)::INT * 8 + (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT * 16)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept FROM b
"""


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy costs: documents that fail it, and documents that would stay without it."""
    return ablations(ledger(table(spark, sf_dir, "documents")), "web-2")


ABLATIONS_SQL = OP10_SQL[: OP10_SQL.rindex("SELECT doc_id, n_words")] + """SELECT 'web-2' AS policy, rule, count(*) FILTER (fail_bits & bit <> 0) AS n_failed, count(*) FILTER (fail_bits = bit) AS n_regained
FROM b, (VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('duplicate_lines', 8), ('word_length', 16)) AS r(rule, bit) GROUP BY rule
"""
