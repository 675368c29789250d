r"""Benchmark decontamination by winnowing.

Words are hashed, runs of five hashed words give k-gram hashes, and of each six neighbouring k-grams, a window of ten words, the
smallest hash is kept: the window's fingerprint. Equal windows have equal fingerprints on both sides, so every shared run of
ten words is found, though only two in seven k-grams are sent. A corpus fingerprint passes a bitmap of the benchmark's, is
joined with them, and is then extended: the words around it make the windows it stands for, which are compared with the
benchmark's word by word, as strings.

An item of fewer than ten words is one window, found by the hash of all its words; the corpus makes hashes of such lengths
only where the benchmark has them.

Documents are read once: what goes on is a row for each document and one for each hit. Fingerprints and windows of the
benchmark are distinct, so a passage that stands in many items is met once in a document; the items of a set of windows are
put together once for all documents that have this set.

Defined results: null and empty texts have no words and no windows; repeated rows of documents are documents of their own, also
with a null doc_id; repeated items count once by item_id, a null item_id as the empty string; an empty benchmark contaminates
nothing, an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orderlake.llm.common import ascii_lower, cut, marked, table

#: Words of a k-gram, k-grams of a window, words of a window.
GRAM, GRAMS = 5, 6
WINDOW = GRAM + GRAMS - 1
#: All but letters, digits and characters beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The low bits of a k-gram hash tell its place, so that the least of a window does.
PLACES = 8


def with_words(df: DataFrame, text_col: str = "text") -> DataFrame:
    """With ``w``, the words, and ``h``, their hashes."""
    w = F.array_remove(F.split(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), BETWEEN), "")
    return df.withColumn("w", w).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))


def starts(n: Column, length: int) -> Column:
    """Where runs of so many of n words begin, from 0."""
    return F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))


def run_hash(i: Column, length: int) -> Column:
    """Of the run of hashed words that begins at i, without its low bits."""
    return F.xxhash64(F.lit(length), *[F.get("h", i + j) for j in range(length)]).bitwiseAND(F.lit(-PLACES))


def with_minima(df: DataFrame) -> DataFrame:
    """With ``m``, the least k-gram hash of each window of ten words; its low bits are the k-gram's place modulo 8."""
    grams = F.transform(starts(F.size("h"), GRAM), lambda i: run_hash(i, GRAM).bitwiseOR(i.cast("long").bitwiseAND(F.lit(PLACES - 1))))
    least = F.transform(starts(F.size("g"), GRAMS), lambda i: F.least(*[F.get("g", i + j) for j in range(GRAMS)]))
    return df.withColumn("g", grams).withColumn("m", least).drop("g")


def windows(bench: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The benchmark's windows: item, text (words with single spaces), n (words), f (fingerprint)."""
    rows = with_minima(with_words(bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text")))).drop("text")
    text = F.array_join(F.slice("w", F.col("at") + 1, WINDOW), " ")
    # outer: for an inner explode Spark infers a filter on the array's size, and by pushing it down makes the arrays anew for each element
    long = rows.select("item", "w", F.posexplode_outer("m").alias("at", "f")).where("f IS NOT NULL").select("item", text.alias("text"), F.lit(WINDOW).alias("n"), F.col("f").bitwiseAND(F.lit(-PLACES)).alias("f"))
    n = F.size("w")
    whole = F.coalesce(*[F.when(n == k, run_hash(F.lit(0), k)) for k in range(1, WINDOW)])
    short = rows.where((n > 0) & (n < WINDOW)).select("item", F.array_join("w", " ").alias("text"), n.alias("n"), whole.alias("f"))
    return long.unionByName(short).distinct()


def hits(docs: DataFrame, prints: DataFrame, lengths: list[int], id_col: str, text_col: str) -> DataFrame:
    """Of each row of docs one row with ``at`` null, and one for each of its fingerprints that ``prints`` (f) may have: doc, id,
    n_words, f, at (its word), n (words of its windows), begin and around (the words from there on that its windows may have)."""
    rows = with_words(docs.select(F.monotonically_increasing_id().alias("doc"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text").drop("text").withColumn("n_words", F.size("w"))
    rows = with_minima(rows)
    row, n = F.array(F.lit(None).cast("long")), F.col("n_words")
    runs = lambda k: F.transform(starts(n, k), lambda i: run_hash(i, k))
    short = [runs(k) for k in lengths]
    rows = rows.select("doc", "id", "n_words", "w", F.concat(row, "m", *short).alias("m"))
    each = rows.select("*", F.posexplode_outer("m").alias("pos", "v"))
    # the first place is the row's own, then come windows of ten words, then each short length
    size = lambda k: F.greatest(n - k + 1, F.lit(0))
    end, begin = F.lit(1) + size(WINDOW), F.lit(1)
    kind, base = F.when(F.col("pos") < end, WINDOW), F.when(F.col("pos") < end, begin)
    for k in lengths:
        begin, end = end, end + size(k)
        kind, base = kind.when(F.col("pos") < end, k), base.when(F.col("pos") < end, begin)
    again = (F.col("pos") < F.lit(1) + size(WINDOW)) & F.col("v").eqNullSafe(F.get("m", F.col("pos") - 1))
    each = each.where((F.col("pos") == 0) | ~again)
    each = each.select("doc", "id", "n_words", "w", "pos", "v", F.col("v").bitwiseAND(F.lit(-PLACES)).alias("f"), kind.alias("n"), (F.col("pos") - base).alias("s"))
    told = marked(each, prints, "f", "left").where("pos = 0 OR __hit")
    at = F.when(F.col("pos") > 0, F.when(F.col("n") == WINDOW, F.col("s") + F.pmod(F.col("v").bitwiseAND(F.lit(PLACES - 1)) - F.col("s"), F.lit(PLACES))).otherwise(F.col("s"))).cast("int")
    first = F.when(F.col("n") == WINDOW, F.greatest(F.col("at") - (GRAMS - 1), F.lit(0))).otherwise(F.col("at"))
    told = told.select("doc", "id", "n_words", "w", "f", "n", at.alias("at"))
    around = F.when(F.col("at").isNotNull(), F.slice("w", first + 1, F.lit(2 * WINDOW - GRAM)))
    return told.select("doc", "id", "n_words", "f", "n", "at", first.alias("begin"), around.alias("around"))


def covered(spans: Column) -> Column:
    """Words under any of the spans, an array of structs s (first word) and n, in order."""
    step = lambda a, x: F.struct(F.greatest(a["end"], x["s"] + x["n"]).alias("end"), (a["sum"] + F.greatest(x["s"] + x["n"] - F.greatest(a["end"], x["s"]), F.lit(0))).alias("sum"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))
    return F.aggregate(spans, zero, step, lambda a: a["sum"].cast("long"))


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = cut(windows(bench, item_col, item_text_col))
    distinct = cut(found.groupBy("text", "n", "f").agg(F.count("*").alias("n_items")).select("text", "n", "f", F.monotonically_increasing_id().alias("window")))
    prints = distinct.select("f", "n").distinct()
    lengths = sorted(r["n"] for r in distinct.where(F.col("n") < WINDOW).select("n").distinct().collect())  # nine at most
    rows = cut(hits(docs, prints, lengths, id_col, text_col))
    real = rows.where("at IS NOT NULL").join(prints, ["f", "n"], "left_semi")
    place = F.when(F.col("n") == WINDOW, F.sequence(F.col("begin"), F.least(F.col("at"), F.col("n_words") - WINDOW))).otherwise(F.array("at"))
    tried = real.select("doc", "n", "begin", "around", F.explode(place).alias("s")).select("doc", "n", "s", F.array_join(F.slice("around", F.col("s") - F.col("begin") + 1, F.col("n")), " ").alias("text"))
    met = tried.join(distinct.select("text", "n", "window"), ["text", "n"])
    per = cut(met.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("s", "n"))).alias("spans"), F.sort_array(F.collect_set("window")).alias("found")).select("doc", covered(F.col("spans")).alias("n_hit"), "found"))
    items = found.join(distinct.drop("f"), ["text", "n"]).select("window", "item")
    sets = per.select("found").distinct()
    listed = sets.select("found", F.explode("found").alias("window")).join(items, "window").groupBy("found").agg(F.sort_array(F.collect_set("item")).alias("items"))
    listed = listed.select("found", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    per = per.join(listed, "found").drop("found")
    out = rows.where("at IS NULL").select("doc", F.col("id").alias("__id"), "n_words").join(per, "doc", "left")
    zero = F.lit(0).cast("long")
    return out.select(F.col("__id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS MATERIALIZED (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
b AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS text FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
x AS (SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS text FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM b) WHERE len(w) >= n)),
m AS MATERIALIZED (SELECT r, s, n, item FROM x JOIN b USING (n, text)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM m)) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
