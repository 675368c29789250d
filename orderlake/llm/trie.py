r"""Prefix trie of conversations by ROLLUP over positional columns of turn ids.

A turn's id is 128 bits of its role and text, with its number of words. A conversation lies in blocks of eight turns, one row
each, whose columns hold the turn ids by position; a block's row carries the node that the block before it ends with. One
ROLLUP over the eight columns makes all prefixes of all blocks, and ``grouping_id`` tells their depth: a long conversation
goes on in further blocks, which are rolled up in the same pass, as a node's key is the xor of position-bound hashes and
thus a running aggregate.

Each node belongs to its smallest member, and what a conversation owns is the end of its path. So sums over a subtree are
sums over members of what each owns, less what the owner has above, and a second ROLLUP, over owners alone, gives them
without a pass for each depth.

Turn numbers are ranked, and blocks summed up, in segments of 64 and their totals, so a long conversation is dealt over many tasks. Identifiers of
members that end at a node are joined in stretches of 512 and digested one stretch after another.

Defined results: null role or text counts as empty; null turns come first; turns with equal numbers go by their
ids; repeated rows are turns of their own; rows without conv_id belong to no conversation; an empty table gives no nodes;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from orderlake.llm.common import cut, table

#: Columns of a block; turn numbers, or blocks, of a segment; identifiers of a stretch.
WIDTH, SEGMENT, STRETCH = 8, 64, 512
WORD = r"[^\x20\x09-\x0D]+"
NODE = ["depth", "x", "y"]
COLUMNS = [f"t{j}" for j in range(1, WIDTH + 1)]


def ranked(conv: DataFrame) -> DataFrame:
    """conv_id, at (1 for the first turn), hi, lo, w (words), and n, the turns of the conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t = conv.where("conv_id IS NOT NULL").select("conv_id", F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("hi"), F.xxhash64(text, F.lit("turn"), role).alias("lo"), F.regexp_count(text, F.lit(WORD)).alias("w"))
    t = t.withColumn("seg", F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(-(2**62))))
    t = t.withColumn("rn", F.row_number().over(W.partitionBy("conv_id", "seg").orderBy(F.col("turn").asc_nulls_first(), "hi", "lo")))
    along = W.partitionBy("conv_id").orderBy("seg").rowsBetween(W.unboundedPreceding, -1)
    totals = t.groupBy("conv_id", "seg").agg(F.count("*").alias("k"))
    totals = totals.select(F.col("conv_id").alias("c"), F.col("seg").alias("s"), F.coalesce(F.sum("k").over(along), F.lit(0)).alias("before"), F.sum("k").over(W.partitionBy("conv_id")).alias("n"))
    return t.join(totals, (F.col("conv_id") == F.col("c")) & (F.col("seg") == F.col("s"))).select("conv_id", (F.col("before") + F.col("rn")).alias("at"), "hi", "lo", "w", "n")


def heads_shared(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt: c begins with the first h turns of conversation c - c % group, h = crc32(c) % most, and goes on
    with its own after its first h. Returns the turns (conv_id, at, hi, lo, w) and all conv_ids."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most))
    base = F.col("conv_id") - F.col("conv_id") % group
    first = turns.where((F.col("at") < most) & (F.col("conv_id") % group == 0))
    n_base = first.where("at = 1").select(F.col("conv_id").alias("base"), F.least("n", F.lit(most - 1)).alias("n_base"))
    convs = turns.where("at = 1").select("conv_id", h.alias("h"), base.alias("base")).join(n_base, "base", "left")
    convs = convs.select("conv_id", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken"))
    own = turns.withColumn("h", h).where("at > h")
    moved = convs.where("taken < h").select(F.col("conv_id").alias("c"), (F.col("h") - F.col("taken")).alias("less"))  # their base is short or absent
    own = own.join(moved, F.col("conv_id") == F.col("c"), "left").select("conv_id", (F.col("at") - F.coalesce("less", F.lit(0))).alias("at"), "hi", "lo", "w")
    head = convs.join(first.select(F.col("conv_id").alias("base"), "at", "hi", "lo", "w"), "base").where("at <= h").select("conv_id", "at", "hi", "lo", "w")
    return own.unionByName(head), convs.select("conv_id")


def part(position: Column, turn: str) -> tuple[Column, Column]:
    """What a turn at a position adds to the key of its node; nothing where there is none."""
    hi, lo = F.col(f"{turn}.hi"), F.col(f"{turn}.lo")
    here = lambda h: F.when(F.col(turn).isNull(), F.lit(0).cast("long")).otherwise(h)
    return here(F.xxhash64(position, hi, lo)), here(F.xxhash64(lo, position, hi))


def blocks(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each block of each conversation: conv_id, b, t1 to t8, kx and ky (the node it starts from), before (words
    up to there), total (words of all turns), n (turns of all blocks), ex and ey (the node where the conversation ends)."""
    at = (F.col("at") - 1).cast("long")
    t = turns.select("conv_id", F.floor(at / WIDTH).alias("b"), (at % WIDTH).alias("k"), F.struct("hi", "lo", F.col("w").cast("long").alias("w")).alias("t"))
    rows = t.groupBy("conv_id", "b").agg(*[F.max(F.when(F.col("k") == j, F.col("t"))).alias(c) for j, c in enumerate(COLUMNS)], F.count("*").alias("k"))
    rows = convs.select("conv_id").join(rows, "conv_id", "left").withColumn("b", F.coalesce("b", F.lit(0).cast("long")))
    sums = [F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long")]
    for j, c in enumerate(COLUMNS):
        x, y = part(F.col("b") * WIDTH + j + 1, c)
        sums = [sums[0].bitwiseXOR(x), sums[1].bitwiseXOR(y), sums[2] + F.coalesce(F.col(f"{c}.w"), F.lit(0))]
    rows = rows.withColumns({"px": sums[0], "py": sums[1], "pw": sums[2]})
    # running sums in two levels: within segments of blocks, and over the segments' totals
    rows = rows.withColumn("s", F.floor(F.col("b") / SEGMENT))
    sums = rows.groupBy(F.col("conv_id").alias("c"), "s").agg(F.bit_xor("px").alias("sx"), F.bit_xor("py").alias("sy"), F.sum("pw").alias("sw"), F.sum("k").alias("sk"))
    inside = W.partitionBy("conv_id", "s").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    along, whole = W.partitionBy("c").orderBy("s").rowsBetween(W.unboundedPreceding, -1), W.partitionBy("c")
    zero = F.lit(0).cast("long")
    before = lambda f, c, w: F.coalesce(f(c).over(w), zero)
    sums = sums.select(
        "c", F.col("s").alias("cs"), before(F.bit_xor, "sx", along).alias("bx"), before(F.bit_xor, "sy", along).alias("by"), before(F.sum, "sw", along).alias("bw"),
        F.bit_xor("sx").over(whole).alias("ex"), F.bit_xor("sy").over(whole).alias("ey"), F.sum("sw").over(whole).alias("total"), F.coalesce(F.sum("sk").over(whole), zero).alias("n"),
    )
    rows = rows.withColumns({"ix": before(F.bit_xor, "px", inside), "iy": before(F.bit_xor, "py", inside), "iw": before(F.sum, "pw", inside)})
    rows = rows.join(sums, (F.col("conv_id") == F.col("c")) & (F.col("s") == F.col("cs")))
    return rows.select("conv_id", "b", *COLUMNS, F.col("ix").bitwiseXOR(F.col("bx")).alias("kx"), F.col("iy").bitwiseXOR(F.col("by")).alias("ky"), (F.col("iw") + F.col("bw")).alias("before"), "total", "n", "ex", "ey")


def rolled(rows: DataFrame, sums: str) -> DataFrame:
    """All prefixes: depth, x, y, px and py (the parent), words (of the last turn), above (words of the turns before it), and
    the aggregates in ``sums``."""
    names = ", ".join(COLUMNS)
    groups = rows.sparkSession.sql(
        f"SELECT b, kx, ky, before, {WIDTH} - bit_count(grouping_id()) AS level, {names}, {sums} FROM {{rows}} GROUP BY b, kx, ky, before, ROLLUP({names})", rows=rows
    )
    last = F.get(F.array(*COLUMNS), F.col("level") - 1)
    groups = groups.withColumn("last", last).where("level = 0 AND b = 0 OR last IS NOT NULL")
    x, y, above = F.col("kx"), F.col("ky"), F.col("before")
    for j, c in enumerate(COLUMNS):
        px, py = part(F.col("b") * WIDTH + j + 1, c)
        x, y, above = x.bitwiseXOR(px), y.bitwiseXOR(py), above + F.coalesce(F.col(f"{c}.w"), F.lit(0))
    depth, words = F.col("b") * WIDTH + F.col("level"), F.coalesce("last.w", F.lit(0).cast("long"))
    px, py = part(depth, "last")
    rest = [c for c in groups.columns if c not in ("b", "kx", "ky", "before", "level", "last", *COLUMNS)]
    return groups.select(depth.alias("depth"), x.alias("x"), y.alias("y"), x.bitwiseXOR(px).alias("px"), y.bitwiseXOR(py).alias("py"), words.alias("words"), (above - words).alias("above"), *rest)


def ends(rows: DataFrame) -> DataFrame:
    """Of each node where conversations end: depth, x, y, ends_sha256 of their identifiers, ascending, joined by commas."""
    e = rows.where("b = 0").select(F.col("n").alias("depth"), F.col("ex").alias("x"), F.col("ey").alias("y"), "conv_id", F.floor(F.col("conv_id") / STRETCH).alias("stretch"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    e = e.groupBy(*NODE, "stretch").agg(ids.alias("ids")).repartition(*NODE).sortWithinPartitions(*NODE, "stretch")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, None
        done = lambda: pa.record_batch([pa.array([v], pa.int64()) for v in at] + [pa.array([sha.hexdigest()])], [*NODE, "ends_sha256"])
        for batch in batches:
            made = []
            for *node, ids in zip(*[batch.column(c).to_pylist() for c in (*NODE, "ids")], strict=True):
                if node != at:
                    if at is not None:
                        made.append(done())
                    at, sha = node, hashlib.sha256(ids.encode())
                else:
                    sha.update(f",{ids}".encode())
            if made:
                yield pa.Table.from_batches(made).combine_chunks().to_batches()[0]
        if at is not None:
            yield done()

    return e.select(*NODE, "ids").mapInArrow(digest, "depth long, x long, y long, ends_sha256 string")


def nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie of conversations (turns: conv_id, at, hi, lo, w; convs: all conv_ids), one row for each node."""
    rows = cut(blocks(turns, convs))
    found = cut(rolled(rows, "min(conv_id) AS conv_id, count(*) AS n_convs, sum(total) AS total"))
    owners = found.groupBy("conv_id").agg(F.min(F.struct("depth", "px", "py", "above")).alias("top"), F.max("depth").alias("last"), F.sum("words").alias("owned"))
    owners = cut(owners.select("conv_id", "last", "owned", F.col("top.depth").alias("from"), F.col("top.above").alias("from_above"), "top.px", "top.py"))
    # a child is its parent's owner's, or the top of another one's path
    parent = (F.col("from") - 1 == F.col("depth")) & (F.col("o.px") == F.col("x")) & (F.col("o.py") == F.col("y"))
    tops = owners.alias("o").where("from > 0").select((F.col("from") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y"))
    side = tops.groupBy(*NODE).agg(F.count("*").alias("n_side"))
    above = owners.alias("o").where("from > 0").join(found.select(*NODE, F.col("conv_id").alias("top_parent")), parent).select("o.conv_id", "top_parent")
    owners = owners.drop("px", "py").join(above, "conv_id", "left")
    told = cut(found.drop("px", "py").join(side, NODE, "left").join(owners, "conv_id").withColumn("n_children", F.coalesce("n_side", F.lit(0)) + (F.col("depth") < F.col("last")).cast("long")))
    paths = told.where("depth = last").select("conv_id", "owned", (F.col("n_children") == 0).cast("long").alias("leaf"))
    below = rolled(rows.drop("total").join(paths, "conv_id"), "sum(owned) AS below, sum(leaf) AS n_leaves").select(*NODE, "below", "n_leaves")
    out = told.join(below, NODE).join(ends(rows), NODE, "left")
    spared = F.col("total") - F.col("n_convs") * F.col("above") - (F.col("below") - (F.col("above") - F.col("from_above")))
    parent_conv = F.when(F.col("depth") > F.col("from"), F.col("conv_id")).otherwise(F.col("top_parent"))
    return out.select("conv_id", "depth", parent_conv.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", spared.alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "words")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = cut(ranked(table(spark, sf_dir, "conversations")))
    return nodes(*heads_shared(turns))


OP11_SQL = r"""
WITH RECURSIVE c AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM conversations WHERE conv_id IS NOT NULL),
bits AS (SELECT conv_id, conv_id::VARCHAR AS s, 1 AS k, xor(4294967295::BIGINT, ascii(conv_id::VARCHAR)::BIGINT) AS v, 0 AS bit FROM (SELECT DISTINCT conv_id FROM c)
  UNION ALL SELECT conv_id, s, CASE WHEN bit = 7 THEN k + 1 ELSE k END,
    xor(xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END), CASE WHEN bit = 7 AND k < length(s) THEN ascii(s[k + 1])::BIGINT ELSE 0 END), (bit + 1) % 8 FROM bits WHERE k <= length(s)),
h AS (SELECT conv_id, xor(v, 4294967295::BIGINT) % 4 AS h FROM bits WHERE k > length(s)),
taken AS (SELECT h.conv_id, h.h, b.role, b.text, b.i FROM h JOIN c AS b ON b.conv_id = h.conv_id - h.conv_id % 20 AND b.i <= h.h),
r AS (SELECT conv_id, role, text, i FROM taken
  UNION ALL SELECT c.conv_id, c.role, c.text, c.i - h.h + (SELECT count(*) FROM taken t WHERE t.conv_id = c.conv_id) FROM c JOIN h USING (conv_id) WHERE c.i > h.h),
p AS (SELECT conv_id, i, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w, sha256(string_agg(sha256(role) || sha256(text), '' ORDER BY i) OVER (PARTITION BY conv_id ORDER BY i)) AS node,
    sum(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) OVER (PARTITION BY conv_id) AS total FROM (SELECT conv_id, role, text, i FROM r)
  UNION ALL SELECT conv_id, 0, 0, '', 0 FROM h),
q AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY i) AS up, max(i) OVER (PARTITION BY conv_id) = i AS ends FROM p),
n AS (SELECT node, i AS depth, any_value(up) AS up, any_value(w) AS w, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM q GROUP BY node, i),
k AS (SELECT up AS node, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
v AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k USING (node)),
pair AS (SELECT DISTINCT a.node AS top, d.node FROM q AS a JOIN q AS d ON a.conv_id = d.conv_id AND a.i <= d.i),
t AS (SELECT pair.top AS node, count(*) FILTER (v.n_children = 0) AS n_leaves, sum((v.n_convs - 1) * v.w) AS saved_tokens FROM pair JOIN v USING (node) GROUP BY pair.top)
SELECT v.conv_id, v.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, t.n_leaves, t.saved_tokens::BIGINT AS saved_tokens, v.ends_sha256, v.w::BIGINT AS words
FROM v JOIN t USING (node) LEFT JOIN v AS u ON u.node = v.up
"""
