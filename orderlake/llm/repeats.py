"""Removing every byte that a repeated 200-byte string covers, by suffix arrays of anchored contexts.

1. Every window of 200 bytes has an anchor (see ``anchors``); equal windows have theirs at the same place. A row for each
   anchor has the hashes of its string and of its context; rows are sorted by both.
   Of equal contexts in one task, one row goes on for all.
2. Anchors that stand alone are done. Where a whole context occurs twice, all its windows do. Contexts that occur once,
   and one of each repeated context, are left to compare where a string is anchor in several contexts.
3. Those contexts are read from the texts and dealt by their anchor's string. Aligned on their anchors and cut in blocks
   of ``STRIDE`` bytes, they make the symbols of a text, whose suffix array puts suffixes that share ``FULL`` blocks side
   by side; every repeated window holds so many. Among such neighbours, windows are put in order by their own hashes, and
   those side by side are repeated where they have ``WINDOW`` bytes in common.
   An anchor with very many contexts, as at the edges of a passage that many documents share, isn't left to one task: its
   windows are dealt by their two hashes instead, and those that are counted twice are repeated.
4. A document's spans are joined and its bytes outside them kept.

All hashes have 64 bits. Whole contexts, and windows of anchors with very many, are held equal on two of them,
independent of each other, other windows on their bytes.

Defined results: a null text counts as empty; texts under 200 bytes lose nothing; every row is a text of its own, also those
that repeat an id or have none (rows are told apart by a 64-bit hash of id and text, which repeated rows share); a cut inside a character leaves its other bytes,
as the contract is on bytes; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from orderlake.llm.anchors import LEFT, OTHER, WINDOW, anchors, spans, sums
from orderlake.llm.common import among, cut, table
from orderlake.llm.jaccard import utf8
from orderlake.llm.vocabulary import chunks
from orderlake.llm.shingles import BYTES, mix
from orderlake.llm.suffixes import suffix_array

STRIDE = 40
SPAN = LEFT + WINDOW
#: Blocks in a context, and those that lie in any window whole.
BLOCKS, FULL = SPAN // STRIDE, (WINDOW - STRIDE + 1) // STRIDE
#: Contexts of one suffix array, unless one anchor has more.
AT_ONCE = 4096
#: Contexts of an anchor beyond which its windows are dealt over tasks by their own hashes.
MANY = 16_384


def anchored(docs: DataFrame) -> DataFrame:
    """anchor, context, id, place, n. Of a context that a task finds more than once, one row stands for all (n is 2) and
    the others are done: they come out with n 0 and, dealt by their own place, burden nobody. So a context sends a row
    from each task at most, however common it is."""
    names = ["anchor", "context", "id", "place", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            gram, around, ids, place = (np.concatenate([h[k] for h in held]) for k in range(4)) if held else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            held.clear()
            order = np.lexsort((around, gram))
            gram, around, ids, place = gram[order], around[order], ids[order], place[order]
            again = np.zeros(len(gram), bool)
            again[1:] = (gram[1:] == gram[:-1]) & (around[1:] == around[:-1])
            n = np.ones(len(gram), np.int8)
            n[:-1][again[1:]] = 2
            n[again] = 0
            gram = np.where(again, mix(ids.view(np.uint64) * np.uint64(STRIDE) + place.view(np.uint64)), gram)
            return pa.record_batch([pa.array(gram.view(np.int64)), pa.array(around.view(np.int64)), pa.array(ids), pa.array(place.astype(np.int32)), pa.array(n)], names)

        for batch in batches:
            for part in chunks(batch, "t", 1_000_000):
                owner, place, gram, around = anchors(utf8(part.column("t")))
                held.append((gram, around, part.column("id").to_numpy()[owner], place))
            if sum(len(h[0]) for h in held) > 2_000_000:
                yield flush()
        yield flush()

    return docs.where("octet_length(t) >= 200").mapInArrow(run, "anchor long, context long, id long, place int, n tinyint")


def sorted_out(rows: DataFrame) -> DataFrame:
    """Of anchors with several rows: id, place, whole (its context occurs more than once), anchor (null if there is
    nothing to compare it with)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, ...] = ([], [], [], [])
        anchor = context = None
        pending = None  # the last row's id and place, while its context has no second
        several = False  # the anchor has several contexts
        single = None  # the anchor's first context's example, held until there is another one

        def put(row: tuple, whole: bool, key: int | None) -> None:
            for column, value in zip(out, (*row, whole, key), strict=True):
                column.append(value)

        def end_context() -> None:
            nonlocal single, pending
            if pending is not None:
                row, count = pending
                if several:
                    put(row, count > 1, anchor)
                else:
                    single = (row, count)
                pending = None

        for batch in batches:
            done = batch.column("n").to_numpy() == 0
            if done.any():
                some = batch.filter(pa.array(done))
                yield pa.record_batch([some.column("id"), some.column("place"), pa.array(np.ones(some.num_rows, bool)), pa.nulls(some.num_rows, pa.int64())], names)
                batch = batch.filter(pa.array(~done))
            k, c = batch.column("anchor").to_numpy(), batch.column("context").to_numpy()
            same = k[1:] == k[:-1]
            busy = np.zeros(len(k), bool)
            busy[1:] |= same
            busy[:-1] |= same
            busy |= batch.column("n").to_numpy() > 1
            busy[:1] = busy[-1:] = True  # runs may go on in the next batch
            at = np.flatnonzero(busy)
            picked = batch.take(pa.array(at))
            for kk, cc, row, n in zip(k[at].tolist(), c[at].tolist(), zip(picked.column("id").to_pylist(), picked.column("place").to_pylist(), strict=True), picked.column("n").to_pylist(), strict=True):
                if kk != anchor:
                    end_context()
                    if not several and single is not None and single[1] > 1:
                        put(single[0], True, None)
                    anchor, context, pending, several, single = kk, cc, (row, n), False, None
                elif cc != context:
                    end_context()
                    if not several:
                        several = True
                        put(single[0], single[1] > 1, anchor)
                        single = None
                    context, pending = cc, (row, n)
                else:
                    pending = (pending[0], pending[1] + n)
                    put(row, True, None)  # the first of its context is put at its end
            if len(out[0]) > 100_000:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names)
                for x in out:
                    x.clear()
        end_context()
        if not several and single is not None and single[1] > 1:
            put(single[0], True, None)
        yield pa.record_batch([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names)

    names, kinds = ["id", "place", "whole", "anchor"], [pa.int64(), pa.int32(), pa.bool_(), pa.int64()]
    return rows.repartition("anchor").sortWithinPartitions("anchor", "context", "id", "place").mapInArrow(run, "id long, place int, whole boolean, anchor long")


def contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """anchor, id, place, left (bytes before the anchor), bytes of the wanted rows."""
    lists = wanted.groupBy("id").agg(F.collect_list(F.struct("anchor", "place")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "t"):
                out: tuple[list, ...] = ([], [], [], [], [])
                for i, text, some in zip(part.column("id").to_pylist(), utf8(part.column("t")), part.column("wanted").to_pylist(), strict=True):
                    for x in some:
                        p = x["place"]
                        left = min(p, LEFT)
                        for column, value in zip(out, (x["anchor"], i, p, left, text[p - left : p + WINDOW]), strict=True):
                            column.append(value)
                yield pa.record_batch([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["anchor", "id", "place", "left", "bytes"])

    return docs.dropDuplicates(["id"]).join(lists, "id").mapInArrow(run, "anchor long, id long, place int, left int, bytes binary")


def laid_out(left: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts as rows of SPAN bytes, their anchors at LEFT, and where each begins and ends in its row."""
    rows = np.zeros((len(texts), SPAN), np.uint8)
    begin = LEFT - left
    end = begin + np.array([len(t) for t in texts], np.int64)
    column = np.arange(SPAN)
    rows[(column >= begin[:, None]) & (column < end[:, None])] = np.frombuffer(b"".join(texts), np.uint8)
    return rows, begin, end


def common(rows: np.ndarray, a: np.ndarray, b: np.ndarray, start: np.ndarray, at_once: int = 8192) -> np.ndarray:
    """Whether rows a and b have a window's bytes in common from a start on; bytes are compared once for each pair of rows."""
    pair, which = np.unique(a * len(rows) + b, return_inverse=True)
    order, out = np.argsort(which, kind="stable"), np.zeros(len(a), bool)
    ends = np.searchsorted(which[order], np.arange(0, len(pair) + at_once, at_once))
    for k, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        some = pair[k * at_once : (k + 1) * at_once]
        differ = np.zeros((len(some), SPAN + 1), np.int16)
        np.cumsum(rows[some // len(rows)] != rows[some % len(rows)], axis=1, out=differ[:, 1:])
        mine = order[lo:hi]
        r, s = which[mine] - k * at_once, start[mine]
        out[mine] = differ[r, s + WINDOW] == differ[r, s]
    return out


def repeated_windows(anchor: np.ndarray, left: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last start (from LEFT before the anchor) of the windows that another row of the same anchor has at
    the same place."""
    n, none = len(texts), np.zeros(0, np.int64)
    rows, begin, end = laid_out(left, texts)
    flat = rows.reshape(-1)
    one = sums(flat, BYTES)
    base = np.arange(n)[:, None] * SPAN
    cuts = base + np.arange(BLOCKS) * STRIDE
    symbol = spans(one, cuts.reshape(-1), cuts.reshape(-1) + STRIDE).reshape(n, BLOCKS)
    good = (np.arange(BLOCKS) * STRIDE >= begin[:, None]) & ((np.arange(BLOCKS) + 1) * STRIDE <= end[:, None])
    _, name = np.unique(symbol[good], return_inverse=True)
    text = np.zeros((n, BLOCKS + 1), np.int64)  # the last of each row is a symbol of its own, as are parts of blocks
    odd = np.ones((n, BLOCKS + 1), bool)
    odd[:, :BLOCKS] = ~good
    n_odd = int(odd.sum())
    text[odd] = np.arange(1, n_odd + 1)
    text[:, :BLOCKS][good] = name + n_odd + 1
    whole = np.append(text.reshape(-1), 0)
    order = np.array(suffix_array(whole.tolist()), np.int64)
    ahead = np.append(whole, np.full(FULL, -1))
    alike = np.ones(len(order) - 1, bool)
    for k in range(FULL):
        alike &= ahead[order[1:] + k] == ahead[order[:-1] + k]
    group = np.concatenate([[0], np.cumsum(~alike)])
    row, block = np.divmod(order, BLOCKS + 1)
    shared = np.bincount(group)[group] > 1
    row, block = row[shared], block[shared]
    if not len(row):
        return none, none, none
    starts = block[:, None] * STRIDE - np.arange(STRIDE)  # windows whose first whole block this is
    row = np.repeat(row, STRIDE)
    starts = starts.reshape(-1)
    fits = (starts >= begin[row]) & (starts + WINDOW <= end[row]) & (starts <= LEFT)
    row, starts = row[fits], starts[fits]
    at = row * SPAN + starts
    two = sums(flat, OTHER)
    h1, h2 = spans(one, at, at + WINDOW), spans(two, at, at + WINDOW)
    sort = np.lexsort((h2, h1, starts, anchor[row]))
    row, starts, h1, h2 = row[sort], starts[sort], h1[sort], h2[sort]
    equal = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1]) & (starts[1:] == starts[:-1]) & (anchor[row[1:]] == anchor[row[:-1]])
    near = np.flatnonzero(equal)
    equal[near] = common(rows, row[near], row[near + 1], starts[near])
    hit = np.zeros(len(row), bool)
    hit[1:] |= equal
    hit[:-1] |= equal
    row, starts = row[hit], starts[hit]
    if not len(row):
        return none, none, none
    found, at = np.unique(row, return_inverse=True)
    first, last = np.full(len(found), SPAN), np.full(len(found), -1)
    np.minimum.at(first, at, starts)
    np.maximum.at(last, at, starts)
    return found, first, last  # starts are less than a window apart, so what they cover has no gap


def compared(found: DataFrame) -> DataFrame:
    """id, lo, hi of what repeated windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            anchor, i, place, left, texts = zip(*held, strict=True) if held else ([], [], [], [], [])
            row, first, last = repeated_windows(np.array(anchor, np.int64), np.array(left, np.int64), list(texts)) if held else (np.zeros(0, np.int64),) * 3
            held.clear()
            lo = np.array(place, np.int64)[row] - LEFT + first
            return pa.record_batch([pa.array(np.array(i, np.int64)[row]), pa.array(lo), pa.array(lo + (last - first) + WINDOW)], ["id", "lo", "hi"])

        for batch in batches:
            for x in zip(*(batch.column(c).to_pylist() for c in ("anchor", "id", "place", "left", "bytes")), strict=True):
                if len(held) >= AT_ONCE and held[-1][0] != x[0]:
                    yield flush()
                held.append(x)
        yield flush()

    return found.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "id long, lo long, hi long")


def windows(found: DataFrame) -> DataFrame:
    """anchor, start, h1, h2, id, place: every window of contexts, with its two hashes and its place in the context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "bytes", 400_000):
                rows, begin, end = laid_out(part.column("left").to_numpy().astype(np.int64), part.column("bytes").to_pylist())
                starts = np.arange(LEFT + 1)
                row, start = np.nonzero((starts >= begin[:, None]) & (starts + WINDOW <= end[:, None]))
                flat, at = rows.reshape(-1), row * SPAN + start
                hashes = [spans(sums(flat, values), at, at + WINDOW).view(np.int64) for values in (BYTES, OTHER)]
                some = part.select(["anchor", "id", "place"]).take(pa.array(row))
                yield pa.record_batch([some.column("anchor"), pa.array(start.astype(np.int32)), *map(pa.array, hashes), some.column("id"), some.column("place")], ["anchor", "start", "h1", "h2", "id", "place"])

    return found.select("anchor", "id", "place", "left", "bytes").mapInArrow(run, "anchor long, start int, h1 long, h2 long, id long, place int")


def dealt(found: DataFrame) -> DataFrame:
    """As ``compared``, for anchors with very many contexts: windows are counted by their hashes, each task's own first, and
    those that are there twice come back to their contexts by a join that Spark can split."""
    each = windows(found)
    keys = ["anchor", "start", "h1", "h2"]
    twice = each.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    own = each.join(twice, keys, "left_semi").groupBy("id", "place").agg(F.min("start").alias("a"), F.max("start").alias("b"))
    lo = F.col("place").cast("long") - LEFT
    return own.select("id", (lo + F.col("a")).alias("lo"), (lo + F.col("b") + WINDOW).alias("hi"))


def joined(spans_: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """The union of spans, within 0 to n, as maximal runs."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans_):
        lo, hi = max(lo, 0), min(hi, n)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", many: int = MANY) -> DataFrame:
    """One row per input row: id, spans (array of lo, hi in bytes; maximal runs to remove), bytes (the whole text)."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.xxhash64(F.col(id_col), t).alias("id"), F.col(id_col).cast("long").alias("doc"), t.alias("t"))
    found = cut(sorted_out(anchored(docs.drop("doc"))))
    wholes = found.where("whole").select("id", (F.col("place") - LEFT).cast("long").alias("lo"), (F.col("place") + WINDOW).cast("long").alias("hi"))
    wanted, texts = found.where("anchor IS NOT NULL").select("anchor", "id", "place"), docs.drop("doc")
    often = cut(wanted.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > many).select("anchor"))
    if often.isEmpty():
        some = cut(compared(contexts(texts, wanted)))
    else:
        hot = cut(wanted.join(often, "anchor", "left_semi"))
        some = compared(contexts(texts, wanted.join(often, "anchor", "left_anti")))
        some = cut(some.unionByName(dealt(cut(contexts(among(texts, hot), hot)))))
    lists = wholes.unionByName(some).groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("found"))
    return docs.join(lists, "id", "left").select(F.col("doc").alias("id"), "t", "found")


def removed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", many: int = MANY) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes)."""
    rows = repeats(df, id_col, text_col, many)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "t"):
                out: tuple[list, ...] = ([], [], [], [], [])
                for text, found in zip(utf8(part.column("t")), part.column("found").to_pylist(), strict=True):
                    runs = joined([(x["lo"], x["hi"]) for x in found or []], len(text))
                    edges = [0, *[x for r in runs for x in r], len(text)]
                    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    for column, value in zip(out, (len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                        column.append(value)
                yield pa.record_batch([part.column("id"), *[pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = rows.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumnRenamed("id", id_col)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents")).drop("kept")
