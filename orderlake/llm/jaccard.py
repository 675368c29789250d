"""Joining documents by the Jaccard similarity of their shingle sets, exactly.

1. One pass over the texts gives every set's size, digest and bitmap signature, and counts shingles in a table of fixed
   size by their hash. Equal sets are one class, for which the smallest identifier stands.
2. Shingles are ordered by their slot's count, then by hash: rare ones first. In any order that all sets keep, two sets that
   link share a shingle among the first ``size - ceil(t * size) + 1`` of each, and at the first one that they share,
   neither has fewer shingles left than the overlap they need. These entries (shingle, size, shingles left, id), sorted,
   form tiles: rows of one shingle in ascending size, from which sets without a partner of fitting size and place
   are taken out. The entries of a shingle of very many sets are dealt to several tasks.
3. In each tile a set meets the first before it that it may link with. Of the pairs that meet, bitmaps tell which can link:
   a bit that is set in one and not in the other is a shingle that isn't shared, so bit counts bound the overlap from
   above. Bitmaps have a power of two of bits that follows the size, and are folded to the smaller of two. Each set
   is compared with the likeliest it meets, and what links is contracted. So a group of thousands of near copies costs
   a comparison for each of them.
4. Then pairs that are still in different components are compared: those that met, and within the tiles that hold several
   components, those that size, place and bitmaps let link. A tile sends spanning forests of its components, and comes again in
   the next round only if it had more pairs than its forests took. A tile of many sets is cut by size, then by hash, into
   cells of bounded number; pairs of cells are tiles of their own, but not those within the component that most of its
   sets are in. What a tile sends is in proportion to its sets, not their pairs.
5. A comparison intersects the sorted arrays of two sets.

Defined results: null, empty and blank texts have an empty set, which links with nothing; identifiers name one text, and
repeated rows with the same id are one document; rows with a null id come out with component null and link with
nothing; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from orderlake.llm.common import among, cut, forget, table, without
from orderlake.llm.graph import components
from orderlake.llm.vocabulary import chunks, tidy
from orderlake.llm.shingles import sets

#: The table of counts has 2**SLOT_BITS slots, in blocks that tasks add up apart.
SLOT_BITS, BLOCK_BITS = 20, 16
#: Entries of a shingle that go to one task, about; slots near the mean are not looked at.
SPLIT = 50_000
#: Members of a run that a task holds before it sends them on.
LONG_RUN = 100_000
#: Members of a run up to which each pair's places are looked at.
CLOSE_LOOK = 64
#: Sets that a member is held against before it becomes one that others meet.
FIRSTS = 4
#: Pairs of one set that a task compares at most.
PAIRS_AT_ONCE = 1000
#: Forests of the first round; each round takes so many times as many as the one before.
FORESTS, FOREST_GROWTH = 2, 8
PAIRS_IN_MEMORY = 250_000
#: Members of a run, above which it is cut into cells of about so many, and pairs of cells go to tasks.
CELL = 2000
#: Ids that a set didn't link with, beyond which they go to the tiles as rows, not in a list.
LISTED = 100
#: Bytes of text whose sets are made at once.
TEXT_AT_ONCE = 500_000


def prefix_size(n: int, num: int, den: int) -> int:
    return n - -(-n * num // den) + 1


def needed(total, num: int, den: int):
    """The overlap that two sets with ``total`` shingles together need (numbers or arrays)."""
    return -(-total * num // (den + num))


def utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def slot(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def summaries(docs: DataFrame, size: int) -> DataFrame:
    """id, n, digest, bits for each row; and rows with a null digest: block, counts (of a task's shingles by slot)."""
    names = ["id", "n", "digest", "bits", "block", "counts"]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, known, held, n_held = np.zeros(1 << SLOT_BITS, np.int64), set(), [], 0

        def add_up() -> None:
            nonlocal counts
            if held:
                counts += np.bincount(slot(np.concatenate(held)), minlength=len(counts))
            held.clear()

        for batch in batches:
            for part in chunks(batch, "t", TEXT_AT_ONCE):
                n, digest, bits = [], [], []
                for s in sets(utf8(part.column("t")), size):
                    n.append(len(s))
                    bits.append(bitmap(s))
                    digest.append(d := hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    if d not in known:  # copies count once
                        known.add(d)
                        held.append(s)
                        n_held += len(s)
                if n_held > 500_000:
                    add_up()
                    n_held = 0
                none = pa.nulls(len(n))
                yield pa.record_batch([part.column("id"), *[pa.array(x, t) for x, t in zip((n, digest, bits), kinds[1:4], strict=True)], none.cast(kinds[4]), none.cast(kinds[5])], names)
        add_up()
        blocks = np.minimum(counts, 65_535).astype("<u2").reshape(-1, 1 << BLOCK_BITS)
        packed = [zlib.compress(b.tobytes(), 1) for b in blocks]
        none = pa.nulls(len(packed))
        yield pa.record_batch([*[none.cast(t) for t in kinds[:4]], pa.array(range(len(packed)), kinds[4]), pa.array(packed, kinds[5])], names)

    return docs.mapInArrow(run, "id long, n int, digest binary, bits binary, block int, counts binary")


def counted(found: DataFrame) -> np.ndarray:
    """Counts by slot, added up by blocks in two steps; their number is fixed."""

    def added(kind: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for b, c in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                    x = np.frombuffer(zlib.decompress(c), kind).astype("<u8")
                    sums[b] = sums[b] + x if b in sums else x
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], ["block", "counts"])

        return run

    parts = found.where("block IS NOT NULL").select("block", "counts").repartition("block", F.spark_partition_id() % 64)
    some = parts.mapInArrow(added("<u2"), "block int, counts binary").repartition("block").mapInArrow(added("<u8"), "block int, counts binary")
    out = np.zeros(1 << SLOT_BITS, np.uint64)
    for r in some.collect():  # 1 << (SLOT_BITS - BLOCK_BITS) rows
        out[r["block"] << BLOCK_BITS : (r["block"] + 1) << BLOCK_BITS] += np.frombuffer(zlib.decompress(r["counts"]), "<u8")
    return out


def entries(docs: DataFrame, size: int, num: int, den: int, counts: np.ndarray) -> DataFrame:
    """key, meta (size and shingles left), id, split (the shingle, if its entries are dealt to several tasks; the key is then
    one of its parts): the first shingles of each set; of equal sets in one task only the first."""
    level = np.floor(8 * np.log2(1 + counts.astype(np.float64))).astype(np.uint8)
    mean = counts.mean()
    many = np.where(counts > 4 * mean + SPLIT, np.ceil((counts - mean) / SPLIT), 1).astype(np.int32)
    told = docs.sparkSession.sparkContext.broadcast((level, {int(k): int(many[k]) for k in np.flatnonzero(many > 1)}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, parts = told.value
        busy = np.array(sorted(parts), np.int64)
        known: set[bytes] = set()
        for batch in batches:
            for part in chunks(batch, "t", TEXT_AT_ONCE):
                keys, left, ids, n = [], [], [], []
                for i, s in zip(part.column("id").to_pylist(), sets(utf8(part.column("t")), size), strict=True):
                    if i is None or not len(s) or (d := hashlib.blake2b(s.tobytes(), digest_size=16).digest()) in known:
                        continue
                    known.add(d)
                    p = prefix_size(len(s), num, den)
                    keys.append(s[np.argsort(level[slot(s)], kind="stable")[:p]])
                    left.append(np.arange(len(s), len(s) - p, -1))
                    ids.append(i)
                    n.append(len(s))
                if keys:
                    each = [len(k) for k in keys]
                    key, ids = np.concatenate(keys), np.repeat(np.array(ids, np.int64), each)
                    meta = (np.repeat(np.array(n, np.int64), each) << 32) | np.concatenate(left)
                    split = np.isin(slot(key), busy) if len(busy) else np.zeros(len(key), bool)
                    whole = pa.array(key.copy().view(np.int64), mask=~split)
                    for k in np.flatnonzero(split).tolist():
                        salt = hash((int(ids[k]), 1)) % parts[int(key[k]) >> (64 - SLOT_BITS)]
                        key[k] = (int(key[k]) + salt * 0x9E3779B97F4A7C15) % 2**64
                    yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(meta), pa.array(ids), whole], ["key", "meta", "id", "split"])

    return docs.mapInArrow(run, "key long, meta long, id long, split long")


def close_run(n: np.ndarray, left: np.ndarray, ids: np.ndarray, num: int, den: int, whole: bool) -> tuple[list[int], list[int]]:
    """Of a run in ascending size: places of the members with a partner (all, unless the run is whole), and of each
    the id that it meets, or its own."""
    if not whole:
        kept = np.arange(len(n))
    elif len(n) <= CLOSE_LOOK:
        fits = np.minimum(left[:, None], left[None, :]) >= needed(n[:, None] + n[None, :], num, den)
        np.fill_diagonal(fits, False)
        kept = np.flatnonzero(fits.any(0))
    else:  # held against the smallest of its band, and against the next
        low = np.searchsorted(n, -(-n * num // den))
        after = np.append(n[1:], n[-1] * den // num + 2)
        kept = np.flatnonzero(((low < np.arange(len(n))) & (left >= needed(n + n[np.minimum(low, len(n) - 1)], num, den))) | (left >= needed(n + after, num, den)))
    firsts: list[tuple[int, int, int]] = []
    meets = []
    for nn, ll, i in zip(n[kept].tolist(), left[kept].tolist(), ids[kept].tolist(), strict=True):
        for fn, fl, fi in firsts[: -FIRSTS - 1 : -1]:
            if min(ll, fl) >= needed(nn + fn, num, den):
                meets.append(fi)
                break
        else:
            firsts.append((nn, ll, i))
            meets.append(i)
    return kept.tolist(), meets


def tiles(entered: DataFrame, num: int, den: int) -> DataFrame:
    """Of keys that several sets share, the sets that have a partner: run (a digest of the members, the shingle where it
    is in parts, null for two sets), first (whom the set meets), id, n, left, split."""
    names = ["run", "first", "id", "n", "left", "split"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in names]
        held: tuple[np.ndarray, ...] | None = None  # the run at hand
        long = False  # part of it was sent

        def put(k: int, n: np.ndarray, left: np.ndarray, ids: np.ndarray, split: int | None, whole: bool) -> None:
            kept, meets = close_run(n, left, ids, num, den, whole and split is None)
            if len(kept) < 2 and whole and split is None:
                return
            ids = ids[kept]
            if split is not None or not whole:
                tag = split if split is not None else k
            else:
                tag = None if len(kept) == 2 else int.from_bytes(hashlib.blake2b(ids.tobytes(), digest_size=8).digest(), "little", signed=True)
            for column, values in zip(out, ([tag] * len(kept), meets, ids.tolist(), n[kept].tolist(), left[kept].tolist(), [split is not None or not whole] * len(kept)), strict=True):
                column.extend(values)

        def flush() -> pa.RecordBatch:
            done = pa.record_batch([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names)
            for x in out:
                x.clear()
            return done

        def take(k: np.ndarray, n: np.ndarray, left: np.ndarray, ids: np.ndarray, split: list) -> None:
            """Whole runs."""
            start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            length = np.diff(np.append(start, len(k)))
            part = np.array([x is not None for x in split[start]])  # of a shingle whose other sets are elsewhere
            two = start[(length == 2) & ~part]
            two = two[np.minimum(left[two], left[two + 1]) >= needed(n[two] + n[two + 1], num, den)]
            for at, first in ((two, two), (two + 1, two)):
                for column, values in zip(out, ([None] * len(at), ids[first].tolist(), ids[at].tolist(), n[at].tolist(), left[at].tolist(), [False] * len(at)), strict=True):
                    column.extend(values)
            some = (length > 2) | part
            for a, m in zip(start[some].tolist(), length[some].tolist(), strict=True):
                put(int(k[a]), n[a : a + m], left[a : a + m], ids[a : a + m], split[a], True)

        for batch in batches:
            meta = batch.column("meta").to_numpy()
            now = [batch.column("key").to_numpy(), meta >> 32, meta & 0xFFFFFFFF, batch.column("id").to_numpy(), np.array(batch.column("split").to_pylist(), object)]
            if not len(meta):
                continue
            if held is not None:
                now = [np.concatenate([h, x]) for h, x in zip(held, now, strict=True)]
            last = int(np.searchsorted(now[0], now[0][-1]))  # keys rise
            if long and last:  # the rest of a long run
                end = int(np.searchsorted(now[0], now[0][0], side="right"))
                put(int(now[0][0]), *[x[:end] for x in now[1:4]], now[4][0], False)
                now, last, long = [x[end:] for x in now], last - end, False
            if last:
                take(*[x[:last] for x in now])
            held = tuple(x[last:] for x in now)
            if len(held[0]) >= LONG_RUN:
                put(int(held[0][0]), *held[1:4], held[4][0], False)
                held, long = tuple(x[:0] for x in held), True
            if len(out[0]) > 50_000:
                yield flush()
        if held is not None and len(held[0]):
            if long:
                put(int(held[0][0]), *held[1:4], held[4][0], False)
            else:
                take(*held)
        yield flush()
        tidy()

    return entered.repartition("key").sortWithinPartitions("key", "meta", "id").mapInArrow(run, "run long, first long, id long, n long, left long, split boolean")


def likely(pairs: DataFrame, signed: DataFrame, num: int, den: int) -> DataFrame:
    """Of the pairs a, b those whose bitmaps let them link, and top: the bound of their similarity."""
    one, two = (signed.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            top = np.array([bound(x, y, m, n) for x, y, m, n in zip(batch.column("bitsa").to_pylist(), batch.column("bitsb").to_pylist(), na.tolist(), nb.tolist(), strict=True)], np.int64)
            union = na + nb - top
            good = den * top >= num * union
            yield pa.record_batch([pa.array(a[good]), pa.array(b[good]), pa.array(top[good] / union[good])], ["a", "b", "top"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(run, "a long, b long, top double")


def placed(still: DataFrame, num: int, den: int) -> DataFrame:
    """run, id, comp, left, and the tiles p, q that the row is in, from ``cell``. still: run, id, comp, n, left, total (of the
    run). Sizes that may link are in one class or in classes next to each other. The component that most of a run
    is in has cells of its own, which go beside those of others only."""
    width = math.log(den / num) * 1.001 if num < den else 1.0  # wider than a band, so that rounding loses no neighbour
    zero = F.lit(0).cast("long")
    small = still.where(F.col("total") <= CELL).select("run", "id", "comp", "left", *[zero.alias(c) for c in ("cell", "p", "q")])
    large = still.where(F.col("total") > CELL)
    sizes = large.groupBy("run", "comp").agg(F.count("*").alias("c")).groupBy("run").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"))
    large = large.join(sizes, "run").withColumn("class", 2 * F.floor(F.log(F.col("n").cast("double")) / F.lit(width)).cast("long") + F.when(F.col("comp") == F.col("main"), 0).otherwise(1))
    cells = large.groupBy("run", "class").agg(F.ceil(F.count("*") / CELL).cast("long").alias("k"))
    # a run has few classes, as they rise as the powers of den / num
    cells = cells.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("class", "k"))).alias("ks"))
    large = large.join(cells, "run").withColumn("cell", F.col("class") * (1 << 32) + F.pmod(F.xxhash64("id"), F.element_at("ks", F.col("class"))))
    side = F.col("class") % 2

    def beside(step: int, other: int) -> F.Column:
        c = F.col("class") - side + F.lit(2 * step + other)
        k = F.coalesce(F.try_element_at("ks", c), zero)
        wanted = (k > 0) if other else (k > 0) & (side == 1)
        return F.when(wanted, F.transform(F.sequence(zero, k - 1), lambda h: c * (1 << 32) + h)).otherwise(F.array().cast("array<bigint>"))

    large = large.withColumn("other", F.explode(F.concat(*[beside(step, other) for step in (-1, 0, 1) for other in (0, 1)])))
    return small.unionByName(large.select("run", "id", "comp", "left", "cell", F.least("cell", "other").alias("p"), F.greatest("cell", "other").alias("q")))


def across(tiled: DataFrame, signed: DataFrame, refused: DataFrame, num: int, den: int, forests: int) -> DataFrame:
    """Pairs a < b of one tile, in different components, whose sizes, places and bitmaps let them link and that haven't been
    compared yet; of each tile, so many spanning forests. Rows with a null b: a is a run that had more pairs. tiled:
    run, id, comp, left, cell, p, q; signed: id, n, bits; refused: pairs a, b that were compared and don't link,
    which go beside ``a`` where it has few of them, else to the tiles of both. A tile's bitmaps are compared where they are."""
    key = ["run", "p", "q"]
    count = refused.groupBy("a").agg(F.count("*").alias("c"))
    lists = refused.join(count.where(F.col("c") <= LISTED), "a").groupBy("a").agg(F.collect_list("b").alias("not")).withColumnRenamed("a", "id")
    many = refused.join(count.where(F.col("c") > LISTED), "a").select("a", "b")
    met = tiled.select(*key, F.col("id").alias("a")).join(many, "a").join(tiled.select(*key, F.col("id").alias("b")), [*key, "b"], "left_semi")
    members = tiled.join(signed, "id").join(lists, "id", "left").select(*key, F.lit(1).alias("role"), "comp", "n", "id", "bits", "not", "cell", "left")
    null = F.lit(None)
    tested = met.select(*key, F.lit(0).alias("role"), null.cast("long").alias("comp"), F.col("b").alias("n"), F.col("a").alias("id"), null.cast("binary").alias("bits"), null.cast("array<bigint>").alias("not"), *[null.cast("long").alias(c) for c in ("cell", "left")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, done = None, [], {}

        def end() -> Iterator[pa.RecordBatch]:
            if name is not None:
                yield from spanning(held, num, den, forests, done, name[1] != name[2], name[0])

        for batch in batches:
            for r, p, q, role, *member in zip(*(batch.column(x).to_pylist() for x in (*key, "role", "comp", "n", "id", "bits", "not", "cell", "left")), strict=True):
                if (r, p, q) != name:
                    yield from end()
                    name, held, done = (r, p, q), [], {}
                if role == 0:
                    done.setdefault(member[2], array("q")).append(member[1])
                else:
                    held.append(member)
        yield from end()
        held, done = [], {}
        tidy()

    rows = members.unionByName(tested).repartition(*key).sortWithinPartitions(*key, "role", "n", "id")
    return rows.mapInArrow(run, "a long, b long").distinct()


def spanning(members: list[list], num: int, den: int, forests: int, done: dict[int, array] | None = None, apart: bool = False, run: int = 0) -> Iterator[pa.RecordBatch]:
    """Of a tile's open pairs, those that spanning forests of its components take, the likeliest first: a forest has fewer
    pairs than the tile has sets. Where pairs stay open for the next round, the run comes out with a null. members: component,
    size, id, bitmap, tested ids, cell, shingles left; done: of some ids, others that they don't link with; apart: only
    pairs of different cells count."""
    if len({m[0] for m in members}) < 2:
        return
    ids = np.array([m[2] for m in members], np.int64)
    comp = [m[0] for m in members]
    tested = [{*(m[4] or ()), *(done or {}).get(m[2], ())} for m in members]
    kept: tuple[np.ndarray, ...] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    more = False

    def find(up: dict[int, int], x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for some in open_pairs(members, num, den, apart):  # a block at a time; of each, and of what was kept, the forests stay
        i, j, top = (np.concatenate(c) for c in zip(kept, some, strict=True))
        trees: list[dict[int, int]] = [{} for _ in range(min(forests, len(members)))]
        taken = []
        for k in np.lexsort((np.maximum(ids[i], ids[j]), np.minimum(ids[i], ids[j]), -top)).tolist():
            x, y = int(i[k]), int(j[k])
            if int(ids[y]) in tested[x] or int(ids[x]) in tested[y]:
                continue
            for up in trees:
                p, q = find(up, comp[x]), find(up, comp[y])
                if p != q:
                    up[p] = q
                    taken.append(k)
                    break
            else:
                more = True
        kept = (i[taken], j[taken], top[taken])
    i, j, _ = kept
    if len(i):
        yield pa.record_batch([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j]))], ["a", "b"])
    if more:
        yield pa.record_batch([pa.array([run], pa.int64()), pa.array([None], pa.int64())], ["a", "b"])


def open_pairs(members: list[list], num: int, den: int, apart: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of the pairs of a tile, given as for ``spanning`` by size, that are in different components
    and may link, and how likely: the bound of their similarity. In blocks of about PAIRS_IN_MEMORY."""
    comp, n, left = (np.array([m[k] for m in members], np.int64) for k in (0, 1, 6))
    cell = np.array([m[5] for m in members], np.int64) if apart else None
    width = np.array([len(m[3]) for m in members])
    rows = {w: np.flatnonzero(width == w) for w in np.unique(width).tolist()}
    maps = {w: np.frombuffer(b"".join(members[i][3] for i in at), np.uint8).reshape(-1, w) for w, at in rows.items()}
    half = {w: m[:, : w // 2] | m[:, w // 2 :] for w, m in maps.items()}
    place = np.zeros(len(members), np.int64)
    for at in rows.values():
        place[at] = np.arange(len(at))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0
    for i in range(len(members) - 1):
        end = int(np.searchsorted(n, den * n[i] // num, side="right"))  # sizes rise: the band ends here
        for w in (width[i], 2 * width[i]):  # a larger set has a bitmap as long, or twice as long
            at = rows.get(int(w))
            if at is None:
                continue
            lo, hi = np.searchsorted(at, [i + 1, end])
            some = at[lo:hi]
            some = some[comp[some] != comp[i]]
            if apart:
                some = some[cell[some] != cell[i]]
            some = some[np.minimum(left[some], left[i]) >= needed(n[some] + n[i], num, den)]
            if not len(some):
                continue
            x = maps[int(width[i])][place[i]]
            y = (maps if w == width[i] else half)[int(w)][place[some]]
            top = np.minimum(n[i] - np.bitwise_count(x & ~y).sum(1, dtype=np.int64), n[some] - np.bitwise_count(y & ~x).sum(1, dtype=np.int64))
            union = n[i] + n[some] - top
            good = den * top >= num * union
            if good.any():
                out.append((np.full(int(good.sum()), i), some[good], (top / union)[good]))
                held += len(out[-1][0])
        if held > PAIRS_IN_MEMORY:
            yield tuple(np.concatenate(x) for x in zip(*out, strict=True))
            out, held = [], 0
    if out:
        yield tuple(np.concatenate(x) for x in zip(*out, strict=True))


def bitmap(s: np.ndarray) -> bytes:
    """Twice as many bits as shingles at least, a power of two; a shingle's low bits name its own."""
    m = 1 << max(6, int(2 * len(s) - 1).bit_length())
    bits = np.zeros(m, np.uint8)
    bits[(s & np.uint64(m - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def bound(a: bytes, b: bytes, na: int, nb: int) -> int:
    """No overlap is larger."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    return min(na - int(np.bitwise_count(x & ~y).sum()), nb - int(np.bitwise_count(y & ~x).sum()))


def linked(docs: DataFrame, pairs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs a, b that link. Texts go to their pairs, not sets, which are larger: first by identifier, then, beside
    the text of ``a``, by ``a``. An ``a`` of many pairs is dealt over as many tasks as it has thousands of them."""
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_AT_ONCE).cast("int").alias("salts"))
    one = counts.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    other = pairs.join(counts, "a").select(F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"))
    needs = cut(one.unionByName(other))
    texts = among(docs, needs.select("id")).join(needs, "id").select("a", "salt", "role", "id", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, bits = None, None, b""
        for batch in batches:
            for part in chunks(batch, "t", 500_000):
                a, b = [], []
                for aa, salt, role, i, s in zip(*(part.column(c).to_pylist() for c in ("a", "salt", "role", "id")), sets(utf8(part.column("t")), size), strict=True):
                    if role == 0:
                        at, first, bits = (aa, salt), s, bitmap(s)
                    elif at == (aa, salt):
                        top = bound(bits, bitmap(s), len(first), len(s))
                        if den * top >= num * (len(first) + len(s) - top) and overlap_links(first, s, num, den):
                            a.append(aa)
                            b.append(i)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return texts.repartition("a", "salt").sortWithinPartitions("a", "salt", "role", "id").mapInArrow(run, "a long, b long")


def overlap_links(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(b) else 0
    return den * both >= num * (len(a) + len(b) - both)


def classes(df: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id that links reach)."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    found = cut(summaries(docs, size))
    rows = found.where("digest IS NOT NULL").select("id", "n", "digest")
    same = cut(rows.where("n > 0 AND id IS NOT NULL").groupBy("n", "digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    # only classes of several rows have members that another stands for
    stands = cut(rows.join(same.where("copies > 1").hint("merge"), ["n", "digest"]).where("id <> rep").select("id", "rep").distinct())

    def by_rep(frame: DataFrame, column: str) -> DataFrame:
        return frame.join(stands.select(F.col("id").alias(column), F.col("rep").alias("__rep")), column, "left").withColumn(column, F.coalesce("__rep", column)).drop("__rep")

    tiled = cut(tiles(entries(docs, size, num, den, counted(found)), num, den))
    # a shingle's parts meet by their firsts
    parts = tiled.where("split").groupBy("run", F.col("first").alias("id")).agg(F.min("n").alias("n"))
    parts = parts.join(parts.groupBy("run").agg(F.min(F.struct("n", "id"))["id"].alias("first")), "run")
    meets = tiled.select("first", "id").unionByName(parts.select("first", "id")).where("first <> id").distinct()
    meets = by_rep(by_rep(meets, "first"), "id").where("first <> id")
    meets = meets.select(F.least("first", "id").alias("a"), F.greatest("first", "id").alias("b")).distinct()
    runs = cut(by_rep(tiled.where("run IS NOT NULL").select("run", "id", "n", "left"), "id").groupBy("run", "id").agg(F.max("n").alias("n"), F.max("left").alias("left")))
    wanted = meets.select(F.col("a").alias("id")).unionByName(meets.select(F.col("b").alias("id"))).unionByName(runs.select("id")).distinct()
    signed = cut(found.where("digest IS NOT NULL").select("id", "n", "bits").join(wanted, "id", "left_semi").dropDuplicates(["id"]))
    near = cut(likely(meets, signed, num, den))
    best = near.withColumn("r", F.row_number().over(W.partitionBy("b").orderBy(F.desc("top"), "a"))).where("r = 1").select("a", "b")
    tested = cut(best)
    links = cut(linked(docs, tested, size, num, den))
    comp = components(links)

    def with_comp(frame: DataFrame, column: str, name: str) -> DataFrame:
        return frame.join(comp.select(F.col("node").alias(column), F.col("component").alias("__c")), column, "left").withColumn(name, F.coalesce("__c", column)).drop("__c")

    forests, others = FORESTS, near.select("a", "b")
    while True:  # until no open pair is left: rounds link components or rule pairs out, and take ever more pairs
        several = with_comp(runs, "id", "comp")
        mixed = several.groupBy("run").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("total")).where("lo <> hi").select("run", "total")
        still = cut(several.join(mixed, "run"))
        ids = still.select("id").distinct()
        refused = tested.join(links, ["a", "b"], "left_anti").join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
        told = cut(across(placed(still, num, den), signed, refused, num, den, forests))
        apart = with_comp(with_comp(others, "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b")
        rest = cut(told.where("b IS NOT NULL").unionByName(apart).distinct().join(tested, ["a", "b"], "left_anti"))
        if rest.isEmpty():
            break
        opened = told.where("b IS NULL").select(F.col("a").alias("run"))
        old = runs, tested, links
        runs, tested, links = cut(still.join(opened, "run", "left_semi").select("run", "id", "n", "left")), cut(tested.unionByName(rest)), cut(links.unionByName(linked(docs, rest, size, num, den)))
        comp, others = components(links), others.limit(0)
        forget(*old, still, told, rest)
        forests *= FOREST_GROWTH
    forget(still, told, rest, runs, tested, links, near, signed, tiled, stands)
    final = same.withColumnRenamed("rep", "id")
    final = with_comp(final, "id", "component").where("copies > 1 OR component <> id").select("n", "digest", "component")
    return rows.join(final.hint("merge"), ["n", "digest"], "left").select(F.col("id").cast(dict(df.dtypes)[id_col]).alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def drop(df: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of one document of each component, the smallest, with their columns as they came."""
    gone = cut(classes(df, size, num, den, id_col, text_col).where(F.col("component_id") != F.col(id_col)).select(id_col))
    return without(df, gone, id_col)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"), size=4, num=85, den=100)
