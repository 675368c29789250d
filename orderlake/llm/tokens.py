"""Token ids in directly addressable codes.

An id is split in chunks of eight bits, lowest first. Level k holds the k-th chunk of every id that has one, a bitmap
that tells which of them continue on the next level, and a rank directory with the number of set bits before every 512th.
The place of an id on the next level is the rank of its bit, so any token, or any run of tokens, is read from a few
bytes of each level, and nothing else is decoded.

File format: a Parquet table of blocks, written by Spark and thus by its commit protocol, in ascending order of document:
``part`` and ``block`` (their order), ``doc_ids`` (little-endian signed 64-bit), ``n_null`` (so many of them, at the
front, stand for a null), ``ends`` (unsigned 64-bit: ids up to the end of each document in the block), ``n_ids``,
``part_start`` (ids of the part before the block) and ``levels``, for each level its chunks, bitmap and directory. A block
ends with the document that takes it past ``BLOCK`` ids.

Ids come from the tokenizers library. Its vocabulary drops white space and splits there, so each distinct word of a slice
of texts is encoded once, and words met lately are remembered in a memory of bounded size. Where the library is seen to fold
case and to part ASCII punctuation from the letters before it, words that differ so lend each other their ids. One whole
text of each slice is held against the library; if it differs, the slice is encoded by whole texts.

Defined results: a null text counts as empty and has the end id alone; rows of equal doc_id stand beside each other, in
any order; rows with a null doc_id come first; further columns are ignored; an empty table gives a table without blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from orderlake.llm.common import table
from orderlake.llm.pieces import model_path
from orderlake.llm.vocabulary import Memory, Words, chunks
from orderlake.sources.paths import fresh

BLOCK, CHUNK, STEP = 1 << 20, 8, 512
END = 1
MODEL = "word_bpe_49k.json"
#: Words of each of two generations, about 140 bytes each.
REMEMBERED, LONGEST = 350_000, 40
MARK, TAIL = "\x01", ".,;:!?#$%&"
LEVELS = "array<struct<chunks:binary,bitmap:binary,ranks:binary>>"


class Level:
    """One level: chunks (bytes), bits packed low bit first, ranks at every STEP bits."""

    def __init__(self, chunks: np.ndarray, bitmap: np.ndarray, ranks: np.ndarray):
        self.chunks, self.bitmap, self.ranks = chunks, bitmap, ranks

    @classmethod
    def of(cls, chunks: np.ndarray, more: np.ndarray) -> Level:
        sums = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), STEP), dtype=np.uint64))[:-1]]) if len(more) else np.zeros(0)
        return cls(chunks, np.packbits(more, bitorder="little"), sums.astype("<u4"))

    def bits(self, a: int, b: int) -> np.ndarray:
        return np.unpackbits(self.bitmap[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a]

    def rank(self, i: int) -> int:
        """Set bits before bit i."""
        if not len(self.ranks):
            return 0
        k = min(i // STEP, len(self.ranks) - 1)
        return int(self.ranks[k]) + int(self.bits(k * STEP, i).sum())


def pack(ids: np.ndarray) -> list[Level]:
    """The levels of an array of unsigned ids."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        more = (rest >> CHUNK) > 0
        levels.append(Level.of((rest & 255).astype(np.uint8), more.astype(np.uint8)))
        if not more.any():
            return levels
        rest = rest[more] >> CHUNK


def read(levels: list[Level], a: int, b: int) -> np.ndarray:
    """Ids a to b of a block; the other ids aren't touched."""
    if a >= b:
        return np.zeros(0, np.uint32)
    level = levels[0]
    out = level.chunks[a:b].astype(np.uint32)
    if len(levels) > 1:
        more = level.bits(a, b).astype(bool)
        if n := int(more.sum()):
            at = level.rank(a)
            out[more] |= read(levels[1:], at, at + n) << CHUNK
    return out


def to_row(level: Level) -> dict:
    return {"chunks": level.chunks.tobytes(), "bitmap": level.bitmap.tobytes(), "ranks": level.ranks.tobytes()}


def of_row(row: dict) -> Level:
    return Level(np.frombuffer(row["chunks"], np.uint8), np.frombuffer(row["bitmap"], np.uint8), np.frombuffer(row["ranks"], "<u4"))


class Encoder:
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Memory(REMEMBERED, LONGEST)
        found = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = found[0] if len(found) == 1 else None
        one = lambda w: self.tokenizer.encode(w, add_special_tokens=False).ids
        self.folds = one("Hello") == one("hello") and all(one(f"hello{x}{x}{y}") == one("hello") + one(x + x + y) for x in TAIL for y in TAIL)

    def library(self, words: list[str]) -> list[bytes]:
        """Ids of each word. Words go to the library in one text with a mark between them, a control character whose id no
        other text has, and the ids are cut at the marks."""
        plain = [w for w in words if MARK not in w] if self.mark is not None else []
        out = {}
        if plain:
            ids = np.array(self.tokenizer.encode_batch_fast([f" {MARK} ".join(plain)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * np.flatnonzero(ids == self.mark)).tolist()
            raw = ids.tobytes()
            parts = [raw[a:b] for a, b in zip([0, *[c + 4 for c in cuts]], [*cuts, len(raw)], strict=True)]
            out = dict(zip(plain, parts, strict=True))
        rest = [w for w in words if w not in out]
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            out[w] = np.array(e.ids, "<u4").tobytes()
        return [out[w] for w in words]

    def make(self, new: list[str]) -> dict[str, bytes]:
        """The ids of words that aren't known."""
        made, ask, split = {"": b""}, dict.fromkeys(new), {}
        if self.folds:
            for w in new:
                if w.isascii():
                    low = w.lower()
                    core = low.rstrip(TAIL)
                    if core != w and core.isalpha():
                        split[w] = core, low[len(core) :]
                        del ask[w]
            for x in {x for both in split.values() for x in both if x}:
                if (ids := self.known.get(x)) is not None:
                    made[x] = ids
                else:
                    ask[x] = None
        ask.pop("", None)
        want = list(ask)
        for at in range(0, len(want), 2048):
            some = want[at : at + 2048]
            made |= zip(some, self.library(some), strict=True)
        for core in {core for core, _ in split.values()}:
            self.known.put(core, made[core])
        for w, (core, tail) in split.items():
            made[w] = made[core] + made[tail]
        return made

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text begins and the last ends."""
        words = Words(pc.ascii_split_whitespace(texts))
        ids, ends = words.put_together(self.known.all(words.distinct, self.make), 4)
        if len(texts):  # one whole text, the shortest that isn't trivial
            size = pc.utf8_length(texts).to_pylist()
            i = min(range(len(texts)), key=lambda i: (size[i] < 20, size[i]))
            if not np.array_equal(ids[ends[i] : ends[i + 1]], np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4")):
                each = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
                return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        return ids, ends


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process, kept over its tasks."""
    return Encoder(path)


def write(df: DataFrame, path: str, model: str, end_id: int = END, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode the texts and write them as blocks, in ascending order of the identifier."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id")  # nulls first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, part = encoder(model), np.array([end_id], "<u4"), TaskContext.get().partitionId()
        state = {"block": 0, "start": 0, "n": 0, "ids": [], "docs": []}

        def block() -> pa.RecordBatch:
            n = np.array([len(x) for x in state["ids"]], np.uint64)
            levels = pack(np.concatenate(state["ids"]))
            nulls = sum(d is None for d in state["docs"])
            docs = np.array([d or 0 for d in state["docs"]], "<i8")
            out = [part, state["block"], docs.tobytes(), nulls, np.cumsum(n).astype("<u8").tobytes(), int(n.sum()), state["start"], [to_row(x) for x in levels]]
            state.update(block=state["block"] + 1, start=state["start"] + state["n"], n=0, ids=[], docs=[])
            return pa.record_batch([pa.array([x], t) for x, t in zip(out, types, strict=True)], names)

        types = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.struct([("chunks", pa.binary()), ("bitmap", pa.binary()), ("ranks", pa.binary())]))]
        names = ["part", "block", "doc_ids", "n_null", "ends", "n_ids", "part_start", "levels"]
        for batch in batches:
            for some in chunks(batch, "t", 4_000_000):
                ids, at = enc.encode_batch(some.column("t"))
                for doc, a, b in zip(some.column("id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    state["docs"].append(doc)
                    state["ids"].append(np.concatenate([ids[a:b], end]))
                    state["n"] += b - a + 1
                    if state["n"] >= BLOCK:
                        yield block()
        if state["docs"]:
            yield block()

    rows.mapInArrow(run, f"part int, block int, doc_ids binary, n_null long, ends binary, n_ids long, part_start long, levels {LEVELS}").write.parquet(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the files."""
    blocks = spark.read.parquet(path)
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each task that wrote
    before = sums.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = blocks.join(F.broadcast(before), "part").select("doc_ids", "n_null", "ends", (F.col("before") + F.col("part_start")).alias("start"), "levels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                levels = [of_row(x) for x in row["levels"]]
                docs, ends = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["ends"], "<u8").astype(np.int64)
                begins = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(read(levels, int(a), int(b)).astype("<u4").tobytes()) for a, b in zip(begins, ends, strict=True)]
                yield pa.record_batch([pa.array(docs, mask=np.arange(len(docs)) < row["n_null"]), pa.array(begins + row["start"]), pa.array(ends - begins), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "tokens")
    write(table(spark, sf_dir, "documents"), path, model_path(MODEL))
    return digests(spark, path)
