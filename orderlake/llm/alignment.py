r"""Cross-tokenizer alignment with corpus-wide counts of linked id pairs, by external spill counting.

Tokens of two tokenizers, A and B, lie over the same bytes; where both end, the text is cut into groups, and the two tokens
that end there are a link. How often a pair of ids is linked in the corpus, and which A id is most often linked with a B id,
needs all links together, while what comes of it belongs to documents. So:

1. Documents are aligned in slices. A chunk of documents sorts its links by B id, A id and document, sums them, and writes
   them in radix partitions of the B id as runs: the pairs with their counts, and for each pair its documents, in zstd.
2. The runs of a radix meet, in as many splits as their number of records needs, and a heap merges the heads of all runs in
   order of pairs: each pair's count. The splits' counts are merged so again. As the order is B id first, all pairs of
   a B id are neighbours, and the highest count is known when the next one begins.
3. The runs are streamed once more, beside the counts of their radix, and each gives its documents' shares: one short array
   for each chunk and radix, which come back to the chunk's documents.

No task holds more than a split's compressed runs and one radix' pairs; a B id that holds a third of all links is split
like any other. Only chunks' arrays and runs are shuffled, never single links.

Both tokenizers treat the pieces between single spaces alone, so each distinct piece of a slice is aligned once, all new
ones together in one pass of each library; a memory of bounded size keeps what was met lately. A piece whose bytes a library
doesn't give back has no alignment, nor has a text that holds it. Of each slice one whole text is held against the
libraries; if it differs, the slice is aligned by whole texts. Long texts are cut between pieces.

Defined results: null and empty texts, and those that a tokenizer doesn't give back byte for byte, have no tokens: zeros
and the empty string; rows are documents of their own, also repeated ones and those with a null identifier; further columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from orderlake.llm.common import cut, table
from orderlake.llm.pieces import SPACE, model_path
from orderlake.llm.vocabulary import Memory, Words, chunks

A_MODEL, B_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Radix partitions of B ids.
RADIXES = 64
#: Pieces of each of two generations, about 350 bytes each.
REMEMBERED, LONGEST = 200_000, 40
WHITE = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ODD = f"[{WHITE}][{WHITE}]|^[{WHITE}]|[{WHITE}]$"
#: Fixed value: where byte-level BPE splits a text before it merges.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BORDER = re.compile(f"(?<=[^{WHITE}]) (?=[^{WHITE}])")


@dataclass(frozen=True)
class Limits:
    """What a task holds; no limit changes a result. Links and documents of a chunk, characters of a part of a long text, records
    of a split, pairs of a row of counts."""

    links: int = 4_000_000
    documents: int = 50_000
    part: int = 1_000_000
    split: int = 1 << 24
    row: int = 1 << 18


def byte_of_symbol() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others, in order, for characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        symbol = byte_of_symbol()
        name = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        self.a_bytes = [bytes(symbol[c] for c in t) if all(c in symbol for c in t) else t.encode() for t in name]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        self.a_size, self.b_size = np.array([len(x) for x in self.a_bytes]), np.array([len(x) for x in self.b_bytes])
        n_a, n_b = len(self.a_bytes), len(self.b_bytes)
        #: Ids written out, by what follows them.
        self.text = [f"{i}{end}".encode() for n, ends in ((n_a, ",|"), (n_b, ",;")) for end in ends for i in range(n)]
        self.n_a, self.type = n_a, "<u4" if n_a * n_b < 1 << 32 else "<u8"
        self.lines = not any("\n" in self.b.id_to_piece(i) for i in range(n_b) if not self.b.is_byte(i))
        self.known = Memory(REMEMBERED, LONGEST)
        self.quick = self.ranked()

    def ranked(self):
        """A faster encoder of A's vocabulary, where its merges stand in the order of their ids: each whole text that is held
        against the library tells if it is the same."""
        import tiktoken

        whole = json.loads(self.a.to_str())
        model, split = whole["model"], whole["pre_tokenizer"] or {}
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model.get("merges") or ()]
        if whole["normalizer"] or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space") or [model["vocab"].get(m) for m in merges] != list(range(256, 256 + len(merges))):
            return None
        ranks = {self.a_bytes[i]: i for i in model["vocab"].values() if i < 256 + len(merges)}
        return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def tokens(self, text: str, library: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
        """Both tokenizers' ids of a text that begins with a space; None if they don't give its bytes back."""
        raw = text.encode("utf-8", "surrogatepass")
        a = self.a.encode(text, add_special_tokens=False).ids if library or self.quick is None else self.quick.encode_ordinary(text)
        b = self.b.encode(text[1:], num_threads=1)
        if b"".join([self.a_bytes[i] for i in a]) != raw or b"".join([self.b_bytes[i] for i in b]) != raw:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def aligned(self, parts: list[str], library: bool = False) -> list[tuple]:
        """Of each part: its groups as text with ``;`` behind each, its links, and how many tokens A and B have; () stands for a
        part without alignment. The parts are one text that begins with a space; of several the first is any word to begin with."""
        both = self.tokens("".join(parts), library)
        size = np.cumsum([len(p.encode("utf-8", "surrogatepass")) for p in parts])
        if both is not None:
            a, b = both
            end_a, end_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
            common = np.intersect1d(end_a, end_b, assume_unique=True)
        if both is None or not np.isin(size, common).all():
            first, *rest = parts
            if len(rest) < 2:
                return [()] * len(parts)
            half = len(rest) // 2  # what can't be given back is found by halves, each behind the first part
            return self.aligned([first, *rest[:half]]) + self.aligned([first, *rest[half:]])[1:]
        at_a, at_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        last_a, last_b = common[at_a] == end_a, common[at_b] == end_b
        order = np.argsort(np.concatenate([2 * at_a, 2 * at_b + 1]), kind="stable")
        n_b = len(self.b_bytes)
        words = [self.text[i] for i in np.concatenate([a + last_a * self.n_a, 2 * self.n_a + b + last_b * n_b])[order].tolist()]
        links = (b[last_b] * self.n_a + a[last_a]).astype(self.type)
        raw, width = links.tobytes(), links.itemsize
        na, nb, ng = (np.concatenate([[0], np.searchsorted(x, size, "right")]).tolist() for x in (end_a, end_b, common))
        return [(b"".join(words[na[i] + nb[i] : na[i + 1] + nb[i + 1]]), raw[width * ng[i] : width * ng[i + 1]], na[i + 1] - na[i], nb[i + 1] - nb[i]) for i in range(len(parts))]

    def make(self, new: list[str]) -> dict[str, tuple]:
        """The alignments of pieces. A piece that begins with white space is taken as it stands, others follow a space."""
        made = {}
        plain = [w for w in new if w[0] != " "]
        for at in range(0, len(plain), 8192):
            some = plain[at : at + 8192]
            made |= zip(some, self.aligned([" a", *[w if w[0] == "\n" else f" {w}" for w in some]])[1:], strict=True)
        for w in new:
            if w[0] == " ":
                made[w] = self.aligned([w])[0]
        return made

    def pieces(self, texts: pa.Array) -> Words:
        """Each text's pieces: between single spaces, and before newlines, that have no white space beside them."""
        if self.lines and not pc.any(pc.match_substring_regex(texts, ODD)).as_py():
            return Words(pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " "))
        out = []
        for t in texts.to_pylist():
            first, *rest = BORDER.split(" " + t)
            out.append([first if BORDER.search("a" + first) is None else first[1:], *rest])
        return Words(pa.array(out, pa.list_(pa.string())))

    def batch(self, texts: pa.Array) -> tuple[list[tuple | None], np.ndarray, np.ndarray]:
        """Of each text (none is empty): n_a, n_b and its groups as text, or None; all links; where each text's begin and end."""
        words = self.pieces(texts)
        found = self.known.all(words.distinct, self.make)
        good = np.array([bool(x) for x in found], bool)
        found = [x or (b"", b"", 0, 0) for x in found]
        bad = np.concatenate([[0], np.cumsum(~good[words.code])])[words.ends]
        each = [np.concatenate([[0], np.cumsum(np.array([x[k] for x in found], np.int64)[words.code])])[words.ends] for k in (2, 3)]
        flat = np.frombuffer(b"".join([x[1] for x in found]), self.type)
        n = np.array([len(x[1]) for x in found], np.int64) // flat.itemsize
        start, many = (np.cumsum(n) - n)[words.code], n[words.code]
        end = np.cumsum(many)
        links = flat[np.repeat(start - (end - many), many) + np.arange(int(end[-1]) if len(end) else 0)]
        begin = np.concatenate([[0], end])[words.ends]
        code, groups, ends, ok = words.code.tolist(), [x[0] for x in found], words.ends.tolist(), (np.diff(bad) == 0).tolist()
        n_a, n_b = (np.diff(x).tolist() for x in each)
        out = [(n_a[i], n_b[i], b"".join([groups[k] for k in code[a:b]])) if ok[i] else None for i, (a, b) in enumerate(zip(ends, ends[1:]))]
        size = pc.utf8_length(texts).to_pylist()
        i = min(range(len(size)), key=lambda i: (size[i] < 20, size[i]))  # one whole text, the shortest that isn't trivial
        if self.whole(texts[i].as_py())[0] != out[i]:
            each = [self.whole(t) for t in texts.to_pylist()]
            return [x for x, _ in each], np.concatenate([y for _, y in each]), np.concatenate([[0], np.cumsum([len(y) for _, y in each])])
        return out, links, begin

    def whole(self, text: str) -> tuple[tuple | None, np.ndarray]:
        got = self.aligned([" " + text], library=True)[0]
        return ((got[2], got[3], got[0]), np.frombuffer(got[1], self.type)) if got else (None, np.zeros(0, self.type))


def parts(text: str, most: int) -> list[str]:
    """A long text in parts between which a space is left out."""
    out, begin = [], 0
    while len(text) - begin > most and (m := BORDER.search(text, begin + most)):
        out.append(text[begin : m.start()])
        begin = m.end()
    return [*out, text[begin:]]


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each worker process, kept over its tasks."""
    return Aligner(a_path, b_path)


def packed(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join([x.tobytes() for x in arrays]))


def unpacked(raw: bytes, *types: str) -> list[np.ndarray]:
    """Arrays of equal length that were packed together."""
    data = zstandard.ZstdDecompressor().decompress(raw)
    n, at, out = len(data) // sum(np.dtype(t).itemsize for t in types), 0, []
    for t in types:
        out.append(np.frombuffer(data, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


HEADS, BODY, COUNTS, SHARES = ("<u8", "<u4", "<u4"), ("<u4", "<u4"), ("<u8", "<i8", "<i8"), ("<u4", "<i8", "<i8")


def runs(links: np.ndarray, docs: np.ndarray, n_a: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """A chunk's links as runs: radix, records, heads (pair, count, documents) and body (document, count) in order of pairs."""
    key = (links.astype(np.int64) << 20) | docs
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=-1))
    n = np.diff(first, append=len(key)).astype("<u4")
    pair, doc = (key[first] >> 20).astype("<u8"), (key[first] & ((1 << 20) - 1)).astype("<u4")
    head = np.flatnonzero(np.diff(pair.astype(np.int64), prepend=-1))
    many = np.diff(head, append=len(pair))
    total = np.add.reduceat(n, head)
    radix = ((pair[head] // n_a * 2_654_435_761) % (1 << 32) * RADIXES) >> 32
    for r in np.unique(radix).tolist():
        own = np.flatnonzero(radix == r)
        m = many[own]
        rows = np.repeat(head[own] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        yield r, len(rows), packed(pair[head[own]], total[own].astype("<u4"), m.astype("<u4")), packed(doc[rows], n[rows])


def encoded(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """A row for each document (chunk, doc, id, n_a, n_b, n_groups, n_links, groups_sha256) and for each run of a
    chunk (chunk, radix, n, heads, body)."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al, part, number, state, types = aligner(a_path, b_path), TaskContext.get().partitionId(), 0, None, {}

        def record(columns: dict) -> pa.RecordBatch:
            n = len(columns["chunk"])
            return pa.record_batch([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in types.items()], list(types))

        def flush() -> Iterator[pa.RecordBatch]:
            chunk, n = part << 32 | number, len(state["rows"])
            yield record({"chunk": [chunk] * n, "doc": range(n)} | {c: [x[k] for x in state["rows"]] for k, c in enumerate(("id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"))})
            if state["n"]:
                found = list(runs(np.concatenate(state["links"]), np.repeat(np.array(state["of"]), [len(x) for x in state["links"]]), al.n_a))
                for at in range(0, len(found), 8):
                    some = found[at : at + 8]
                    yield record({"chunk": [chunk] * len(some)} | {c: [x[k] for x in some] for k, c in enumerate(("radix", "n", "heads", "body"))})

        for batch in batches:
            types = {"chunk": pa.int64(), "doc": pa.int32(), "id": batch.schema.field("id").type, **dict.fromkeys(("n_a", "n_b", "n_groups", "n_links"), pa.int64()), "groups_sha256": pa.string(), "radix": pa.int32(), "n": pa.int64(), "heads": pa.binary(), "body": pa.binary()}
            for some in chunks(batch, "t", 3_000_000):
                texts = [parts(t, limits.part) for t in some.column("t").to_pylist()]
                flat = [t for p in texts for t in p if t]
                got, links, begin = al.batch(pa.array(flat, pa.string())) if flat else ([], np.zeros(0, al.type), np.zeros(1, np.int64))
                at = 0
                for i, p in zip(some.column("id").to_pylist(), texts, strict=True):
                    if state is None:
                        state = {"rows": [], "links": [], "of": [], "n": 0}
                    k = len(p) if p[0] else 0
                    mine, own = got[at : at + k], links[begin[at] : begin[at + k]]
                    at += k
                    if not k or None in mine:
                        state["rows"].append((i, 0, 0, 0, 0, ""))
                    else:
                        sha = hashlib.sha256()
                        for j, x in enumerate(mine):
                            sha.update(x[2] if j < k - 1 else x[2][:-1])
                        state["of"].append(len(state["rows"]))
                        state["links"].append(own)
                        state["n"] += len(own)
                        state["rows"].append((i, sum(x[0] for x in mine), sum(x[1] for x in mine), len(own), len(own), sha.hexdigest()))
                    if state["n"] >= limits.links or len(state["rows"]) >= limits.documents:
                        yield from flush()
                        number, state = number + 1, None
        if state is not None:
            yield from flush()

    return rows.mapInArrow(run, f"chunk long, doc int, id {dict(rows.dtypes)['id']}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, radix int, n long, heads binary, body binary")


def merged(sources: list[list[tuple[int, int]]]) -> Iterator[tuple[int, int]]:
    """Pairs in order with the sum of their counts over all sources, by a heap of the sources' heads."""
    for pair, same in groupby(heapq.merge(*sources), itemgetter(0)):
        yield pair, sum(n for _, n in same)


def count(rows: DataFrame, keys: list[str], n_a: int, row_size: int) -> DataFrame:
    """Of each group of rows by ``keys``, the first of which is radix: its pairs' counts in order of pairs (radix, counts). Best
    is the highest count of a pair's B id in the group. A row's end is the end of a B id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def written(key, sources) -> Iterator[pa.RecordBatch]:
            pairs: list[int] = []
            counts: list[int] = []
            best: list[int] = []
            row = lambda: pa.record_batch([pa.array([key[0]], pa.int32()), pa.array([packed(*[np.array(x, t) for x, t in zip((pairs, counts, best), COUNTS, strict=True)])], pa.binary())], ["radix", "counts"])
            for _, side in groupby(merged(sources), lambda x: x[0] // n_a):
                own = list(side)
                pairs += [p for p, _ in own]
                counts += [n for _, n in own]
                best += [max(n for _, n in own)] * len(own)
                if len(pairs) >= row_size:
                    yield row()
                    pairs, counts, best = [], [], []
            if pairs:
                yield row()

        key, sources = None, []
        for batch in batches:
            for *at, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if at != key:
                    if sources:
                        yield from written(key, sources)
                    key, sources = at, []
                pair, n, _ = unpacked(raw, *(HEADS if heads else COUNTS))
                sources.append(list(zip(pair.tolist(), n.tolist(), strict=True)))
        if sources:
            yield from written(key, sources)

    heads = "heads" in rows.columns
    rows = rows.select(*keys, "heads" if heads else "counts").repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(run, "radix int, counts binary")


def shares(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """What each run gives its chunk's documents: chunk, shares (document, links with the highest count, sum of counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, known, counts = None, [], None
        for batch in batches:
            chunk, out = [], []
            for radix, split, at, heads, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (radix, split) != key:
                    key, known, counts = (radix, split), [], None
                if body is None:
                    known.append(unpacked(heads, *COUNTS))
                    continue
                if counts is None:
                    pair, n, best = (np.concatenate(x) for x in zip(*known, strict=True))
                    order = np.argsort(pair)
                    counts, known = (pair[order], n[order], best[order]), []
                pair, _, many = unpacked(heads, *HEADS)
                doc, n = unpacked(body, *BODY)
                place = np.searchsorted(counts[0], pair)
                total, top = counts[1][place], counts[1][place] == counts[2][place]
                sums = np.zeros((2, int(doc.max()) + 1), np.int64)
                np.add.at(sums[0], doc, n * np.repeat(top, many))
                np.add.at(sums[1], doc, n.astype(np.int64) * np.repeat(total, many))
                docs = np.unique(doc)
                chunk.append(at)
                out.append(packed(docs, sums[0][docs], sums[1][docs]))
            if chunk:
                yield pa.record_batch([pa.array(chunk, pa.int64()), pa.array(out, pa.binary())], ["chunk", "shares"])

    empty = F.lit(None).cast("binary")
    both = totals.select("radix", "split", F.lit(None).cast("long").alias("chunk"), F.col("counts").alias("heads"), empty.alias("body")).unionByName(rows.select("radix", "split", "chunk", "heads", "body"))
    return both.repartition("radix", "split").sortWithinPartitions("radix", "split", F.col("chunk").asc_nulls_first()).mapInArrow(run, "chunk long, shares binary")


def together(docs: pa.Table, given: pa.Table) -> pa.Table:
    """A chunk's documents with the sums of their shares."""
    sums = np.zeros((2, docs.num_rows), np.int64)
    for raw in given.column("shares").to_pylist():
        doc, best, total = unpacked(raw, *SHARES)
        sums[0][doc] += best
        sums[1][doc] += total
    at = docs.column("doc").to_numpy()
    docs = docs.append_column("n_best", pa.array(sums[0][at])).append_column("count_sum", pa.array(sums[1][at]))
    return docs.select(["id", *MEASURES])


MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def alignment(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """One row per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    n_a = len(aligner(a_path, b_path).a_bytes)
    found = cut(encoded(df, a_path, b_path, id_col, text_col, limits))
    own = found.where("radix IS NOT NULL").select("radix", "chunk", "n", "heads", "body")
    sizes = own.groupBy("radix").agg(F.ceil(F.sum("n") / limits.split).alias("n_splits"))  # a row for each radix
    own = own.join(F.broadcast(sizes), "radix").withColumn("split", F.pmod(F.hash("chunk"), F.col("n_splits")))
    totals = cut(count(count(own, ["radix", "split"], n_a, limits.row), ["radix"], n_a, limits.row))
    totals = totals.join(F.broadcast(sizes), "radix").select("radix", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_splits") - 1)).alias("split"), "counts")
    docs = found.where("doc IS NOT NULL").select("chunk", "doc", "id", *[c for c in MEASURES if c not in ("n_best", "count_sum")])
    kind = dict(docs.dtypes)["id"]
    schema = f"id {kind}, " + ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in MEASURES)
    given = shares(own.withColumn("split", F.col("split").cast("long")), totals)
    return docs.groupBy("chunk").cogroup(given.groupBy("chunk")).applyInArrow(together, schema).withColumnRenamed("id", id_col)


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"), model_path(A_MODEL), model_path(B_MODEL))
