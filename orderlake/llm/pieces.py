"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A word's symbols are its characters; its agenda holds the adjacent pairs whose concatenation is a piece, best score
first and leftmost among equals. The best pair is merged, which gives at most two new pairs in place of its neighbours'. The
agendas of all new words of a slice are rows of arrays and are worked off together, one entry of each in a round; very long
words, and those with characters that are no pieces, have a heap each. What is no piece at the end is written as its
UTF-8 bytes.

No piece of the vocabulary reaches over the start of a space mark, and none holds a character of its own kind such as
the newline beside another, so a text falls into words that merge independently; ``Pieces`` derives these rules from
the vocabulary. The ids of short words are remembered in a memory of bounded size. In each slice of a batch all words that
were new to it are checked against the sentencepiece library, as is one whole text; where they disagree the library's
ids are taken and ``n_corrected`` counts them.

Defined results: a null text counts as empty and has the begin and end ids alone; repeated rows are encoded alike, each
on its own; further columns are ignored by ``encode``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from orderlake.llm.common import table
from orderlake.llm.vocabulary import Memory, Words, chunks

SPACE = "▁"
#: Words of each of two generations, about 140 bytes each.
REMEMBERED, LONGEST = 180_000, 40
#: Words of up to so many characters share arrays.
WIDTHS = (8, 12, 16, 24, 40)
MODEL = "piece_bpe_32k.model"


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = [(sp.id_to_piece(i), i) for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i))]
        self.ids = dict(kinds)
        self.score = {p: sp.get_score(i) for p, i in kinds}
        self.bytes = {b: sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        long = [p for p, _ in kinds if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in long):
            self.split = re.compile(r"(?s).+")
        elif any("\n" in p for p in long):
            self.split = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        else:  # a newline joins nothing
            self.split = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
        #: Words are told by spaces and newlines.
        self.plain = "[^" in self.split.pattern and self.split.pattern.endswith("|\n")
        self.char = np.full(0x110000, -1, np.int32)
        for x, i in kinds:
            if len(x) == 1:
                self.char[ord(x)] = i
        self.size = sp.get_piece_size()
        pairs = {self.ids[x[:i]] * self.size + self.ids[x[i:]]: x for x in long for i in range(1, len(x)) if x[:i] in self.ids and x[i:] in self.ids}
        self.pair = np.array(sorted(pairs), np.int64)
        self.merged = np.array([self.ids[pairs[k]] for k in self.pair.tolist()], np.int32)
        self.merit = np.array([self.score[pairs[k]] for k in self.pair.tolist()], np.float32)
        self.width = 2 if sp.get_piece_size() <= 65_536 else 4
        self.known = Memory(REMEMBERED, LONGEST)

    def agenda(self, text: str) -> list[int]:
        """The ids of one word's symbols, by a heap; none of no symbol."""
        if not text:
            return []
        score, sym, n = self.score, list(text), len(text)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        right[-1] = -1
        heap = [(-s, i, i + 1, sym[i] + sym[i + 1]) for i in range(n - 1) if (s := score.get(sym[i] + sym[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j, piece = heapq.heappop(heap)
            if right[i] != j or sym[i] + sym[j] != piece:  # one of them was merged meanwhile
                continue
            sym[i], sym[j], k = piece, "", right[j]
            right[i], right[j] = k, -2
            if k >= 0:
                left[k] = i
                if (s := score.get(new := piece + sym[k])) is not None:
                    heapq.heappush(heap, (-s, i, k, new))
            if (h := left[i]) >= 0 and (s := score.get(new := sym[h] + piece)) is not None:
                heapq.heappush(heap, (-s, h, i, new))
        out: list[int] = []
        for p in sym:
            if p:
                if (x := self.ids.get(p)) is not None:
                    out.append(x)
                else:
                    out += [self.bytes[b] for b in p.encode("utf-8")]
        return out

    def offers(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of symbols: the score of their piece, or minus infinity, and the piece."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        good = (self.pair[at] == key) & (left >= 0) & (right >= 0)
        return np.where(good, self.merit[at], -np.inf).astype(np.float32), self.merged[at]

    def agendas(self, words: list[str]) -> list[bytes]:
        """The packed ids of each word: its agenda is a row of scores, whose best entry is taken in each round."""
        symbols = [w if w[:1] in (SPACE, "\n") and self.plain else SPACE + w if self.plain else w for w in words]
        size = np.array([len(x) for x in symbols])
        code = self.char[np.frombuffer("".join(symbols).encode("utf-32-le", "surrogatepass"), "<u4")]
        begin = np.cumsum(size) - size
        out: list[bytes] = [b""] * len(words)
        strange = np.add.reduceat(code < 0, begin) > 0 if len(code) else np.zeros(0, bool)
        low = 0
        for width in WIDTHS:
            rows = np.flatnonzero((size > low) & (size <= width) & ~strange)
            low = width
            if not len(rows):
                continue
            n = size[rows]
            sym = np.full((len(rows), width + 1), -1, np.int32)
            inside = np.arange(width + 1) < n[:, None]
            sym[inside] = code[np.repeat(begin[rows], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
            score, piece = self.offers(sym[:, :-1], sym[:, 1:])
            live, column = np.arange(len(rows)), np.arange(width + 1)
            done = np.full((len(rows), width), -1, np.int32)
            while len(live):
                best = score.argmax(1)
                r = np.arange(len(live))
                ends = score[r, best] == -np.inf
                if ends.any():
                    done[live[ends]] = sym[ends, :width]
                    keep = ~ends
                    live, sym, score, piece, best = live[keep], sym[keep], score[keep], piece[keep], best[keep]
                    r = np.arange(len(live))
                    if not len(live):
                        break
                sym[r, best] = piece[r, best]
                after = np.minimum(column + (column > best[:, None]), width)  # the right symbol goes, the rest moves up
                sym = np.take_along_axis(sym, after, 1)
                sym[:, width] = -1
                shift = np.minimum(column[:-1] + (column[:-1] > best[:, None]), width - 1)
                score, piece = np.take_along_axis(score, shift, 1), np.take_along_axis(piece, shift, 1)
                score[:, width - 1] = -np.inf
                for at in (best, best - 1):
                    ok = np.flatnonzero((at >= 0) & (at < width))
                    score[ok, at[ok]], piece[ok, at[ok]] = self.offers(sym[ok, at[ok]], sym[ok, at[ok] + 1])
            has = done >= 0
            packed = done[has].astype("<u2" if self.width == 2 else "<u4").tobytes()
            ends = np.cumsum(has.sum(1)) * self.width
            for i, a, b in zip(rows.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                out[i] = packed[a:b]
        for i in np.flatnonzero((size > low) | strange).tolist():
            out[i] = self.packed(self.agenda(symbols[i]))
        return out

    def words(self, texts: pa.Array) -> Words:
        """Each text's words: ``x`` stands for a space mark and x, a newline and x for both; what begins with a space mark is
        written out."""
        odd = pc.match_substring_regex(texts, f"  |^ |{SPACE}")
        if self.plain and not pc.any(odd).as_py():
            lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
            if pc.any(pc.equal(pc.binary_length(texts), 0)).as_py():
                lists = pa.array([x if t else [] for t, x in zip(texts.to_pylist(), lists.to_pylist(), strict=True)], pa.list_(pa.string()))
            return Words(lists)
        return Words(pa.array([self.segments(t) for t in texts.to_pylist()], pa.list_(pa.string())))

    def segments(self, text: str) -> list[str]:
        out: list[str] = []
        for s in self.split.findall(SPACE + text.replace(" ", SPACE)) if text else []:
            if not self.plain or s.startswith(SPACE * 2) or s == "\n":
                out.append(s)
            elif s[0] == SPACE:
                out.append(s[1:])
            else:
                out[-1] += s
        return out

    def packed(self, ids: list[int]) -> bytes:
        return array("H" if self.width == 2 else "I", ids).tobytes()

    def library(self, words: list[str]) -> list[list[int]]:
        """The library's ids of each word. It puts a space mark before every text: a word that begins with one
        gives it up; a word that begins with a newline follows another one, whose ids go again."""
        line = [self.plain and w[:1] == "\n" for w in words]
        got = self.sp.encode(["\n" + w if x else w.removeprefix(SPACE).replace(SPACE, " ") for w, x in zip(words, line, strict=True)], num_threads=1)
        at = len(self.sp.encode("\n"))
        return [g[at:] if x else g if w not in ("", SPACE) else self.agenda(SPACE) for w, g, x in zip(words, got, line, strict=True)]

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """The 32-bit ids of all texts without begin and end, where each text begins and the last ends, and how many were
        corrected. What the agenda makes is what is written, unless the library differs."""
        corrected: dict[str, int] = {}

        def make(new: list[str]) -> dict[str, bytes]:
            made: dict[str, bytes] = {}
            for at in range(0, len(new), 4096):
                some = new[at : at + 4096]
                for w, ours, theirs in zip(some, self.agendas(some), map(self.packed, self.library(some)), strict=True):
                    if ours != theirs:
                        ours, corrected[w] = theirs, 1
                    made[w] = ours
            return made

        words = self.words(texts)
        ids, ends = words.put_together(self.known.all(words.distinct, make), self.width)
        n = [0] * len(texts)
        if corrected:
            wrong = np.array([corrected.get(w, 0) for w in words.distinct])[words.code]
            n = np.diff(np.concatenate([[0], np.cumsum(wrong)])[words.ends]).tolist()
        if len(texts):  # one whole text, the shortest that isn't trivial
            size = pc.utf8_length(texts).to_pylist()
            i = min(range(len(texts)), key=lambda i: (size[i] < 20, size[i]))
            whole = np.array(self.sp.encode(texts[i].as_py(), num_threads=1), "<u4")
            if not np.array_equal(whole, ids[ends[i] : ends[i + 1]]):
                n[i] += 1
                ids = np.concatenate([ids[: ends[i]], whole, ids[ends[i + 1] :]])
                ends = np.concatenate([ends[: i + 1], ends[i + 1 :] + len(whole) - (ends[i + 1] - ends[i])])
        return ids, ends, n

    def with_ends(self, ids: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Each text's ids with begin and end."""
        begin, end = np.array([self.bos], "<u4"), np.array([self.eos], "<u4")
        return [np.concatenate([begin, ids[a:b], end]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One for each worker process, kept over its tasks."""
    return Pieces(path)


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (binary, little-endian 32-bit, with begin and end), n_corrected."""
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for batch in batches:
            for part in chunks(batch, "t", 1_500_000):
                ids, ends, corrected = p.encode_batch(part.column("t"))
                yield pa.record_batch([part.column(0), pa.array([x.tobytes() for x in p.with_ends(ids, ends)], pa.binary()), pa.array(corrected, pa.int32())], [id_col, "ids", "n_corrected"])

    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, ids binary, n_corrected int")


def decode(df: DataFrame, model: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The frame with the library's decoding of its ids; null ids give null."""
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = pieces(model).sp
        for batch in batches:
            for part in chunks(batch, ids_col, 4_000_000):
                text = [None if x is None else sp.decode(np.frombuffer(x, "<u4").tolist()) for x in part.column(ids_col).to_pylist()]
                yield pa.record_batch([*part.columns, pa.array(text, pa.string())], [*part.schema.names, out_col])

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256, n_corrected: encoded, decoded and digested in one pass, so that
    neither ids nor texts leave the task."""
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for part in chunks(batch, "t", 1_500_000):
                flat, ends, corrected = p.encode_batch(part.column("t"))
                ids = p.with_ends(flat, ends)
                decoded = [sha(p.sp.decode(x.tolist()).encode("utf-8")) for x in ids]
                yield pa.record_batch([part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(x.tobytes()) for x in ids], pa.string()), pa.array(decoded, pa.string()), pa.array(corrected, pa.int32())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "n_corrected"])

    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_corrected int")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), model_path())
