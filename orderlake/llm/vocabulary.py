"""What tasks on texts share: slices of batches, giving memory back, the distinct words of a slice and what was made of them."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


class Words:
    """Lists of words, one list for a text, as numbers of distinct words."""

    def __init__(self, lists: pa.ListArray):
        flat = lists.flatten().dictionary_encode()
        self.code = flat.indices.to_numpy(zero_copy_only=False)
        self.distinct: list[str] = flat.dictionary.to_pylist()
        self.ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])

    def put_together(self, ids: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, and where each text begins and the last ends. ids: of each distinct word,
        little-endian, ``width`` bytes each."""
        flat = np.frombuffer(b"".join(ids), f"<u{width}")
        n = np.array([len(x) // width for x in ids], np.int64)
        start = np.cumsum(n) - n
        each = n[self.code]
        end = np.cumsum(each)
        out = flat[np.repeat(start[self.code] - (end - each), each) + np.arange(int(end[-1]) if len(end) else 0)]
        return out.astype("<u4"), np.concatenate([[0], end])[self.ends]


class Memory:
    """What was made of the words met last: two generations, of which the older one is dropped when the younger is full, so
    that words in use stay and the size is bounded."""

    def __init__(self, most: int, longest: int):
        self.most, self.longest = most, longest
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, word: str) -> bytes | None:
        if (x := self.young.get(word)) is None and (x := self.old.get(word)) is not None:
            self.young[word] = x
        return x

    def put(self, word: str, ids: bytes) -> None:
        if len(word) <= self.longest:
            self.young[word] = ids

    def all(self, words: list[str], make: Callable[[list[str]], dict[str, bytes]]) -> list[bytes]:
        """Of each word; ``make`` is asked for all that aren't known, at once."""
        young, old = self.young, self.old
        out = [young.get(w) for w in words]
        new = []
        for i, x in enumerate(out):
            if x is None:
                if (x := old.get(words[i])) is not None:
                    out[i] = young[words[i]] = x
                else:
                    new.append(i)
        if new:
            made = make([words[i] for i in new])
            for i in new:
                out[i] = made[words[i]]
                self.put(words[i], out[i])
        if len(young) > self.most:
            self.young, self.old = {}, young
        return out


def tidy() -> None:
    """Give freed memory back to the system, as workers live on beside the next stage's tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def chunks(batch: pa.RecordBatch, column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of about so many bytes of text, so that what a task holds doesn't follow the batch size."""
    if not batch.num_rows:
        return
    texts = batch.column(column)
    at = size = 0
    ends = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32)[texts.offset : texts.offset + batch.num_rows + 1]
    for i, n in enumerate(np.diff(ends).tolist()):
        if size and size + n > most:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n
    yield batch.slice(at)
    del texts, ends
    tidy()
