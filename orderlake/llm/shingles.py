"""Hashed word shingles of many texts at once, in numpy.

A text's words are runs of characters other than white space, with A-Z lower-cased. Each byte stands for a fixed random
64-bit number; a word's hash is the polynomial of its bytes modulo 2**64, taken from running sums, and a shingle's is a
mix of the hashes of its words. A text of fewer words than a shingle has its whole sequence as its one shingle.
"""

from __future__ import annotations

import numpy as np

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}
#: Powers that a worker keeps, 16 bytes each.
KEPT = 1 << 22


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE modulo 2**64 and of its inverse. Those for slices of common size are kept, those for a longer text aren't."""
    if "up" in _powers and len(_powers["up"]) >= n:
        return _powers["up"][:n], _powers["down"][:n]
    made, size = {}, max(n, 1 << 20)
    for name, b in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
        steps = np.full(size, b, np.uint64)
        steps[0] = 1
        made[name] = np.cumprod(steps)
    if size <= KEPT:
        _powers.update(made)
    return made["up"][:n], made["down"][:n]


def sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text, given as UTF-8; null counts as empty."""
    texts = [t or b"" for t in texts]
    raw = np.frombuffer(b"\n".join([*texts, b""]).translate(LOWER), np.uint8)
    inside = ~WHITE[raw]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[raw] * up[: len(raw)], dtype=np.uint64)])
    word = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    first = np.searchsorted(start, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]))
    whole = fold(word, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            x = np.sort(whole[a : b - size + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        else:
            out.append(fold(word[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def fold(word: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` words in a row."""
    n = max(len(word) - size + 1, 0)
    acc = np.full(n, size, np.uint64)
    for i in range(size):
        acc = mix(acc * np.uint64(BASE) + word[i : i + n])
    return acc
