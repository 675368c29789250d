"""Anchors: places in texts that depend only on the bytes around them.

A window of ``WINDOW`` bytes has the ``GRAM``-byte string of smallest hash among those within it as its anchor, the first
of equals. Equal windows thus have their anchors at the same place, and all anchors together are about one in 85 bytes.
An anchor's context is what the windows that may have chosen it cover: ``LEFT`` bytes before it to ``WINDOW`` after.
"""

from __future__ import annotations

import numpy as np

from orderlake.llm.shingles import BYTES, mix, powers

WINDOW, GRAM = 200, 32
LEFT = WINDOW - GRAM
OTHER = mix(BYTES)
#: Windows looked at together, and the bits of a place among their strings; the other bits are the hash's.
BLOCK, PLACE = 1 << 22, np.uint64((1 << 23) - 1)


def sums(raw: np.ndarray, values: np.ndarray) -> np.ndarray:
    up, _ = powers(len(raw) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[raw] * up[: len(raw)], dtype=np.uint64)])


def spans(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of raw[start:end], from its running sums."""
    _, down = powers(len(total))
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text index, place in the text, hash of the anchor's string, hash of its context, in order of place."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    none = np.zeros(0, np.int64)
    if len(raw) < WINDOW:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    total = sums(raw, BYTES)
    at = np.arange(len(raw) - GRAM + 1)
    gram = spans(total, at, at + GRAM)
    n, found = len(raw) - WINDOW + 1, []
    for s in range(0, n, BLOCK):  # windows that start in a block
        e = min(s + BLOCK, n)
        low = gram[s : e + LEFT]
        # the upper bits of the hash, then the place in the block: the least is the first of the smallest
        low = (low & ~PLACE) | np.arange(len(low), dtype=np.uint64)
        width = 1
        while 2 * width <= LEFT + 1:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < LEFT + 1:
            low = np.minimum(low[: len(low) - (LEFT + 1 - width)], low[LEFT + 1 - width :])
        starts = np.arange(s, e)
        whole = starts + WINDOW <= ends[np.searchsorted(ends, starts, side="right")]
        found.append(s + (low[whole] & PLACE).astype(np.int64))
    chosen = np.concatenate(found)
    chosen = chosen[np.concatenate([[True], chosen[1:] != chosen[:-1]])] if len(chosen) else chosen
    owner = np.searchsorted(ends, chosen, side="right")
    begin, end = (ends - [len(t) for t in texts])[owner], ends[owner]
    a, b = np.maximum(begin, chosen - LEFT), np.minimum(end, chosen + WINDOW)
    around = spans(sums(raw, OTHER), a, b) ^ mix((chosen - a).astype(np.uint64))
    return owner, chosen - begin, gram[chosen], around
