"""Suffix arrays by grouping on Lyndon prefixes (linear construction after Baier, 2016).

Suffixes with the same first symbol make a group. Groups are taken from the greatest down. Every suffix of a group points
to the nearest place to its left whose group is smaller, its previous-smaller pointer; the suffixes pointed to have the
group's prefix behind their own, and are set apart from their old group, right after it, by how often they are pointed to.
When all groups are done, suffixes share a group exactly when their longest Lyndon prefixes agree. A second pass emits
the order: from each suffix placed, the one to its left and those that it points to take the front of their groups.
Nothing is renamed, and no smaller string is solved in between.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """The order of the suffixes of ``text``, whose last symbol must be smaller than all others."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)  # grouped by first symbol
    at, group, size = [0] * n, [0] * n, [0] * n
    start = 0
    for k, i in enumerate(order):
        if k and text[i] != text[order[k - 1]]:
            start = k
        at[i], group[i] = k, start
        size[start] += 1
    before = [-1] * n
    end = n
    while end > 0:
        start = group[order[end - 1]]
        members = order[start:end] if end - start == 1 else sorted(order[start:end])
        times: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = before[j]
            before[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        if len(times) == 1:
            levels = [list(times)]
        elif not times:
            levels = []
        elif max(times.values()) == 1:
            levels = [list(times)]
        else:
            by: dict[int, list[int]] = {}
            for j, k in times.items():
                by.setdefault(k, []).append(j)
            levels = [by[k] for k in sorted(by, reverse=True)]
        for level in levels:  # those pointed to most often go farthest up
            moved: dict[int, int] = {}
            for j in level:
                g = group[j]
                done = moved.get(g, 0)
                to = g + size[g] - 1 - done
                here, other = at[j], order[to]
                order[here], order[to] = other, j
                at[other], at[j] = here, to
                moved[g] = done + 1
            for j in level:
                g = group[j]
                if (k := moved.get(g)) is not None and k < size[g]:
                    group[j] = g + size[g] - k
            for g, k in moved.items():
                if k < size[g]:
                    size[g + size[g] - k] = k
                    size[g] -= k
        end = start
    out, front, placed = [-1] * n, list(range(n)), bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    front[group[n - 1]] += 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[front[g]] = j
            front[g] += 1
            placed[j] = 1
            j = before[j]
    return out
