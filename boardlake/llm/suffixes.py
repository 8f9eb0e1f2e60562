"""Suffix arrays by linear grouping.

Suffixes are grouped by their longest Lyndon prefix. Groups are taken in descending order; each
member points to the nearest smaller suffix before it, and a suffix pointed to has its prefix
extended by the group's, so it moves to a new group right behind its own, the further the more
members point to it. The groups then give the order: suffixes are emitted from the smallest on,
each one releasing those whose Lyndon prefix ends before it. Nothing is renamed or sorted again.
"""

from __future__ import annotations

import numpy as np


def _groups(text: list[int]) -> tuple[list[int], list[int]]:
    """(group of each suffix as the place of the group's first suffix, previous smaller suffix)."""
    n = len(text)
    order = np.argsort(np.asarray(text), kind="stable").tolist()
    place = [0] * n
    group = [0] * n
    end = [0] * n  # by group: one past its last place
    first = 0
    for r, i in enumerate(order):
        place[i] = r
        if text[i] != text[order[first]]:
            end[first] = r
            first = r
        group[i] = first
    end[first] = n
    prev = [-1] * n
    top = n
    while top > 0:
        g = group[order[top - 1]]
        members = order[g:top]
        if len(members) > 1:
            members.sort()
        pointed: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        top = g
        if len(pointed) == 1:
            (p, _), = pointed.items()
            todo = [(group[p], 0, p)]
        else:
            todo = sorted([(group[p], -k, p) for p, k in pointed.items()])
        at = 0
        while at < len(todo):
            h, k, _ = todo[at]
            to = at
            last = end[h]
            new = last
            while to < len(todo) and todo[to][0] == h and todo[to][1] == k:
                p = todo[to][2]
                new -= 1
                q = place[p]
                other = order[new]
                order[new], order[q] = p, other
                place[p], place[other] = new, q
                to += 1
            if new > h:  # else all of the group moved and it stays where it is
                end[h] = new
                end[new] = last
                for x in range(at, to):
                    group[todo[x][2]] = new
            at = to
    return group, prev


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a sequence of non-negative integers; a suffix comes before those it begins."""
    symbols = (np.asarray(text, dtype=np.int64) + 1).tolist()
    symbols.append(0)
    group, prev = _groups(symbols)
    n = len(symbols)
    out = [-1] * n
    free = list(range(n))
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for r in range(n):
        j = out[r] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            q = free[g]
            free[g] = q + 1
            out[q] = j
            placed[j] = 1
            j = prev[j]
    return np.array(out[1:], dtype=np.int64)
