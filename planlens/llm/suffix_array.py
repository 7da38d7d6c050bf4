"""Suffix arrays by linear grouping.

Suffixes are grouped by their Lyndon prefix. Groups start as first symbols and are processed from the highest to the
lowest; a group's members lengthen the Lyndon prefixes of their previous smaller suffixes, which leave their group for a
new one right behind it. Once all groups stand in order, each suffix found in order (from the least on) tells the next
place, in their groups, of the suffixes whose Lyndon prefix ends where it begins. Nothing is renamed or recursed.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Places of the suffixes of symbols (integers of 0 and more) in ascending order."""
    n = len(symbols) + 1  # with an end below all symbols
    if n == 1:
        return np.zeros(0, np.int64)
    s = np.append(np.asarray(symbols, np.int64) + 1, 0)
    order = np.argsort(s, kind="stable")
    new = np.concatenate([[True], s[order][1:] != s[order][:-1]])
    starts = np.flatnonzero(new)
    group_at = np.empty(n, np.int64)
    group_at[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    sizes = np.zeros(n, np.int64)
    sizes[starts] = np.diff(np.append(starts, n))
    sa, group, at, size = order.tolist(), group_at.tolist(), place.tolist(), sizes.tolist()
    prev = [-1] * n
    end = n
    while end > 0:
        g = group[sa[end - 1]]
        members = sa[g:end]
        if len(members) > 1:
            members.sort()
        end = g
        hits: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                hits[p] = hits.get(p, 0) + 1
        if not hits:
            continue
        most = max(hits.values())
        if most == 1:
            rounds = [list(hits)]
        else:
            rounds = [[] for _ in range(most)]
            for p, k in hits.items():
                rounds[most - k].append(p)
        for some in rounds:  # those lengthened most often go first, and so end up furthest behind
            moved: dict[int, int] = {}
            for p in some:
                k = group[p]
                m = moved.get(k, 0) + 1
                moved[k] = m
                to, was = k + size[k] - m, at[p]
                if to != was:
                    q = sa[to]
                    sa[to], sa[was] = p, q
                    at[p], at[q] = to, was
            for k, m in moved.items():
                if m < size[k]:
                    size[k] -= m
                    first = k + size[k]
                    size[first] = m
                    for x in range(first, first + m):
                        group[sa[x]] = first
    out = [-1] * n
    free = list(range(n))  # the next free place of the group that starts there
    placed = bytearray(n)
    out[0], placed[n - 1] = n - 1, 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = prev[j]
    return np.array(out[1:], np.int64)
