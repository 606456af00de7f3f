"""Suffix sorting by grouping Lyndon prefixes, without renaming. All steps take linear time but for the first sort of the symbols and the
sorting of each group's positions, which come in a few ascending runs.

Suffixes are first grouped by their first symbol. Groups are processed in descending order; when a group is
processed, all its suffixes start with the same Lyndon word u. A suffix's previous smaller pointer leads to the
nearest position on its left that is in a lower group. If k suffixes of the group point to position j, then
j's own Lyndon prefix is followed by u, k times, and so is extended by it: j moves to a new group just above its old one, above
those that were extended by fewer u. At the end each group holds the suffixes with one longest Lyndon prefix.

Then the order inside the groups is emitted in one ascending sweep: the rank of a suffix in its group is decided by
the suffix that follows its Lyndon prefix, the next smaller one; as the sweep reaches a suffix, all those that it
follows, found by going back along the pointers, take the next free place of their groups.
"""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of s (non-negative integers) in ascending order; a prefix sorts before what it starts."""
    n = len(s)
    if n == 0:
        return np.empty(0, np.int64)
    order = np.argsort(s, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(s[order]) != 0]).tolist()
    members: list[list[int]] = [order[a:b].tolist() for a, b in zip(cut, [*cut[1:], n], strict=True)]
    below = list(range(-1, len(members) - 1))  # each group's next lower one, -1 below the lowest
    above = [*range(1, len(members)), 1 << 62]
    group = np.empty(n, np.int64)
    for g, m in enumerate(members):
        group[m] = g
    group = group.tolist()
    done, pointer = bytearray(n + 1), [-1] * n
    top, final = len(members) - 1, []
    size: list[int] = [len(m) for m in members]  # members of a group that still belong to it
    while top >= 0:
        if not size[top]:
            top = below[top]
            continue
        own = members[top] if size[top] == len(members[top]) else [i for i in members[top] if group[i] == top]
        own.sort()
        final.append(own)
        for i in own:
            done[i] = 1
        times: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and done[j]:
                j = pointer[j]
            pointer[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        if times:
            moved: dict[int, list[int]] = {}
            if len(times) == 1:
                ((j, _),) = times.items()
                old = group[j]
                if size[old] > 1:  # alone in its group, it need not move
                    moved[old] = [j]
                ranked = {old: [[j]]} if moved else {}
            else:
                for j in times:
                    moved.setdefault(group[j], []).append(j)
                ranked = {}
                for old, js in moved.items():
                    if len(js) == 1:
                        if size[old] > 1:
                            ranked[old] = [js]
                        continue
                    by: dict[int, list[int]] = {}
                    for j in js:
                        by.setdefault(times[j], []).append(j)
                    levels = [by[k] for k in sorted(by)]
                    if len(js) == size[old]:
                        levels = levels[1:]  # the least extended ones keep the group
                    if levels:
                        ranked[old] = levels
            for old, levels in ranked.items():
                # New groups go between the old one and what lay above it, those extended oftener on top.
                lower, upper = old, above[old]
                for level in levels:
                    new = len(members)
                    members.append(level)
                    below.append(lower)
                    above.append(upper)
                    above[lower] = new
                    size.append(len(level))
                    size[old] -= len(level)
                    for j in level:
                        group[j] = new
                    lower = new
                if upper < len(below):
                    below[upper] = lower
        top = below[top]
    return _emit(final[::-1], pointer, n)


def _emit(groups: list[list[int]], pointer: list[int], n: int) -> np.ndarray:
    """The order of all suffixes, from the groups in ascending order."""
    free, own, at = [0] * n, [0] * n, 0  # own: the group of a suffix, named by its first place
    for members in groups:
        for i in members:
            own[i] = at
        free[at] = at
        at += len(members)
    order, placed = [-1] * n, bytearray(n)
    i = n  # the end of the text is the smallest suffix
    for r in range(-1, n):
        if r >= 0:
            i = order[r]
        j = i - 1
        while j >= 0 and not placed[j]:
            g = own[j]
            order[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = pointer[j]
    return np.array(order)
