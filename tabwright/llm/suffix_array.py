"""Suffix arrays by linear grouping.

First all suffixes are grouped by the longest Lyndon word that they begin with. Groups are processed in descending
order; each suffix of a group points to the nearest one before it that lies in a lower group, and those pointed to
move to new groups just above their old one, further up the more pointers they got: their Lyndon prefix has grown by
that many words of the processed group. Then the order within groups is emitted from the smallest suffix on: each
suffix that is placed lets its predecessor, and those along its pointers, take the first free place of their groups.
Nothing is renamed or sorted recursively. Members of a group are brought into the order of the text before it is processed;
they come in few ascending runs, which Python's sort merges in linear time.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Start positions of the suffixes of ``text`` in ascending order; its last symbol must be its only smallest one."""
    n = len(text)
    symbols = sorted(set(text))
    rank = {c: g for g, c in enumerate(symbols)}
    group = [rank[c] for c in text]  # the group of each suffix
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    lower = list(range(-1, len(symbols) - 1))  # next lower group of each, -1 below the lowest
    above = [*range(1, len(symbols)), -1]
    pointer = [-2] * n  # -2: the suffix's group hasn't been processed
    g = len(symbols) - 1
    while g >= 0:
        own = sorted(i for i in members[g] if group[i] == g)
        counts: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and (k := pointer[j]) != -2:
                j = k
            pointer[i] = j
            if j >= 0:
                counts[j] = counts.get(j, 0) + 1
        if counts:
            moved: dict[tuple[int, int], list[int]] = {}
            for j, count in counts.items():
                key = (count, group[j])
                if key in moved:
                    moved[key].append(j)
                else:
                    moved[key] = [j]
            for count, old in sorted(moved, reverse=True) if len(moved) > 1 else moved:
                js = moved[count, old]
                new = len(members)
                members.append(js)
                for j in js:
                    group[j] = new
                up = above[old]
                lower.append(old)
                above.append(up)
                above[old] = new
                if up >= 0:
                    lower[up] = new
        members[g] = own
        g = lower[g]
    free, at, g = [0] * len(members), 0, rank[symbols[0]]
    while g >= 0:
        free[g] = at
        at += len(members[g])
        g = above[g]
    out = [-1] * n
    out[0] = n - 1
    free[group[n - 1]] += 1
    placed = [False] * n
    placed[n - 1] = True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = pointer[j]
    return out
