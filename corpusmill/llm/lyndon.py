"""Suffix sorting by Lyndon grouping, for many small texts at once.

The construction is linear: suffixes are grouped by their first symbol; groups
are then taken in descending order. For each suffix of the group the previous
suffix in a smaller group is found through the pointers of the suffixes between
them; those previous suffixes move to a new group behind the rest of their own,
by how many pointers meet in them. When all groups are done, suffixes with the
same longest Lyndon prefix form a group, in order. The second phase takes the
groups upwards and emits each by the place of the next smaller suffix of its
members. Nothing is renamed or sorted again at a finer level.

The texts advance together: one numpy step handles the current group of every
text, so the cost of a step is shared by thousands of them.
"""

from __future__ import annotations

import numpy as np

from corpusmill.llm.windows import flat_ranges


def suffix_order(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix array of each text.

    ``symbols``: texts one after the other, each closed by a 0 that occurs
    nowhere else in it; ``ends``: the places of those zeros. Returned are all
    places, text by text, each text's suffixes in order (its 0 first).
    """
    n, firsts = len(symbols), np.concatenate(([0], ends[:-1] + 1))
    text = np.repeat(np.arange(len(ends)), ends - firsts + 1)
    closing = np.zeros(n + 1, bool)  # place n stands before the first text
    closing[ends] = closing[n] = True

    # groups by first symbol; a group is known by its first place in the order
    key = text * (int(symbols.max()) + 1) + symbols
    order = np.argsort(key, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1], [True])))
    group, end_of = np.full(n + 1, -1, np.int64), np.zeros(n + 1, np.int64)
    group[order] = np.repeat(edge[:-1], np.diff(edge))
    end_of[edge[:-1]] = edge[1:]
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = np.arange(-1, n, dtype=np.int64)
    before[0] = n
    marked = np.zeros(n + 1, bool)

    current = group[order[ends]]  # each text's last, that is greatest, group
    low = firsts  # its zero's place in the order
    while len(current):
        many = end_of[current] - current
        member = order[flat_ranges(current, many)]
        own = group[member]
        asked = np.arange(len(member))
        while len(asked):
            to = before[member[asked]]
            asked, to = (x[group[to] >= own[asked]] for x in (asked, to))
            before[member[asked]] = before[to]
        target = before[member]
        target = target[~closing[target]]
        if len(target):
            target, hits = np.unique(target, return_counts=True)
            g = group[target]
            by = np.lexsort((hits, g))
            target, hits, g = target[by], hits[by], g[by]
            fresh = np.concatenate(([True], g[1:] != g[:-1]))
            at = np.flatnonzero(fresh)
            count = np.diff(np.append(at, len(g)))
            tail = end_of[g[at]] - count
            slots = flat_ranges(tail, count)
            marked[target] = True
            there, was = order[slots], place[target]
            out, free = there[~marked[there]], was[was < np.repeat(tail, count)]
            order[free], place[out] = out, free
            order[slots], place[target] = target, slots
            marked[target] = False
            part = np.flatnonzero(fresh | np.concatenate(([True], hits[1:] != hits[:-1])))
            sizes = np.diff(np.append(part, len(g)))
            end_of[g[at]] = tail
            end_of[slots[part]] = slots[part] + sizes
            group[target] = np.repeat(slots[part], sizes)
        going = current - 1 > low
        current, low = group[order[current[going] - 1]], low[going]

    return _emit(order, group, end_of, text, ~closing[:n])


def _emit(order: np.ndarray, group: np.ndarray, end_of: np.ndarray, text: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Orders the members of each group by the place of their next smaller suffix."""
    n = len(order)
    group = group[:n]
    smaller = np.minimum(np.arange(1, n + 1), n - 1)
    asked = np.flatnonzero((group[smaller] > group) & inside)
    while len(asked):
        smaller[asked] = smaller[smaller[asked]]
        asked = asked[group[smaller[asked]] > group[asked]]

    starts = np.unique(group)
    many = end_of[starts] - starts
    final = np.full(n, -1, np.int64)
    single = starts[many == 1]
    final[order[single]] = single
    starts, many = starts[many > 1], many[many > 1]
    if len(starts):
        owner = text[order[starts]]
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        turn = np.arange(len(starts)) - np.repeat(first, np.diff(np.append(first, len(starts))))
        by = np.argsort(turn, kind="stable")
        cuts = np.searchsorted(turn[by], np.arange(int(turn.max()) + 2))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            now = by[a:b]
            member = order[flat_ranges(starts[now], many[now])]
            turn_of = np.repeat(np.arange(len(now)), many[now])  # which of these groups
            filled = starts[now].copy()
            while len(member):
                rank = final[smaller[member]]
                known = rank >= 0
                ready, which = member[known], turn_of[known]
                line = np.lexsort((rank[known], which))
                ready, which = ready[line], which[line]
                done = np.bincount(which, minlength=len(now))
                final[ready] = flat_ranges(filled, done)
                # a member whose next smaller suffix is in its own group comes behind
                filled += done
                member, turn_of = member[~known], turn_of[~known]
    out = np.empty(n, np.int64)
    out[final] = np.arange(n)
    return out

