"""Suffix orders of many short strings at once, by linear grouping.

Suffixes whose longest Lyndon prefixes are equal form a group, and groups follow each other
as these prefixes do. Groups are handled from the last to the first: what comes before a
group's suffixes, found by pointers to the previous smaller suffix, grows by the group's
prefix and leaves its own group for one behind it. When every prefix is whole, a pass from
the smallest suffix on puts each suffix at the next place of its group. Nothing is renamed
or sorted again. Each step is done for all strings ("lanes") together, in whole arrays.
"""

from __future__ import annotations

import numpy as np


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All of starts[i] .. starts[i] + sizes[i] - 1, one after another."""
    ends = np.cumsum(sizes)
    out = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    if len(out):
        out[0] = starts[0]
        out[ends[:-1]] = starts[1:] - starts[:-1] - sizes[:-1] + 1
    return np.cumsum(out)


def grouped(symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, previous): the first slot of each suffix's group, and its previous smaller suffix or -1.

    Lane i is symbols[bounds[i]:bounds[i + 1]], of at least one symbol; a lane ends below every symbol.
    """
    n, sizes = len(symbols), np.diff(bounds)
    lane = np.repeat(np.arange(len(sizes)), sizes)
    at = np.lexsort((symbols, lane))  # slot -> suffix, arranged by groups; at first of one symbol
    new = np.ones(n, bool)
    new[1:] = (symbols[at[1:]] != symbols[at[:-1]]) | (lane[at[1:]] != lane[at[:-1]])
    begin = np.flatnonzero(new)
    last = np.zeros(n, np.int64)  # of a group's first slot: its last slot
    last[begin] = np.append(begin[1:], n) - 1
    group, slot = np.empty(n, np.int64), np.empty(n, np.int64)
    group[at], slot[at] = np.repeat(begin, np.diff(np.append(begin, n))), np.arange(n)
    before = np.arange(n) - 1
    before[bounds[:-1]] = -1
    moves, top = np.zeros(n, bool), bounds[1:] - 1
    low = bounds[:-1]
    while len(top):
        first = group[at[top]]
        members = np.sort(at[_ranges(first, top - first + 1)])
        own = group[members]
        prior = before[members]
        open_ = np.flatnonzero(group[prior] > own)  # of -1 a later lane's, which is sorted out next
        open_ = open_[prior[open_] >= 0]
        while len(open_):
            prior[open_] = j = before[prior[open_]]
            open_ = open_[(j >= 0) & (group[j] > own[open_])]
        chain = (prior >= 0) & (group[prior] == own)  # right behind another of its group: has the same previous one
        index = np.arange(len(members))
        index[chain] = 0
        prior = prior[np.maximum.accumulate(index)]
        before[members] = prior
        grow = prior[prior >= 0]
        if len(grow):
            edge = np.flatnonzero(np.concatenate(([True], grow[1:] != grow[:-1])))
            grow, times = grow[edge], np.diff(np.append(edge, len(grow)))
            old = group[grow]
            order = np.argsort(old, kind="stable") if times.max() == 1 else np.lexsort((times, old))
            grow, times, old = grow[order], times[order], old[order]
            edge = np.flatnonzero(np.concatenate(([True], old[1:] != old[:-1])))
            many = np.diff(np.append(edge, len(old)))
            tail = last[old[edge]] - many + 1
            to = _ranges(tail, many)
            # What lies in these slots and stays in its group changes places with what leaves it.
            moves[grow] = True
            there = at[to]
            stay = there[~moves[there]]
            moves[grow] = False
            left = slot[grow]
            left = left[left < np.repeat(tail, many)]
            at[to], slot[grow] = grow, to
            at[left], slot[stay] = stay, left
            last[old[edge]] -= many
            edge = np.flatnonzero(np.concatenate(([True], (old[1:] != old[:-1]) | (times[1:] != times[:-1]))))
            many = np.diff(np.append(edge, len(old)))
            group[grow] = np.repeat(to[edge], many)
            last[to[edge]] = to[edge] + many - 1
        top = first - 1
        more = top >= low
        top, low = top[more], low[more]
    return group, before


def suffix_orders(symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Slots bounds[i] .. bounds[i + 1] - 1 hold the suffixes of lane i in ascending order, as indices of ``symbols``."""
    if not len(symbols):
        return np.zeros(0, np.int64)
    group, before = grouped(symbols, bounds)
    free, put = np.arange(len(symbols)), np.zeros(len(symbols), bool)  # by a group's first slot: where its next suffix goes
    out = np.full(len(symbols), -1)
    left = np.arange(len(symbols)) - 1
    left[bounds[:-1]] = -1
    read, stop = bounds[:-1].copy(), bounds[1:]
    now = bounds[1:] - 1  # what stands before the end, the smallest suffix
    while len(now):
        go = now >= 0
        go[go] = ~put[now[go]]
        s = now[go]
        g = group[s]
        where = free[g]
        out[where], put[s] = s, True
        free[g] = where + 1
        now[go] = before[s]
        rest = np.flatnonzero(~go)  # the chain has ended: on to the next smallest
        more = read[rest] < stop[rest]
        now[rest[more]] = left[out[read[rest[more]]]]
        read[rest[more]] += 1
        if not more.all():
            keep = np.ones(len(now), bool)
            keep[rest[~more]] = False
            now, read, stop = now[keep], read[keep], stop[keep]
    return out
