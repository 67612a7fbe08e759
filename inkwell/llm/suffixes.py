"""Suffix order of one memory-sized group, and what the repeat operators read off it.

A group is a sequence of units (bytes, or hashes of words) cut into segments; a match never
crosses the end of a segment, as if each ended in a unit of its own that sorts first. Suffixes
are sorted by prefix doubling; classes of one suffix are never touched again. Common prefixes
come from the classes of the doubling steps. From suffix order and common prefixes follow

* the longest previous factor of each place, by previous and next smaller positions, and
* the internal nodes of the suffix tree at and below a depth, by one pass with a stack.

Only places that share at least ``depth`` units with a neighbour in suffix order are walked:
no longer match exists anywhere else, for neighbours share the most.
"""

from __future__ import annotations

import numpy as np

from inkwell.llm import vec


class Suffixes:
    """The suffixes of ``units`` in order; ``ends`` are the ends of the segments."""

    def __init__(self, units: np.ndarray, ends: np.ndarray, depth: int):
        n = self.n = len(units)
        self.units, self.depth = units, depth
        ends = np.unique(ends[ends > 0])
        # Units to the end of the segment.
        left = self.left = np.repeat(ends, np.diff(np.r_[0, ends])).astype(np.int64) - np.arange(n)
        if units.dtype == np.uint8:
            # Seven bytes in one word, each with a bit more for "behind the end".
            span, head = 7, np.zeros(n, vec.U)
            wide = np.r_[units.astype(vec.U) + vec.U(1), np.zeros(span, vec.U)]
            for i in range(span):
                head = head << vec.U(9) | np.where(left > i, wide[i : i + n], vec.U(0))
        else:
            span, head = 1, units
        order = np.argsort(head, kind="stable")
        new = np.r_[True, head[order[1:]] != head[order[:-1]]][:n]
        rank = np.empty(n, np.int64)
        start = np.flatnonzero(new)
        rank[order] = np.repeat(start, np.diff(np.r_[start, n]))
        self.levels: list[tuple[int, np.ndarray]] = [(span, rank.astype(np.int32))]
        alone = np.empty(n, bool)
        alone[order] = new & np.r_[new[1:], True][:n]
        active = np.flatnonzero(~alone)
        while len(active):
            inside = left[active] > span
            second = np.where(inside, rank[np.minimum(active + span, n - 1)] + 1, 0)
            key = rank[active] * (n + 1) + second
            order = np.argsort(key, kind="stable")
            active, key, inside = active[order], key[order], inside[order]
            old = rank[active]
            # A suffix that ends here differs from all others.
            new = np.r_[True, (key[1:] != key[:-1]) | ~inside[1:]][: len(key)]
            new[1:] |= ~inside[:-1]
            first = np.r_[True, old[1:] != old[:-1]][: len(old)]
            at = np.arange(len(active))
            head_of_class, head_of_part = np.maximum.accumulate(np.where(first, at, 0)), np.maximum.accumulate(np.where(new, at, 0))
            rank = rank.copy()
            rank[active] = old + head_of_part - head_of_class
            span *= 2
            self.levels.append((span, rank.astype(np.int32)))
            active = active[~(new & np.r_[new[1:], True][: len(new)])]
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Units that the suffixes at ``a`` and ``b`` share."""
        out, last = np.zeros(len(a), np.int64), self.n - 1
        limit = np.minimum(self.left[a], self.left[b])
        for span, rank in reversed(self.levels):
            same = (out + span <= limit) & (rank[np.minimum(a + out, last)] == rank[np.minimum(b + out, last)])
            out += np.where(same, span, 0)
        rest = np.flatnonzero(out < limit) if self.levels[0][0] > 1 else np.zeros(0, int)
        while len(rest):
            rest = rest[self.units[a[rest] + out[rest]] == self.units[b[rest] + out[rest]]]
            out[rest] += 1
            rest = rest[out[rest] < limit[rest]]
        return out

    def neighbours(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in suffix order that share ``depth`` units or more with a neighbour, the units shared with the place before, and starts of runs."""
        order = self.order
        coarse = next((rank for span, rank in reversed(self.levels) if span <= self.depth), None)
        near = np.flatnonzero(coarse[order[1:]] == coarse[order[:-1]]) + 1 if coarse is not None else np.arange(1, self.n)
        units = self.shared(order[near - 1], order[near])
        near, units = near[units >= self.depth], units[units >= self.depth]
        share = np.zeros(self.n + 1, np.int64)
        share[near] = units
        member = np.flatnonzero((share[:-1] > 0) | (share[1:] > 0))
        lcp = share[member]
        return order[member], lcp, np.flatnonzero(lcp == 0)


def longest_previous(place: np.ndarray, lcp: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """For each entry of ``place`` (in suffix order): units shared with the best smaller place.

    That is with the nearest smaller one before it in suffix order or the nearest after it.
    ``lcp`` are units shared with the entry before, 0 where a run begins.
    """
    n = len(place)
    out = np.zeros(n, np.int64)
    bounds = np.r_[runs, n]
    two = np.flatnonzero(np.diff(bounds) == 2)
    a = bounds[:-1][two]
    out[np.where(place[a] > place[a + 1], a, a + 1)] = lcp[a + 1]
    long = np.flatnonzero(np.diff(bounds) > 2)
    for r in long.tolist():
        lo, hi = int(bounds[r]), int(bounds[r + 1])
        at, share = place[lo:hi].tolist(), lcp[lo:hi].tolist()
        best = [0] * (hi - lo)
        # Entries on the stack grow in place; each has what it shares with its previous smaller one.
        stack: list[list[int]] = []
        for i, (p, s) in enumerate(zip(at, share, strict=True)):
            while stack and at[stack[-1][0]] > p:
                j, before = stack.pop()
                # s: shared between entry j's successors and this one, the next smaller of j.
                best[j] = max(before, s)
                s = min(s, before)
            # What this entry shares with its previous smaller entry, if there is one.
            stack.append([i, s if stack else 0])
        for j, before in stack:
            best[j] = before
        out[lo:hi] = best
    return out


def nodes(place: np.ndarray, lcp: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Internal nodes of the subtrees, each run of ``place`` a subtree: depth, first and last leaf, and for each leaf two depths.

    The first is of the leaf's parent: the longest repeat that starts there. The second is of the
    deepest node in which the leaf isn't the least place: the longest repeat that starts earlier as well.
    """
    n = len(place)
    parent = np.maximum(lcp, np.r_[lcp[1:], 0][:n])
    later = np.zeros(n, np.int64)
    bounds = np.r_[runs, n]
    two = np.flatnonzero(np.diff(bounds) == 2)
    a = bounds[:-1][two]
    later[np.where(place[a] > place[a + 1], a, a + 1)] = lcp[a + 1]
    found = [(lcp[a + 1], a, a + 1)]
    for r in np.flatnonzero(np.diff(bounds) > 2).tolist():
        lo, hi = int(bounds[r]), int(bounds[r + 1])
        at, share = place[lo:hi].tolist(), [*lcp[lo:hi].tolist()[1:], 0]
        second = [0] * (hi - lo)
        depths, firsts, lasts = [], [], []
        stack: list[list[int]] = []  # open nodes: depth, first leaf, least leaf
        for i, s in enumerate(share):
            # Leaf i, and its depth of branching towards the next leaf.
            first, least = i, i
            while stack and stack[-1][0] > s:
                depth, begin, low = stack.pop()
                # The node ends with what was gathered below it.
                keep, lose = (low, least) if at[low] < at[least] else (least, low)
                second[lose] = depth
                depths.append(depth)
                firsts.append(begin + lo)
                lasts.append(i + lo)
                first, least = begin, keep
            if not s:
                continue
            if stack and stack[-1][0] == s:
                low = stack[-1][2]
                keep, lose = (low, least) if at[low] < at[least] else (least, low)
                second[lose] = s
                stack[-1][2] = keep
            else:
                stack.append([s, first, least])
        later[lo:hi] = second
        found.append((np.array(depths, np.int64), np.array(firsts, np.int64), np.array(lasts, np.int64)))
    depth, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
    return depth, first, last, parent, later
