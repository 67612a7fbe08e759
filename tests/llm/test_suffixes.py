"""Suffix order, longest factors and tree nodes against their definitions."""

import random

import numpy as np
import pytest

from inkwell.llm import substring_dedup, suffix_dedup, suffixes


def texts(seed, kind):
    rng = random.Random(seed)
    for _ in range(120):
        sizes = [rng.randint(0, 40) for _ in range(rng.randint(1, 6))]
        letters = rng.choice([[0, 1], [0, 1, 2, 255], [7]])
        parts = [[rng.choice(letters) for _ in range(n)] for n in sizes]
        if rng.random() < 0.5:
            parts += [parts[0], parts[-1][: len(parts[-1]) // 2]]
        unit = [u for p in parts for u in p]
        yield np.array(unit, kind), np.cumsum([len(p) for p in parts]), parts


def common(unit, end, a, b):
    n = 0
    while a + n < end[a] and b + n < end[b] and unit[a + n] == unit[b + n]:
        n += 1
    return n


@pytest.mark.parametrize("kind", [np.uint8, np.uint64])
@pytest.mark.parametrize("depth", [8, 16])
def test_order_factors_and_nodes(kind, depth):
    some = 0
    for unit, ends, _ in texts(depth, kind):
        if not len(unit):
            continue
        end = [int(min(e for e in ends if e > i)) for i in range(len(unit))]
        found = suffixes.Suffixes(unit, ends, depth)
        # An end sorts before every unit and differs from every other end.
        tail = lambda i: [int(u) + 1 for u in unit[i : end[i]]] + [0]
        assert [tail(i) for i in found.order] == sorted(tail(i) for i in range(len(unit)))
        n = len(unit)
        share = {(a, b): common(unit, end, a, b) for a in range(n) for b in range(n) if a != b}
        place, previous, following = suffix_dedup.factors(unit, ends, depth) if kind is np.uint8 else (np.zeros(0, int),) * 3
        at = {int(p): (int(x), int(y)) for p, x, y in zip(place, previous, following, strict=True)}
        _, lcp, runs = found.neighbours()
        walked, *_ = found.neighbours()
        depths, first, last, parent, later = suffixes.nodes(walked, lcp, runs)
        leaf = {int(p): (int(x), int(y)) for p, x, y in zip(walked, parent, later, strict=True)}
        for p in range(n):
            lpf = max((share[p, q] for q in range(p)), default=0)
            lnf = max((share[p, q] for q in range(p + 1, n)), default=0)
            want = (lpf if lpf >= depth else 0, lnf if lnf >= depth else 0)
            if kind is np.uint8:
                assert at.get(p, (0, 0)) == want, (p, unit, ends)
            assert leaf.get(p, (0, 0)) == (max(want), want[0])
            some += bool(want[0])
        # Internal nodes: the distinct strings of depth units or more that go on in two ways.
        strings = {}
        for (a, b), m in share.items():
            if m >= depth:
                strings[tuple(unit[a : a + m])] = m
        assert sorted(depths.tolist()) == sorted(strings.values())
        for d, x, y in zip(depths, first, last, strict=True):
            label = tuple(unit[walked[x] : walked[x] + d])
            occurrences = [p for p in range(n) if end[p] - p >= d and tuple(unit[p : p + d]) == label]
            assert sorted(walked[x : y + 1].tolist()) == occurrences
    assert some > 100


def test_maximal_repeats_cannot_be_extended():
    count = 0
    for unit, ends, _ in texts(3, np.uint64):
        if not len(unit):
            continue
        end = [int(min(e for e in ends if e > i)) for i in range(len(unit))]
        want = set()
        for a in range(len(unit)):
            for b in range(a):
                m = common(unit, end, a, b)
                edge = b == 0 or a in ends or b in ends
                if m >= 5 and (edge or unit[a - 1] != unit[b - 1]):
                    want.add(tuple(unit[a : a + m].tolist()))
        got = substring_dedup.maximal_repeats(unit, ends, 5)
        assert {tuple(unit[p[0] : p[0] + d].tolist()) for d, p in got} == want and len(got) == len(want)
        count += len(got)
    assert count > 50


def test_empty_groups():
    none = np.zeros(0, np.uint8)
    for found in (suffix_dedup.search(none, np.zeros(0, np.int64), False), substring_dedup.search(none.astype(np.uint64), np.zeros(0, np.int64), True)):
        assert not len(found[0])
