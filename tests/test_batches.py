"""Batches over blocks equal one pass over a publisher, wherever blocks end."""

import random

import pytest

from inkwell.operators import archive, ordering
from inkwell.scratch import Scratch

SCHEMA = "publisher string, id string, archive_index int, source_characters int"


def fold(rows, items, characters):
    """One pass over all entries of each publisher."""
    out, state = {}, {}
    for p, i, _, size in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[2] is not None, r[2] or 0, r[1])):
        batch, n, used = state.get(p, (0, 0, 0))
        if n == 0 or n >= items or used + (size or 0) > characters:
            batch, n, used = batch + 1, 0, 0
        state[p] = batch, n + 1, used + (size or 0)
        out[p, i] = batch
    return out


@pytest.mark.parametrize("items,characters,block", [(10, 100, 10), (10, 100, 13), (3, 60, 7), (1, 50, 5), (7, 10**9, 50), (10, 5, 11), (4, 100, None)])
def test_one_publisher_of_almost_all_rows(spark, items, characters, block):
    rng = random.Random(items * 31 + characters)
    rows = [("hot", f"h{i:05d}", i if i % 7 else None, rng.choice([0, 1, 5, 20, 40, 99, 100, 101, 400, None])) for i in range(700)]
    rows += [(p, f"{p}{i}", i, rng.randint(0, 60)) for p, n in (("a", 1), ("b", 25), (None, 31), ("", 9)) for i in range(n)]
    rng.shuffle(rows)
    entries = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = archive.batches(entries, items, characters, block).collect()
    assert len(got) == len(rows)
    assert {(r.publisher, r.id): r.batch for r in got} == fold(rows, items, characters)


def test_no_entries_and_a_batch_of_none(spark):
    assert archive.batches(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError, match="one entry"):
        archive.batches(spark.createDataFrame([], SCHEMA), items=0)


def test_a_block_is_summed_up_for_every_place_it_may_start_at():
    rng = random.Random(5)
    for _ in range(200):
        items, characters, n = rng.randint(1, 6), rng.randint(5, 40), rng.randint(1, 12)
        sizes = [rng.choice([None, 0, 3, 8, 15, 50]) for _ in range(n + rng.choice([0, items]))]
        nexts = archive.jumps(sizes, n, items, characters)
        for i, j in enumerate(nexts):  # the definition, entry by entry
            used, k = 0, i
            while k < len(sizes) and (k == i or (k - i < items and used + (sizes[k] or 0) <= characters)):
                used, k = used + (sizes[k] or 0), k + 1
            assert j == k
        for s, (leaves, count) in enumerate(archive.passage(nexts, items)):
            at, seen = s, 0
            while at < n:
                at, seen = nexts[at], seen + 1
            assert (leaves, count) == (at - n, seen)


def test_places_in_groups_of_any_size(spark):
    rows = [(g, i) for g, n in (("x", 300), (None, 40), ("y", 1)) for i in range(n)] + [("x", None), ("x", 5)]
    random.Random(2).shuffle(rows)
    got = ordering.numbered(spark.createDataFrame(rows, "g string, i int").repartition(6), "g", ["i"], Scratch(spark, "places")).collect()
    for g in ("x", None, "y"):
        mine = sorted(((r.i, r.place) for r in got if r.g == g), key=lambda x: x[1])
        assert [p for _, p in mine] == list(range(len(mine)))
        assert [i for i, _ in mine] == sorted((i for h, i in rows if h == g), key=lambda i: (i is not None, i or 0))
