"""Pages without an article among copies, against a reference that searches each host for the nearest page."""

import random

import pytest

from inkwell.llm import pages


def split(url):
    host, slash, path = url.removeprefix("http://").partition("/")
    return host, slash + path


def reference(data):
    """Text of each (page_id, url, lines): lines shared with the nearest of all pages of the host that have other lines."""
    ordered = sorted(data, key=lambda x: (*split(x[1]), x[0]))
    out = {}
    for i, (page_id, url, lines) in enumerate(ordered):
        host, path = split(url)
        best, found = None, None
        for j, (_, other_url, other) in enumerate(ordered):
            other_host, other_path = split(other_url)
            if other_host != host or other == lines:
                continue
            common = 0
            while path[common : common + 1] and path[common : common + 1] == other_path[common : common + 1]:
                common += 1
            key = (common, j < i, -abs(i - j))
            if best is None or key > best:
                best, found = key, other
        names = {x: n for n, x in enumerate(sorted({*lines, *(found or [])}))}
        gone = pages.shared([names[x] for x in lines], [names[x] for x in found]) if found is not None else ()
        out[page_id] = " ".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def extracted(spark, data, partitions):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = [(i, url, "".join(f"<div>{x}</div>" for x in lines)) for i, url, lines in data]
        return {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


@pytest.mark.parametrize("partitions", ["1", "40"])
def test_inner_copies_and_short_pages_lose_their_template(spark, partitions):
    template = [f"menu {i}" for i in range(9)]
    copy = [*template, "copied one", "copied two"]
    data = [(0, "http://a.example/p/00", [*template, "own a", "own b"]), *[(i, f"http://a.example/p/{i:02d}", copy) for i in range(1, 8)], (8, "http://a.example/p/08", [*template, "own c"])]
    data += [(9, "http://b.example/p/09", copy), (10, "http://b.example/p/10", copy)]
    got = extracted(spark, data, partitions)
    assert got == {0: "own a own b", **dict.fromkeys(range(1, 8), "copied one copied two"), 8: "own c", **dict.fromkeys((9, 10), " ".join(copy))}
    assert got == reference(data)


@pytest.mark.parametrize(("partitions", "seed"), [("1", 1), ("7", 2), ("40", 3)])
def test_copies_over_many_partitions(spark, partitions, seed):
    rng = random.Random(seed)
    data = []
    for host in ("a.example", "hot.example", "hot2.example"):
        pool = [[f"top {host}", *[f"line {rng.randint(0, 6)}" for _ in range(rng.randint(0, 4))], "end"] for _ in range(4)]
        lines = pool[0]
        for _ in range(90 if host != "a.example" else 5):
            lines = rng.choice(pool) if rng.random() < 0.15 else lines
            data.append((len(data), f"http://{host}/{rng.choice('xy')}/{rng.randint(0, 300)}", lines))
    assert extracted(spark, data, partitions) == reference(data)
