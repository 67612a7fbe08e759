"""Fetching holds a bounded number of bodies and keeps a pace by host."""

import threading
import time

import pytest

from inkwell.sources import fetch


def test_pages_in_flight_are_bounded_by_what_is_taken():
    begun, lock, drawn = [], threading.Lock(), []

    def one(url):
        with lock:
            begun.append(url)
        return {"body": url}

    def urls():
        for i in range(200):
            drawn.append(i)
            yield f"u{i}"

    taken = []
    for url, found in fetch.window(urls(), one, 4):
        taken.append(url)
        assert found["body"] == url
        # A slow reader: no more than four pages are ahead of it.
        assert len(begun) - len(taken) < 4 + 1 and len(drawn) - len(taken) <= 4
        if len(taken) % 50 == 0:
            time.sleep(0.05)
            assert len(begun) - len(taken) <= 4
    assert sorted(taken) == sorted(f"u{i}" for i in range(200))


def test_a_quick_page_does_not_wait_for_a_slow_one():
    slow = threading.Event()

    def one(url):
        if url == "slow":
            assert slow.wait(20)
        return {}

    seen = []
    for url, _ in fetch.window(["slow", *(f"u{i}" for i in range(20))], one, 2):
        seen.append(url)
        if len(seen) == 20:
            slow.set()
    assert seen[-1] == "slow" and len(seen) == 21


def test_a_reader_that_stops_stops_the_requests():
    begun = []
    found = fetch.window((str(i) for i in range(1000)), lambda u: begun.append(u) or {}, 3)
    for _ in range(5):
        next(found)
    found.close()
    assert len(begun) <= 5 + 3


def test_failures_of_the_fetcher_reach_the_caller():
    def one(url):
        raise RuntimeError("broken")

    with pytest.raises(RuntimeError, match="broken"):
        list(fetch.window(["a"], one, 2))
    assert list(fetch.window([], one, 2)) == []


def test_a_pace_by_host():
    now, waits = [0.0], []
    pace = fetch.Pace(2.0, lambda: now[0], waits.append)
    for host in ("a", "a", "b", "a"):
        pace.turn(host)
    assert waits == [2.0, 4.0]
    now[0] = 100.0
    pace.turn("a")
    assert waits == [2.0, 4.0]
    fetch.Pace(0, lambda: now[0], waits.append).turn("a")
    assert len(waits) == 2


def test_paced_pages_of_a_table(spark):
    def get(url, timeout):
        return 200, url, "text/html", f"{time.time()} {url}"

    urls = [(f"https://{h}/{i}",) for h in ("one.org", "TWO.org") for i in range(6)] + [(None,), ("http://[bad",)]
    rows = fetch.pages(spark.createDataFrame(urls, "url string"), get, concurrency=4, every=0.1, host_tasks=2, size=150).collect()
    assert sorted(str(r.url) for r in rows) == sorted(str(u) for (u,) in urls)
    assert {(r.status, r.error) for r in rows if r.url is None} == {("failed", "no URL")}
    assert all(r.status == "downloaded" for r in rows if r.url)
    # Each of a host's two tasks waits 0.2 seconds between its requests.
    for host in ("one.org", "TWO.org"):
        parts = {}
        for r in rows:
            if r.url and host in r.url:
                parts.setdefault(spark.range(1).selectExpr(f"pmod(xxhash64('{r.url}'), 2) AS p").head().p, []).append(float(r.body.split()[0]))
        for times in parts.values():
            times.sort()
            assert all(b - a > 0.15 for a, b in zip(times, times[1:], strict=False))
    with pytest.raises(ValueError):
        fetch.pages(spark.createDataFrame(urls, "url string"), get, every=-1)
