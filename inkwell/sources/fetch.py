"""Fetching pages: bounded concurrency and bodies, a pace by host, retries of what may pass, classified outcomes."""

from __future__ import annotations

import itertools
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators.archive import BLOCKED, RETRIED

#: A fetcher takes a URL and a timeout in seconds and returns status, final URL, content type and body;
#: it raises OSError where the network fails.
Fetcher = Callable[[str, float], tuple[int, str, str, str]]
ATTEMPTS, TIMEOUT, BASE, MOST = 4, 30.0, 0.5, 12


def over_http(url: str, timeout: float) -> tuple[int, str, str, str]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "corpus-archiver"}), timeout=timeout) as r:
            return r.status, r.url, r.headers.get("Content-Type", ""), r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, e.url or url, e.headers.get("Content-Type", ""), ""


def page(url: str, get: Fetcher = over_http, attempts: int = ATTEMPTS, timeout: float = TIMEOUT, sleep: Callable[[float], None] = time.sleep) -> dict:
    """One page. Other client errors fail at once; waits double from half a second."""
    error = None
    for n in range(1, attempts + 1):
        status = None
        try:
            status, final, kind, body = get(url, timeout)
            error = None if status < 400 else f"HTTP {status}"
            if status not in RETRIED:
                outcome = "blocked" if status in BLOCKED else "failed" if status >= 400 else "downloaded"
                return {"status": outcome, "http": status, "attempts": n, "final_url": final, "content_type": kind, "body": body if status < 400 else None, "error": error}
        except OSError as e:
            error = str(e) or type(e).__name__
        if n < attempts:
            sleep(BASE * 2 ** (n - 1))
    return {"status": "failed", "http": status, "attempts": attempts, "final_url": url, "content_type": None, "body": None, "error": error}


_FIELDS = {"status": pa.string(), "http": pa.int32(), "attempts": pa.int32(), "final_url": pa.string(), "content_type": pa.string(), "body": pa.string(), "error": pa.string()}


def host_of(url: str) -> str:
    try:
        return (urllib.parse.urlsplit(url).hostname or "").lower()
    except ValueError:
        return ""


class Pace:
    """At most one request to a host every ``gap`` seconds, over the threads that share it."""

    def __init__(self, gap: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep, self.next, self.lock = gap, clock, sleep, {}, threading.Lock()

    def turn(self, host: str) -> None:
        """Take the host's next place in time and wait for it."""
        if self.gap <= 0:
            return
        with self.lock:
            now = self.clock()
            at = max(now, self.next.get(host, now))
            self.next[host] = at + self.gap
        if at > now:
            self.sleep(at - now)


def window(urls: Iterable[str | None], fetch: Callable[[str | None], dict], concurrency: int) -> Iterator[tuple[str | None, dict]]:
    """Each URL with its page, as pages come; a URL is started only while fewer than ``concurrency`` pages are under way or wait to be taken.

    Urls are drawn as places get free: a reader that stops reading stops the requests as well.
    """
    left = iter(urls)
    with ThreadPoolExecutor(concurrency) as pool:
        running = {pool.submit(fetch, u): u for u in itertools.islice(left, concurrency)}
        while running:
            done, _ = wait(running, return_when=FIRST_COMPLETED)
            for job in done:
                url = running.pop(job)
                yield url, job.result()
                del job  # its body is the reader's alone now
                running |= {pool.submit(fetch, u): u for u in itertools.islice(left, 1)}


def pages(urls: DataFrame, get: Fetcher = over_http, concurrency: int = 3, url_col: str = "url", every: float = 0.0, host_tasks: int = 1, size: int = 1 << 20, **options) -> DataFrame:
    """Snapshots of a table of URLs; at most ``concurrency`` requests at a time in a task.

    Rows leave a task in the order in which pages come, in batches of about ``size`` bytes: what is
    held is a batch and ``concurrency`` bodies, however many URLs a task has. With ``every``, a host's URLs
    meet in ``host_tasks`` tasks, and the host gets one request every ``every`` seconds from all of them
    together: each waits ``host_tasks`` times as long. A null URL fails without a request.
    """
    if not 1 <= concurrency <= MOST:
        raise ValueError(f"concurrency must be 1 to {MOST}")
    if every < 0 or host_tasks < 1:
        raise ValueError("every must not be negative, host_tasks at least 1")
    rows = urls.select(F.col(url_col))
    if every:
        host = F.lower(F.coalesce(F.try_parse_url(F.col(url_col), F.lit("HOST")), F.lit("")))
        rows = rows.withColumn("_host", host).withColumn("_part", F.pmod(F.xxhash64(url_col), F.lit(host_tasks)))
        rows = rows.repartition("_host", "_part").select(url_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pace = Pace(every * host_tasks)

        def paced(url: str, timeout: float) -> tuple[int, str, str, str]:
            if every:
                pace.turn(host_of(url))
            return get(url, timeout)

        def one(url: str | None) -> dict:
            return page(url, paced, **options) if url is not None else dict.fromkeys(_FIELDS) | {"status": "failed", "attempts": 0, "error": "no URL"}

        def batch(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.string()), *(pa.array([x[k] for _, x in found], t) for k, t in _FIELDS.items())], [url_col, *_FIELDS])

        found, held = [], 0
        for url, x in window((u for b in batches for u in b.column(0).to_pylist()), one, concurrency):
            found.append((url, x))
            held += 100 + len(x["body"] or "")
            if held >= size:
                yield batch(found)
                found, held = [], 0
        if found:
            yield batch(found)

    return rows.mapInArrow(run, f"`{url_col}` string, status string, http int, attempts int, final_url string, content_type string, body string, error string")
