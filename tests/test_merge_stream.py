"""The stream merge keeps its table of identities in a bounded number of folders."""

import random
import shutil

from inkwell.streaming import runs

SCHEMA = "id string, url string"


def kept(records):
    """The merge in plain Python, a batch at a time."""
    ids, keys, out = set(), set(), []

    def key(url):
        return None if url is None else url.split("#")[0].rstrip("/").lower()

    for batch in records:
        fresh = [r for r in batch if r[0] not in ids and key(r[1]) not in keys]
        for part in (lambda r: r[0], lambda r: key(r[1])):
            seen, once = set(), []
            for r in sorted(fresh, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or "")):
                if part(r) is None or part(r) not in seen:
                    once.append(r)
                    seen.add(part(r))
            fresh = once
        ids |= {r[0] for r in fresh if r[0] is not None}
        keys |= {key(r[1]) for r in fresh if r[1] is not None}
        out += fresh
    return sorted(out, key=repr)


def batches(n, rng):
    pick = lambda: (rng.choice([None, *(f"i{k}" for k in range(60))]), rng.choice([None, *(f"https://e.org/p{k}{t}" for k in range(60) for t in ("", "/", "#top"))]))
    return [[pick() for _ in range(8)] for _ in range(n)]


def test_folders_are_bounded_and_answers_stay(spark, tmp_path):
    ledger, check, files = tmp_path / "ledger", tmp_path / "check", tmp_path / "in"
    start = [("i0", "https://e.org/p0")]
    spark.createDataFrame(start, SCHEMA).write.parquet(f"file://{ledger}/batch=start")
    records = batches(8, random.Random(7))
    index = tmp_path / "ledger-identities"
    files.mkdir()

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"file://{files}")
        runs.merge_stream(stream, f"file://{ledger}", f"file://{check}", buckets=4, every=2).awaitTermination()
        found = spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"file://{ledger}")
        return sorted(map(tuple, found.collect()), key=repr)

    for n, batch in enumerate(records):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").option("ignoreNullFields", False).json(f"file://{files}")
        if n % 4 == 3:
            got = run()
            names = {p.name for p in index.iterdir()}
            assert len([x for x in names if x.startswith("batch=")]) <= 5 and len([x for x in names if x.startswith("upto=")]) <= 2, names
            assert got == kept([start, *records[: n + 1]])
    assert "batch=-1" not in names and "upto=6" in names
    # A run that died before the stream noted the last batch: it comes out the same.
    (check / "commits" / "7").unlink()
    (check / "commits" / ".7.crc").unlink(missing_ok=True)
    assert run() == got
    # One that died within the compaction before a batch: the half-written table is not read.
    (check / "commits" / "7").unlink()
    (check / "commits" / ".7.crc").unlink(missing_ok=True)
    shutil.copytree(index / "upto=6", index / "upto=7")
    (index / "upto=7" / "_SUCCESS").unlink()
    assert run() == got
