import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from cases import empty, frame, rows

from inkwell.llm import repeats, substring_dedup, suffix_dedup, vec
from inkwell.llm.queries import QUERIES


def brute(sequences, t, keep):
    """Covered places of each sequence, in the order given."""
    seen = Counter(tuple(s[i : i + t]) for s in sequences for i in range(len(s) - t + 1))
    done, out = set(), []
    for s in sequences:
        hit = [False] * len(s)
        for i in range(len(s) - t + 1):
            w = tuple(s[i : i + t])
            if seen[w] > 1 and (keep == "none" or w in done):
                hit[i : i + t] = [True] * t
            done.add(w)
        out.append(hit)
    return out


def runs(hit):
    return sum(1 for i, x in enumerate(hit) if x and not (i and hit[i - 1]))


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def numbered(texts):
    return [(i, t, None, None, 0, "", 0, 0, 0, "", 0) for i, t in enumerate(texts)]


def low_entropy(seed):
    rng = random.Random(seed)
    passage = "".join(rng.choice("ab c") for _ in range(90))
    texts = [None, "", "a", "ab" * 60, "aaa " * 50]
    for _ in range(25):
        cut = rng.randint(0, 60)
        texts.append("".join(rng.choice("abc d") for _ in range(rng.randint(0, 80))) + passage[cut : cut + rng.randint(5, 60)] + "".join(rng.choice("abé ") for _ in range(rng.randint(0, 40))))
    return texts + texts[6:9]


@pytest.mark.parametrize(("keep", "many"), [("none", 400), ("first", 400), ("none", 1), ("first", 1)])
def test_bytes_equal_brute_force(spark, monkeypatch, keep, many):
    monkeypatch.setattr(repeats, "MANY", many)
    texts = low_entropy(2)
    got = {r.doc_id: r for r in suffix_dedup.dedup(frame(spark, numbered(texts)), keep, window=24).collect()}
    raw = [(t or "").encode() for t in texts]
    for i, hit in enumerate(brute(raw, 24, keep)):
        kept = bytes(b for b, x in zip(raw[i], hit, strict=True) if not x)
        assert (got[i].n_bytes, got[i].n_removed, len(got[i].spans), bytes(got[i].kept)) == (len(raw[i]), sum(hit), runs(hit), kept), i


@pytest.mark.parametrize(("keep", "many"), [("none", 400), ("first", 400), ("none", 1), ("first", 1)])
def test_words_equal_brute_force(spark, monkeypatch, keep, many):
    monkeypatch.setattr(repeats, "MANY", many)
    texts = low_entropy(3)
    got = {r.doc_id: r for r in substring_dedup.dedup(frame(spark, numbered(texts)), keep, window=5).collect()}
    sequences = [split(t) for t in texts]
    for i, hit in enumerate(brute(sequences, 5, keep)):
        kept = " ".join(w for w, x in zip(sequences[i], hit, strict=True) if not x)
        assert (got[i].n_words, got[i].n_removed, len(got[i].spans), got[i].kept) == (len(hit), sum(hit), runs(hit), kept), i


def test_registered_queries_equal_brute_force(spark, tmp_path):
    data = rows(plain=8)
    frame(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    raw = [(r[1] or "").encode() for r in data]
    want = Counter()
    for r, b, hit in zip(data, raw, brute(raw, 400, "none"), strict=True):
        want[r[0], len(b), sum(hit), runs(hit), hashlib.sha256(bytes(x for x, gone in zip(b, hit, strict=True) if not gone)).hexdigest()] += 1
    assert Counter(tuple(r) for r in QUERIES["op4_suffix_dedup"](spark, str(tmp_path)).collect()) == want
    sequences = [split(r[1]) for r in data]
    want = Counter()
    for r, s, hit in zip(data, sequences, brute(sequences, 35, "none"), strict=True):
        kept = " ".join(w for w, gone in zip(s, hit, strict=True) if not gone)
        want[r[0], len(s), sum(hit), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in QUERIES["op6_substring_dedup"](spark, str(tmp_path)).collect()) == want


def test_long_texts_have_the_anchors_of_short_ones(monkeypatch):
    rng = np.random.default_rng(4)
    text = rng.integers(97, 100, 5000).astype(np.uint8)
    whole = repeats.anchors(text, np.array([0, len(text)]), 60, 21)
    monkeypatch.setattr(repeats, "PIECE", 700)
    pieces = repeats.anchors(text, np.array([0, len(text)]), 60, 21)
    for a, b in zip(whole, pieces, strict=True):
        assert (a == b).all()
    gaps = np.diff(np.r_[-1, whole[1]])
    assert gaps.max() <= 60 - 21 + 1


def test_empty_tables(spark):
    assert suffix_dedup.dedup(empty(spark)).count() == 0
    assert substring_dedup.dedup(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.dedup(empty(spark), window=8)


def test_window_hashes_do_not_depend_on_the_place():
    raw = np.frombuffer(b"abcabcabc", np.uint8)
    assert len(set(vec.GRAMS.windows(vec.GRAMS.prefix(raw), 3)[[0, 3, 6]].tolist())) == 1


@pytest.mark.parametrize("keep", ["none", "first"])
def test_many_equal_rows_of_null_ids(spark, keep):
    """Rows that repeat id and text are copies of each other; what each finds is found once."""
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(700))
    texts = [(None, passage)] * 2000 + [(None, passage[100:])] + [(7, "x" + passage[:500])] * 300 + [(8, "own text " * 3)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.dedup(docs, keep, window=60).collect())
    assert sum(got.values()) == len(texts)
    if keep == "none":
        assert got == {(None, 700, 700): 2000, (None, 600, 600): 1, (7, 501, 501): 300, (8, 27, 0): 1}
    else:  # equal rows share an answer; the first by id, then hash, is a null one
        assert {k: n for k, n in got.items() if k[0] is not None} == {(7, 501, 500): 300, (8, 27, 0): 1}


def test_rows_that_change():
    import pyarrow as pa

    column = pa.chunked_array([pa.array([1, 1, None, None, 2, 2, None, 3])]).combine_chunks()
    assert repeats._changes(column).tolist() == [True, False, True, False, True, False, True, True]
    assert repeats._changes(column[:0]).tolist() == [] and repeats._changes(column[2:4]).tolist() == [True, False]
