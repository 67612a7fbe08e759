import random
import re
from collections import Counter

import numpy as np
import pytest
import regex
from cases import empty, frame, rows, words

from inkwell.llm import decontaminate, ngram_join


def grams(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_links(texts, threshold=0.8):
    sets = [grams(t) for t in texts]
    links, parent = Counter(), list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return links, [root(i) for i in range(len(sets))]


def same_partition(left, right):
    pairs = set(zip(left, right, strict=True))
    return len(pairs) == len(set(left)) == len(set(right))


@pytest.mark.parametrize("tile", [128, 3])
def test_join_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(ngram_join, "TILE_TEXTS", tile)
    data = rows()
    numbered = [(i, *r[1:]) for i, r in enumerate(data)]
    got = {r.doc_id: r for r in ngram_join.join(frame(spark, numbered)).collect()}
    links, root = brute_links([r[1] for r in data])
    assert {i: got[i].n_links for i in got} == {i: links[i] for i in range(len(data))}
    assert same_partition([got[i].class_id for i in range(len(data))], root)
    keep = [r for r in got.values() if r.stays]
    assert len(keep) == len(set(root))


def test_join_of_null_and_repeated_ids_and_empty_tables(spark):
    data = [(None, *r[1:]) if i % 5 == 0 else r for i, r in enumerate(rows())]
    got = ngram_join.join(frame(spark, data)).collect()
    links, root = brute_links([r[1] for r in data])
    assert sorted(r.n_links for r in got) == sorted(links[i] for i in range(len(data)))
    assert len({r.class_row for r in got}) == len(set(root))
    assert ngram_join.join(empty(spark)).count() == 0


def test_bands_reach_the_target_recall():
    for threshold in (0.5, 0.8, 0.9):
        bands, per_band = ngram_join.bands_and_rows(threshold, 0.999)
        assert 1 - (1 - threshold**per_band) ** bands >= 0.999
        assert bands * per_band <= ngram_join.HASHES


def test_band_keys_of_near_sets_meet():
    import pyarrow as pa

    rng = random.Random(5)
    bands, per_band = ngram_join.bands_and_rows()
    met = 0
    for _ in range(60):
        base = words(rng, 200)
        near = list(base)
        for at in (20, 90, 150):
            near[at] = "edit"
        (_, _, _, keys), = ngram_join.signatures(pa.array([" ".join(base), " ".join(near)]), 5, bands, per_band)
        met += bool((keys[0] == keys[1]).any())
    assert met == 60


def tokens(text):
    """Words of any script, Han and kana by character."""
    return regex.findall(r"[\p{Han}\p{Hiragana}\p{Katakana}]|(?:(?![\p{Han}\p{Hiragana}\p{Katakana}])[\p{L}\p{M}\p{N}])+", (text or "").lower())


def brute_tiling(text, item, least):
    """Greedy string tiling as defined: longest unmarked match first, any tie."""
    a, b = tokens(text), tokens(item)
    if not b:
        return 0.0
    least = min(least, len(b))
    mark_a, mark_b = [False] * len(a), [False] * len(b)
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not mark_a[i + n] and not mark_b[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return sum(mark_b) / len(b)
        for x in range(n):
            mark_a[i + x] = mark_b[j + x] = True


def leak_rows():
    rng = random.Random(3)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate((3, 15, 24, 40, 6))] + [(5, None), (6, ""), (7, "a b a b a b a b a b")]
    texts = [None, "", "a b " * 40, " ".join(words(rng, 80))]
    for _, t in items[:5]:
        w = t.split()
        texts.append(" ".join(words(rng, 30)) + " " + t.upper() + ". " + " ".join(words(rng, 9)))
        half = len(w) // 2
        texts.append(" ".join([*w[half:], "between", *words(rng, 6), *w[:half]]))
        texts.append(" ".join(w[: max(1, len(w) // 3)] + words(rng, 30)))
        texts.append(" ".join(x for pair in zip(w, words(rng, len(w)), strict=True) for x in pair))
    texts.append(" ".join([items[2][1]] * 5 + words(rng, 20_000)))
    return [(i, t, None, None, 0, "", 0, 0, 0, "", 0) for i, t in enumerate(texts)], items


def test_tiling_equals_brute_force(spark, monkeypatch):
    data, items = leak_rows()
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for r in data:
        for i, t in items:
            short = (r[1] or "")[:3000]
            part = brute_tiling(short, t, 5)
            if part >= 0.6:
                want[r[0], i] = round(part, 9)
    for chars in (decontaminate.BLOCK_CHARS, 100):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", chars)
        got = {(r.doc_id, r.item_id): round(r.coverage, 9) for r in decontaminate.find(frame(spark, data), bench).collect()}
        assert got == want
        kept = decontaminate.clean(frame(spark, data), bench)
        assert kept.columns == frame(spark, data).columns
        assert {r.doc_id for r in kept.collect()} == {r[0] for r in data} - {d for d, _ in want}


def test_tiling_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find(frame(spark), none).count() == 0
    assert decontaminate.clean(frame(spark), none).count() == len(rows())
    assert decontaminate.find(empty(spark), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_tiles_do_not_overlap():
    tiles = decontaminate.tile(np.array([0, 1, 2, 10, 11, 3]), np.array([0, 1, 2, 1, 2, 3]), 8, 2)
    marked = [q + x for _, q, n in tiles for x in range(n)]
    assert len(marked) == len(set(marked))


MARKED = "“Die Straße — so heißt es — führt…”, sagt er: «l’été n’est pas fini»; das ist, was zählt!"
PLAIN = "Die Straße so heißt es führt sagt er l été n est pas fini das ist was zählt"
HAN = "企业治理是长期工作。数据平台需要明确的责任。"


def test_typographic_marks_and_han_text(spark):
    texts = [MARKED, PLAIN, f"Vorher {PLAIN.upper()} nachher", "数据平台需要明确的责任。另外，企业治理是长期工作！", "企业 数据", None, "かなとカナ 123 ½ ①", "Ä" * 40]
    items = [(1, PLAIN), (2, HAN), (3, MARKED), (4, "かなとカナ①")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.coverage, 9) for r in decontaminate.find(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(d, i): round(part, 9) for d, t in enumerate(texts) for i, x in items if (part := brute_tiling(t, x, 5)) >= 0.6}
    assert got == want
    assert {(0, 1), (1, 3), (2, 1), (2, 3), (3, 2)} <= set(got) and got[3, 2] > 0.8


def test_tokens_of_random_text():
    import pyarrow as pa

    rng = random.Random(1)
    letters = "aZ9_ .,\n“”—é\u0301ß漢字かカ😀𠀀𝒜½①\u00a0\u200bकि़ไทย"
    for _ in range(300):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 5))]
        for _, hashes, first in decontaminate._tokens(pa.array(texts)):
            names = [t for x in texts for t in regex.findall(r"[\p{Han}\u3040-\u30ff]|(?:(?![\p{Han}\u3040-\u30ff])[\p{L}\p{M}\p{N}])+", x)]
            assert np.diff(first).tolist() == [len(regex.findall(r"[\p{Han}\u3040-\u30ff]|(?:(?![\p{Han}\u3040-\u30ff])[\p{L}\p{M}\p{N}])+", x)) for x in texts]
            assert len({*zip(names, hashes.tolist(), strict=True)}) == len(set(names)) == len(set(hashes.tolist()))
