"""Clashing and dotted column names, null and repeated ids, and strings that fool a plain polynomial."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from test_maps import brute_mix
from test_repeats import brute

from inkwell.llm import decontaminate, language, mixing, ngram_join, quality, substring_dedup, suffix_dedup, vec

EXTRAS = ["a.b", "__h", "__h2", "__id", "__n", "__key", "__mine", "__copies", "__threshold", "__time", "__folded", "row", "key", "h", "n", "c", "times", "size", "more", "folded", "tied", "id", "hash", "mine"]


def clashing(spark, data):
    fields = ", ".join(f"`{c}` string" for c in EXTRAS)
    return spark.createDataFrame([(*r, *[f"MINE {c} {i % 4}" for c in EXTRAS]) for i, r in enumerate(data)], f"doc_id long, text string, lang string, source string, {fields}")


def test_no_column_of_the_caller_is_lost_or_changed(spark):
    data = [(i if i % 5 else None, f"some words of text number {i % 9} and then more of them", "en", ["a", "b", None][i % 3]) for i in range(60)] + [(7, None, None, None), (7, "", None, "a")]
    docs = clashing(spark, data)
    given = Counter(map(tuple, docs.collect()))
    items = spark.createDataFrame([(1, "text number 3 and then more")], "item_id long, text string")
    for out in (
        ngram_join.one_of_each(docs), decontaminate.clean(docs, items), mixing.mixed(docs),
        language.known(docs, {}), language.known(docs, language.train(docs)),
    ):
        assert out.columns == docs.columns
        assert set(map(tuple, out.collect())) <= set(given)
    assert decontaminate.clean(docs, items).count() == sum(n for r, n in given.items() if "number 3" not in (r[1] or ""))
    assert language.known(docs, {}).count() == len(data)


@pytest.mark.parametrize("ids", ["null", "one", "two"])
def test_budgets_end_within_rows_of_one_id(spark, ids):
    """Null and equal ids and wholly equal rows: each source's words still come near its target."""
    of = {"null": lambda i: None, "one": lambda i: 5, "two": lambda i: i % 2}[ids]
    data = [(of(i), f"w{i % 50} " * (1 + i % 13) if i % 4 else "same words here", None, ["a", "b", "c"][i % 3]) for i in range(900)]
    docs = clashing(spark, data).select("doc_id", "text", "lang", "source", "`a.b`")
    size, by, target = brute_mix(data)
    got = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], n) for r, n in zip(data, size, strict=True))
    assert all(r.taken == r["size"] * r.copies and r.copies <= 3 for r in got)
    taken = Counter()
    for r in got:
        taken[r.source_size, round(r.target, 6)] += r.taken
    assert len(taken) == 3
    for (_, goal), words in taken.items():
        assert abs(words - goal) <= 13
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(docs.repartition(5)).collect()))
    mixed = mixing.mixed(docs).collect()
    assert sum(len((r.text or "").split()) for r in mixed) == sum(r.taken for r in got)
    assert Counter(r.doc_id for r in mixed) == Counter(x for r in got for x in [r.doc_id] * r.copies)


def thue_morse(n, one="a", other="b"):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join((one, other)[b] for b in bits), "".join((other, one)[b] for b in bits)


@pytest.mark.parametrize("n", [512, 1024, 4096])
def test_a_thue_morse_word_and_its_complement_differ(n):
    word, complement = thue_morse(n)
    raw = np.frombuffer((word + complement + word).encode(), np.uint8)
    for rolling in (vec.WORDS, vec.GRAMS, vec.CONTEXT):
        prefix = rolling.prefix(raw)
        a, b, c = rolling.of(prefix, np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]))
        assert a == c != b
        assert (rolling.windows(prefix, n)[[0, n, 2 * n]] == [a, b, c]).all()
    # Operator 7: two lines, and two words in a row.
    for text in (f"{word}\n{complement}", f"{word} {complement}"):
        found = quality.measure(pa.array([text]))
        assert found["n_dup_lines"][0] == found["n_stutters"][0] == 0
    again = quality.measure(pa.array([f"{word}\n{word}"]))
    assert again["n_dup_lines"][0] == again["n_stutters"][0] == 1


def test_words_of_a_thue_morse_pair_are_told_apart(spark):
    word, complement = thue_morse(1024)
    texts = [" ".join(f"x{i} {w}" for i in range(40)) for w in (word, complement, word)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # Operator 5: texts 0 and 2 have equal sets, 1 shares no gram with them.
    links = {r.doc_id: (r.n_links, r.class_id) for r in ngram_join.join(docs).collect()}
    assert links == {0: (1, 0), 1: (0, 1), 2: (1, 0)}
    # Operator 6: only the texts 0 and 2 repeat windows, all of their words.
    gone = {r.doc_id: r.n_removed for r in substring_dedup.dedup(docs, "none").collect()}
    assert gone == {0: 80, 1: 0, 2: 80}
    # Operator 2: the item is in texts 0 and 2.
    items = spark.createDataFrame([(9, texts[0])], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.find(docs, items).collect()} == {0, 2}


def test_bytes_of_a_thue_morse_pair_are_told_apart(spark):
    word, complement = thue_morse(4096)
    docs = spark.createDataFrame([(0, word), (1, complement)], "doc_id long, text string")
    want = {i: sum(hit) for i, hit in enumerate(brute([word, complement], 1500, "none"))}
    assert 0 < want[0] <= 4096
    assert {r.doc_id: r.n_removed for r in suffix_dedup.dedup(docs, "none", window=1500).collect()} == want
    # Cut in half, each text is one Thue-Morse word and its complement: no window occurs twice.
    halves = spark.createDataFrame([(0, word[:1024]), (1, complement[:1024])], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in suffix_dedup.dedup(halves, "none", window=1024).collect()} == {0: 0, 1: 0}


def test_seeds_are_taken_in_bounded_parts(monkeypatch):
    """A phrase in every item and document: the same pairs whatever is held at once."""
    phrase = "one common phrase of six words"
    seeds = decontaminate.Seeds([*(f"{phrase} item {i % 6} has this" for i in range(30)), phrase, "a b", ""], 5)
    docs = pa.array([*(f"{phrase} " * (1 + i % 4) + f"item {i % 8} has this" for i in range(40)), None, "other", "x a b y"])
    want = None
    for most in (decontaminate.SEEDS, 40, 1):
        monkeypatch.setattr(decontaminate, "SEEDS", most)
        for width in seeds.by_width:
            for _, token, first in decontaminate._tokens(docs):
                owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
                assert all(len(x[0]) <= most or len(set(zip(x[0], x[1], strict=True))) == 1 for x in seeds.hits(token, owner, width))
        got = sorted((row, item, round(part, 9), len(tiles)) for row, item, part, tiles in decontaminate.matches(docs, seeds, 5, 0.6))
        want = want or got
        assert got == want
    assert len(want) >= 40 and (42, 31) in {x[:2] for x in want} and not {x[0] for x in want} & {40, 41}
