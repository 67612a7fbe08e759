"""Operator 12: held-out accuracy, and an independent plain version."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import empty, frame, rows

from inkwell.llm import classifier, language
from inkwell.llm.queries import op12_quality_classifier

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    """On rows that nothing was learned from."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    found = op12_quality_classifier(spark, DATA).collect()
    assert len(found) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    judged = [(r.predicted, labels[r.doc_id]) for r in found if r.held_out and r.doc_id in labels]
    assert len(judged) > 100 and len({y for _, y in judged}) == 2
    for y in (0, 1):
        of = [p == y for p, label in judged if label == y]
        assert sum(of) / len(of) >= 0.97


def places(text):
    """The places of a text's n-grams, one by one."""
    spread = lambda gram: (gram * 0x9E3779B97F4A7C15 % 2**64) >> (64 - classifier.BITS)
    raw, words, last, marks = (text or "").encode(), [], {}, []
    for piece in "".join(c if c not in " \t\n\v\f\r" else " " for c in text or "").split(" "):
        if piece:
            words.append(piece)
    for i, w in enumerate(words):
        back = i - last[w] if w in last else 0
        marks.append(sum(back >= edge for edge in (1, 2, 3, 5, 17, 65)))
        last[w] = i
    out = {spread((32 << 40) + len(words).bit_length())}
    for units, orders, tag in ((raw, (1, 2, 3, 4), 0), (marks, (1, 2, 3), 16)):
        for n in orders:
            for i in range(len(units) - n + 1):
                out.add(spread(sum(u << 8 * (n - 1 - k) for k, u in enumerate(units[i : i + n])) + ((tag + n) << 40)))
    return out


def plain_scores(learned, texts):
    """Ratios from counts in dictionaries, the dual solved to its optimum, scores by sums."""
    ones, zeros = Counter(), Counter()
    for text, y in learned:
        (ones if y else zeros).update(places(text))
    size = 1 << classifier.BITS
    p, q = sum(ones.values()) + size, sum(zeros.values()) + size
    ratio = lambda f: math.log((ones[f] + 1) / p) - math.log((zeros[f] + 1) / q)

    def vector(text):
        v = {f: ratio(f) for f in places(text)}
        norm = max(math.sqrt(sum(x * x for x in v.values())), 1e-12)
        return {f: x / norm for f, x in v.items()} | {"bias": 1.0}

    dot = lambda a, b: sum(x * b[f] for f, x in a.items() if f in b)
    vectors, sign = [vector(t) for t, _ in learned], [1 if y else -1 for _, y in learned]
    gram = np.array([[dot(a, b) for b in vectors] for a in vectors]) * np.outer(sign, sign)
    cost = np.array([len(sign) / (2 * sign.count(s)) for s in sign])
    dual = np.zeros(len(sign))
    for _ in range(400):
        for i in range(len(sign)):
            dual[i] = min(max(dual[i] - (gram[i] @ dual - 1) / gram[i, i], 0), cost[i])
    out = []
    for text in texts:
        v = vector(text)
        out.append(1 / (1 + math.exp(-2 * sum(a * s * dot(v, x) for a, s, x in zip(dual, sign, vectors, strict=True)))))
    return out


def test_equals_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(classifier, "PASSES", 400)
    monkeypatch.setattr(classifier, "STILL", 1e-9)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5)))
    good = [" ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(25)]
    bad = [" ".join(w.upper() + "!" if i % 2 else w for i, w in enumerate([word()] * rng.randint(2, 20))) for _ in range(12)]
    learned = [(t, 1) for t in good] + [(t, 0) for t in bad]
    texts = [*good[:5], *bad[:5], None, "", " ", "one", "ONE! ONE!", "漢字 漢字", "x" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = classifier.train(spark.createDataFrame(learned, "t string, y int").repartition(3))
    got = {r.doc_id: r.score for r in classifier.score(docs, model).collect()}
    want = plain_scores(sorted(set(learned)), texts)
    assert [round(got[i], 3) for i in range(len(texts))] == [round(x, 3) for x in want]


def test_the_order_and_parts_of_rows_dont_matter(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    first, again = (classifier.train(classifier.labelled(language.learning_rows(x), labels), sample=40) for x in (docs, docs.repartition(7)))
    assert (first.ratio == again.ratio).all() and (first.weight == again.weight).all() and first.bias == again.bias


def test_long_texts_are_cut_like_short_ones(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["abc abd " * 40, "q", None, "abcdefgh" * 30])
    whole = [x.tolist() for x in classifier.Places().of(texts)]
    monkeypatch.setattr(classifier, "PIECE", 7)
    assert [x.tolist() for x in classifier.Places().of(texts)] == whole


@pytest.mark.parametrize("label", [None, 0, 1])
def test_tables_that_teach_one_class_or_nothing(spark, label):
    docs = frame(spark)
    labels = spark.createDataFrame([] if label is None else [(1, label), (3, label), (None, 1)], "doc_id long, quality int")
    found = classifier.score(docs, classifier.train(classifier.labelled(docs, labels))).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in rows())
    assert {r.predicted for r in found} == {0 if label == 0 else 1}
    assert classifier.score(empty(spark), classifier.train(classifier.labelled(docs, labels))).count() == 0


def test_ids_of_two_labels_teach_nothing(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b2"), (None, "c"), (3, None), (4, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 1), (None, 1), (3, 0), (4, None), (9, 1)], "doc_id long, quality int")
    assert sorted(map(tuple, classifier.labelled(docs, labels).collect())) == [("", 0), ("b", 1), ("b2", 1)]
