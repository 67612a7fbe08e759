"""An index that is kept up gives the answers of one that is built anew."""

import random

import pytest

from inkwell.operators import search, segments

SCHEMA = "id string, publisher string, category string, priority string, published_at string, search_text string"
WORDS = "ledger audit scope risk data model cost plan review 企业治理".split()
ASKED = ["audit", "cost", "治理"]


def document(rng, i):
    words = rng.choices(WORDS, k=rng.randrange(1, 30))
    return (f"d{i:03d}", f"p{i % 5}", None, rng.choice(["track", None]), None, None if i % 17 == 0 else " ".join(words))


def answers(frame):
    return sorted((r.rank, r.id, r.publisher, r.score, r.matched) for r in frame.collect())


def rebuilt(spark, docs, filters=None):
    return answers(search.search(spark.createDataFrame(list(docs.values()), SCHEMA), ASKED, filters))


def test_adds_replacements_and_deletions_equal_a_rebuild(spark, tmp_path):
    rng, path = random.Random(3), f"file://{tmp_path}/index"
    docs = {d[0]: d for d in (document(rng, i) for i in range(60))}
    segments.create(spark.createDataFrame(list(docs.values()), SCHEMA), path)
    for number in range(1, 5):
        batch = [document(rng, i) for i in rng.sample(range(90), 15)]
        gone = rng.sample(range(90), 12)
        docs = {k: d for k, d in docs.items() if k not in {f"d{i:03d}" for i in gone}} | {d[0]: d for d in batch}
        deleted = spark.createDataFrame([(f"d{i:03d}",) for i in gone] + [(None,), ("stranger",)], "id string")
        assert segments.update(spark.createDataFrame(batch, SCHEMA), deleted, path, number)
        assert answers(segments.find(spark, path, ASKED)) == rebuilt(spark, docs)
    # Sent again, a segment that counts changes nothing.
    assert not segments.update(spark.createDataFrame(batch, SCHEMA), deleted, path, 4)
    assert segments.committed(spark, path) == [0, 1, 2, 3, 4]
    filters = {"publishers": ["p1", "p2"], "priorities": ["track"]}
    assert answers(segments.find(spark, path, ASKED, filters)) == rebuilt(spark, docs, filters)
    segments.merged(spark, path, f"{path}-2")
    assert segments.committed(spark, f"{path}-2") == [0]
    assert answers(segments.find(spark, f"{path}-2", ASKED)) == rebuilt(spark, docs)
    assert spark.read.parquet(f"{path}-2/documents").count() == len(docs)
    # The merged index is kept up like any other.
    segments.update(spark.createDataFrame([], SCHEMA), spark.createDataFrame([(k,) for k in docs], "id string"), f"{path}-2", 1)
    assert answers(segments.find(spark, f"{path}-2", ASKED)) == []


def test_a_half_written_segment_does_not_count(spark, tmp_path):
    rng, path = random.Random(5), f"file://{tmp_path}/index"
    docs = {d[0]: d for d in (document(rng, i) for i in range(20))}
    segments.create(spark.createDataFrame(list(docs.values()), SCHEMA), path)
    none = spark.createDataFrame([], "id string")
    twice = spark.createDataFrame([document(rng, 3), document(rng, 3)], SCHEMA)
    with pytest.raises(ValueError, match="differ"):
        segments.update(twice, none, path, 2)
    assert answers(segments.find(spark, path, ASKED)) == rebuilt(spark, docs)
    new = document(rng, 3)
    assert segments.update(spark.createDataFrame([new], SCHEMA), none, path, 2)
    assert answers(segments.find(spark, path, ASKED)) == rebuilt(spark, docs | {new[0]: new})
    with pytest.raises(ValueError, match="comes after"):
        segments.update(twice, none, path, 1)


def test_an_empty_index(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    segments.create(spark.createDataFrame([], SCHEMA), path)
    assert answers(segments.find(spark, path, ASKED)) == []
    one = ("x", "p", None, None, None, "audit cost")
    segments.update(spark.createDataFrame([one], SCHEMA), spark.createDataFrame([("x",)], "id string"), path, 1)
    assert answers(segments.find(spark, path, ASKED)) == rebuilt(spark, {"x": one})
