"""Ledgers cut at many places equal what a JSON parser reads."""

import json
import random

import pytest

from inkwell.sources import ledgers


def value(rng, depth=0):
    kind = rng.randint(0, 6 if depth < 4 else 3)
    text = "".join(rng.choice('ab {}[]",:\\é漢\n') for _ in range(rng.randint(0, 25)))
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    if kind >= 5:
        return {f"k{i}": value(rng, depth + 1) for i in range(rng.randint(0, 4))}
    return [text, rng.randint(0, 9), None, True][kind]


def record(rng, i):
    return {"id": i, "text": "".join(rng.choice('xyz }{]["\\') for _ in range(rng.randint(0, 300))), "more": value(rng)}


def read(spark, path, **more):
    return sorted(json.dumps(json.loads(r.element), sort_keys=True) for r in ledgers.elements(spark, str(path), **more).collect())


def plain(records):
    return sorted(json.dumps(r, sort_keys=True) for r in records)


@pytest.fixture(params=["128m", "500b"])
def splits(spark, request):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    held = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], request.param)
    spark.conf.set(names[1], "1")
    yield request.param
    for n, v in held.items():
        spark.conf.set(n, v)


def test_arrays_and_objects_that_hold_one(spark, tmp_path, splits):
    rng = random.Random(4)
    rows = [record(rng, i) for i in range(25)]
    for name, made in (
        ("array", rows), ("named", {"run": {"articles": [{"id": -1}], "x": {"y": 1}}, "note": "articles", "other": [{"id": -2}], "articles": rows, "after": {"articles": {"id": -3}}}),
        ("nested", {"a": [[{"id": -4}], 1], "articles": [[{"id": -5}], *rows, None, 3, "x", [{"id": -6}]]}),
    ):
        for indent in (None, 2):
            path = tmp_path / f"{name}{indent}.json"
            path.write_text(json.dumps(made, ensure_ascii=bool(indent), indent=indent))
    assert read(spark, tmp_path / "*.json") == plain(rows * 6)


def test_one_long_element_over_many_splits(spark, tmp_path, splits):
    rows = [{"id": 1, "parts": [{"n": i, "t": "}" * (i % 3)} for i in range(200)]}, {"id": 2}, {"id": 3, "text": "long " * 800}]
    (tmp_path / "l.json").write_text(json.dumps({"articles": rows}))
    assert read(spark, tmp_path / "l.json") == plain(rows)


@pytest.mark.parametrize("text", ["", "[]", " \n[ ]\n", "{}", '{"articles": []}', '{"articles": null, "x": [{"id": 1}]}', "[1, \"a{}\", null]", '"{}"'])
def test_ledgers_without_records(spark, tmp_path, text):
    (tmp_path / "l.json").write_text(text)
    assert read(spark, tmp_path / "l.json") == []


def test_records_by_schema(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "y", "n": 1}, {"id": "z"}]')
    (tmp_path / "b.json").write_text('{"candidates": [{"id": "x", "n": 3, "more": {}}]}')
    assert sorted((r.id, r.n or 0) for r in ledgers.records(spark, str(tmp_path), "id: string, n: int", "candidates").collect()) == [("x", 3), ("y", 1), ("z", 0)]
