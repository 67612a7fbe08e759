"""Operator 11 against a plain tree."""

import hashlib

import pytest
from cases import empty, frame, rows
from pyspark.sql import functions as F

from inkwell.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS))


def plain(data, change):
    """One tuple a row, sorted: id, leaf, subroot, root, proof, folded root, verified. Equal rows take their places in turn."""

    def tree(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
        return out

    groups = {}
    for row in data:
        groups.setdefault(row["lang"], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {g: tree([leaf(r) for r in groups[g]]) for g in names}
    top = tree([trees[g][-1][0] for g in names]) if names else []
    out = []
    for k, g in enumerate(names):
        for i, row in enumerate(groups[g]):
            node, siblings = leaf({**row, **change(row)}), []
            for nodes, at in [*((n, i // 8**d) for d, n in enumerate(trees[g][:-1])), *((n, k // 8**d) for d, n in enumerate(top[:-1]))]:
                first = at // 8 * 8
                before, after = "".join(nodes[first:at]), "".join(nodes[at + 1 : first + 8])
                siblings.append(before + after)
                node = sha(before + node + after)
            out.append((row["doc_id"], leaf(row), trees[g][-1][0], top[-1][0], sha("".join(siblings)), node, node == top[-1][0]))
    return sorted(out, key=repr)


def lower(row):
    if row["doc_id"] is None or row["doc_id"] % 3 or row["text"] is None:
        return {}
    return {"text": "".join(c.lower() if "A" <= c <= "Z" else c for c in row["text"])}


def proved(docs, **more):
    found = merkle.manifest(docs, changed=F.col("doc_id") % 3 == 0, changes={"text": merkle.lowered(F.col("text"))}, **more)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, found.collect()), key=repr)


def dicts(data):
    return [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=False)) for r in data]


def test_nulls_ties_repeats_long_texts_and_clashing_columns(spark):
    data = rows()
    assert proved(frame(spark, data)) == plain(dicts(data), lower)
    assert merkle.manifest(empty(spark)).count() == 0


@pytest.mark.parametrize("n", [1, 7, 8, 9, 64, 65, 512, 513, 1100, 4097])
def test_any_number_of_rows(spark, n):
    """One large group and small ones: runs of one, full blocks, blocks of one leaf."""
    data = [(i * 7 % 5003, f"Text {i} É", "en" if i % 40 else ["fr", None, "Ä", ""][i // 40 % 4], None if i % 3 else "s", i) for i in range(n)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    want = plain(dicts(data), lower)
    assert proved(docs) == want
    assert proved(docs, top=3) == want  # higher blocks
    assert {r[-1] for r in want if r[0] % 3} <= {True}


def test_equal_rows_of_null_and_equal_ids(spark):
    data = [(None, "Same", "en", "s", 1)] * 700 + [(5, "Same", "en", "s", 1)] * 300 + [(6, f"T{i % 4}", None, None, None) for i in range(40)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert proved(docs) == plain(dicts(data), lower)


def test_a_changed_value_is_found_wherever_it_is(spark):
    data = [(i, "text", "en", "s", 1) for i in range(900)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    for change in ({"source": F.lit(None)}, {"n_chars": F.lit(2)}, {"lang": F.lit("fr")}, {"text": F.lit("texT")}):
        found = merkle.manifest(docs, changed=F.col("doc_id").isin(3, 899), changes=change)
        assert [r.doc_id for r in found.where("not verified").orderBy("doc_id").collect()] == [3, 899]
    # Values can't slip from one field into the next.
    assert leaf({"doc_id": 1, "source": "a", "lang": "bc", "n_chars": 1, "text": None}) != leaf({"doc_id": 1, "source": "ab", "lang": "c", "n_chars": 1, "text": None})
    one = spark.createDataFrame([(1, None, "bc", "a", 1)], docs.schema)
    assert merkle.manifest(one).first().leaf == leaf({"doc_id": 1, "source": "a", "lang": "bc", "n_chars": 1, "text": None})


def test_too_many_groups_are_refused(spark, monkeypatch):
    monkeypatch.setattr(merkle, "GROUPS", 20)
    docs = spark.range(60).selectExpr("id doc_id", "string(id) text", "string(id % 30) lang", "'s' source", "1L n_chars")
    with pytest.raises(ValueError, match="groups"):
        merkle.manifest(docs)
