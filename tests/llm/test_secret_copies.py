"""Ownership of values in copied documents and in many documents of one owner."""

import random

from cases import frame

from inkwell.llm import secrets


def test_copies_and_documents_of_one_owner_do_not_make_a_value_copied(spark):
    values = {"one": "q7Xw93kLmZ0pRt5Vb8Nc2", "copies": "b4Hn71sTgY6uJe0Ka9Wd5", "spread": "z1Cf85vQoM3iLx2Gr7Ps4", "many": "Example0Key1Value2Copied3"}
    carriers = [("one", f"document {i}", "s1") for i in range(60)]  # one owner, beyond any cap
    carriers += [("copies", "one text", f"s{i % 2}") for i in range(60)]  # one text
    carriers += [("spread", f"text {i}", f"s{i % 2}") for i in range(60)]  # two owners, 60 texts: no number of texts makes it copied
    carriers += [("many", f"text {i}", f"s{i}") for i in range(3)]  # three owners
    data = [(i, f"{text} password = '{values[kind]}' bare {values[kind]}", None, owner, 0, "", 0, 0, 0, "", 0) for i, (kind, text, owner) in enumerate(carriers)]
    got = {r.doc_id: (r.n_live, r.n_copied, "token:" in r.spans) for r in secrets.scan(frame(spark, data)).collect()}
    assert got == {i: (1, 0, True) if kind != "many" else (0, 1, False) for i, (kind, _, _) in enumerate(carriers)}


def test_ownership_adds_and_drops_spans(spark):
    """The same tokens among few owners and among many, outside of any base span; figures over a table."""
    rng = random.Random(3)
    token = lambda: "".join(rng.choice("abcdefghijkXYZ0123456789") for _ in range(24)) + "a1"
    own, copied = [token() for _ in range(20)], [token() for _ in range(20)]
    rows = [(f"note {i} {v} end", f"s{i % 20}", v) for k in range(3) for i, v in enumerate(own)]
    rows += [(f"example {i} {v} end {k}", f"s{(i + k) % 20}", v) for k in range(5) for i, v in enumerate(copied)]
    data = [(i, t, None, o, 0, "", 0, 0, 0, "", 0) for i, (t, o, _) in enumerate(rows)]
    got = {r.doc_id: r for r in secrets.scan(frame(spark, data)).collect()}
    added = [i for i, r in got.items() if "token:" in r.spans]
    assert sorted(added) == [i for i, (_, _, v) in enumerate(rows) if v in own]
    assert all(got[i].base == "" and got[i].n_repos == 1 for i in added)
