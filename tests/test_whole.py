"""Queries whose inputs are whole texts, against what prefixes of them would leave out."""

import csv
import html
import io

from inkwell.plans import registry


def written(spark, tmp_path, texts):
    """A documents table of these texts (with no labels); its folder."""
    rows = [(i, t, "en", f"src{i}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_captions_are_deduplicated_over_the_whole_file(spark, tmp_path):
    lines = [f"line {i % 3000} of the talk" for i in range(4000)] + ["late", "line 0 of the talk", "late"]
    sf = written(spark, tmp_path, ["\n".join(lines), "a\nb\na"])
    got = {r.doc_id: r.transcript for r in registry.QUERIES["vtt_dedup_whole"](spark, sf).collect()}
    assert got == {0: "\n\n".join(dict.fromkeys(x.replace("the", "R&D") for x in lines)), 1: "a\n\nb"}


def test_a_manifest_quotes_whole_contents(spark, tmp_path):
    late = f'first line\n{"x" * 100}, "quoted", ""twice""\nlast "line"'
    sf = written(spark, tmp_path, [late, None])
    got = {r.doc_id: next(csv.reader(io.StringIO(r.line, newline=""), strict=True)) for r in registry.QUERIES["manifest_whole"](spark, sf).collect()}
    assert {i: (r[2], r[5]) for i, r in got.items()} == {0: ("first line", late), 1: ("", "")}


def test_whole_texts_are_escaped(spark, tmp_path):
    late = "a" * 60 + " <b> & \"c\" 'd' é\n" + "x" * 5000 + "<"
    sf = written(spark, tmp_path, [late, None])
    got = {r.id: r.escaped for r in registry.QUERIES["first_paragraphs"](spark, sf).collect()}
    assert got == {0: html.escape(late).replace("&#x27;", "&#39;"), 1: ""}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1] / max(len(a), len(b), 1)


def test_whole_labels_are_compared(spark, tmp_path):
    same = "same words " * 5
    labels = [(f"{same}and é late end", f"{same}and è other end"), ("漢字", "漢語 x"), ("one line", ""), ("", ""), ("t" * 110, "t" * 300)]
    sf = written(spark, tmp_path, ["\n".join(x) for x in labels])
    got = {r.id: r.distance for r in registry.QUERIES["label_distance_whole"](spark, sf).collect()}
    assert got == {f"doc-{i:06d}": round(distance(*x), 9) for i, x in enumerate(labels)}
