"""Each text of an edit is scanned once, however many checks read it."""

import pytest

from inkwell.functions import drafts, markdown, qualifiers
from inkwell.operators import editorial
from inkwell.sources import adapters, digests

TEXT = "# H\n\nShare\n\n- 5 km\n\nSee 7% of 12 `x`.\n"


@pytest.fixture
def scans(monkeypatch):
    """Texts whose lines were scanned; operators give the function that they run on a row."""
    seen: list[str] = []
    coded = drafts._coded
    monkeypatch.setattr(drafts, "_coded", lambda rows: seen.append("".join(rows)) or coded(rows))
    monkeypatch.setattr(editorial, "rows_of", lambda docs, inputs, make, fields: make)
    return seen


def test_a_review_scans_each_text_once(scans):
    make = editorial.review(None, "o", "b", "e")
    ((issues, risks, removed, *_),) = make(TEXT, TEXT, TEXT.replace("5", "6"))
    assert (issues, risks, removed) == (2, 1, 1)
    assert len(scans) == 3  # the text, the text without furniture, the edit


def test_letters_that_equal_others_but_for_case_are_found():
    """What a text must hold before a qualifier is looked for leaves none out."""
    key = lambda t: [(a.number, a.qualifier) for a in drafts.Draft(t).anchors]
    assert key("3 ſeconds and 4 Kg") == [("3", "unit:second"), ("4", "unit:kg")]
    for _, _, name, _, local, needles in qualifiers._DEFINITIONS:
        assert needles or local, name


def test_issues_scan_equal_baselines_once(scans):
    found = editorial.issues(None, "o", "b", "e")(TEXT, TEXT, TEXT)
    assert found == [] and len(scans) == 2  # the text, which is the edit as well, and it without furniture


def test_polishing_looks_for_each_texts_facts_once(monkeypatch):
    seen, facts = [], markdown.facts
    monkeypatch.setattr(markdown, "facts", lambda text: seen.append(text) or facts(text))
    assert ("missing_fact", "5|unit:km", 1) in markdown.polished(TEXT, TEXT, TEXT.replace("5 km", "5"))
    assert len(seen) == 2  # the text without furniture and the edit


def test_a_digest_is_parsed_once_and_a_selector_read_once(spark, monkeypatch):
    seen = []
    html = "<title>D</title>" + "".join(f"<article class='article-card' data-radar-id='r{k}'><h3>T{k}</h3><footer><a href='https://x.example/{k}'>s</a></footer></article>" for k in range(1200))
    parsed = adapters.tree(html)
    monkeypatch.setattr(digests.re, "fullmatch", lambda *a, f=digests.re.fullmatch: seen.append(a) or f(*a))
    digests._selector.cache_clear()
    assert len(parsed.find("article.article-card")) == len(parsed.find("h3")) == 1200
    assert len(seen) == 2
    assert adapters.records(parsed, "mit", "MIT") == adapters.records(html, "mit", "MIT")
    rows = spark.createDataFrame([("a", html, "mit", "MIT", "D", 1200), ("b", "<title>D</title>", "mit", "MIT", "D", 0)], "digest string, html string, adapter string, publisher string, title string, expected int")
    assert adapters.scan(rows).groupBy("digest").count().collect() == [("a", 1200)]
