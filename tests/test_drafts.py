"""Edits against their baselines: qualifiers, alignment, structures, furniture."""

import pytest

from inkwell.functions import drafts, lexicon, qualifiers


def facts(text):
    return [(a.number, a.qualifier) for a in drafts.Draft(text).anchors]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("US$5 million and HK$ 3", [("5", "scale:million|currency:USD"), ("3", "currency:HKD")]),
        ("5km, 1 ton, 2 kilometer, 3 basis point, 4 kilowatt hour", [("5", "unit:km"), ("1", "unit:tonne"), ("2", "unit:km"), ("3", "unit:basis_point"), ("4", "unit:kWh")]),
        ("3.5万亿美元，30 个月", [("3.5", "scale:trillion|currency:USD"), ("30", "unit:month")]),
        ("产值30元素", [("30", "")]),
        ("Revenue 5 rose by the dollar", [("5", "")]),
        ("The share in percent was 40 in all", [("40", "")]),
        ("measured in kilometers it is 40 or 50", [("40", "unit:km"), ("50", "")]),
        ("以百万美元计，收入为 30。按吨计算 7", [("30", "scale:million|currency:USD"), ("7", "unit:tonne")]),
        ("measured in kg" + " " * 33 + "40", [("40", "")]),
        ("5% expressed in percent 6", [("5", "rate:percent"), ("6", "rate:percent")]),
        ("a 1.5 b. 2 km", [("1.5", ""), ("2", "unit:km")]),
        ("`5%` and\n\n    6%\n\n```\n7%\n```", []),
        ("5 minutes later\n\n8 tokens", [("5", ""), ("8", "unit:token")]),
        ("5 min read\n\n8 tokens", [("8", "unit:token")]),
    ],
)
def test_numbers_take_own_and_cued_qualifiers(text, want):
    assert facts(text) == want


def test_tables_and_captions_share_a_qualifier():
    table = "| item (million US$) | n |\n|---|---|\n| a | 5 |"
    assert ("shared", "scale:million|currency:USD") in facts(table)
    assert ("shared", "unit:tonne") in facts("图 1：产量（单位：吨）\n2024 年 50")
    assert facts("图 1：产量（吨）") == [("1", "")]
    assert ("shared", "unit:km") not in facts("plain (km) text 5")


def test_cues_overlapping_an_own_qualifier_are_dropped():
    assert facts("unit: kg 5, 7 kg") == [("5", "unit:kg"), ("7", "unit:kg")]
    assert qualifiers.canonical("Ｋｍ") == "unit:km" and qualifiers.canonical("nothing") == ""


def test_fixed_tables_are_whole():
    assert [len(v) for v in lexicon.NOISE.values()] == [11, 7, 8, 5, 8]
    assert [len(v) for v in lexicon.QUALIFIERS.values()] == [2, 5, 8, 19]


def codes(before, edited, original=None):
    return [(code, item) for code, _, _, item, _ in drafts.issues(before if original is None else original, before, edited)]


def test_alignment_names_the_item_that_is_missing():
    before = "# A\n\n## Costs\n\n## Growth\n\n## Risks"
    assert codes(before, "# A\n\n## Costs!\n\n## Risks") == [("missing_heading", "## Growth")]
    # Equal items: the later ones pair up.
    items = [drafts.Item(i, 1, "same", str(i)) for i in range(3)]
    assert drafts.align(items, items[:1]) == ([0, 1], [(2, 0)])
    assert drafts.align([], items) == ([], []) and drafts.align(items, []) == ([0, 1, 2], [])
    # An item of another sign never pairs; a label too far off costs more than two gaps.
    other = [drafts.Item(0, 2, "same", "x")]
    assert drafts.align(items[:1], other) == ([0], [])


def test_list_items_tables_and_links():
    assert codes("- a\n- b\n1. c", "- a\n1. c") == [("missing_list_item", "- b")]
    assert codes("- a\n  - b", "- a\n- b") == [("missing_list_item", "  - b")]
    table = "| h | i |\n|---|---|\n| x | y |\n| z | w |"
    assert codes(table, "gone") == [("missing_table", "| h | i |")]
    assert codes(table, "| h |\n|---|\n| x |\n| z |") == [("missing_table_column", '2 "i"')]
    assert codes(table, "| h | i |\n|---|---|\n| x | y |") == [("missing_table_row", "| h | i |")]
    assert codes("[a](p) ![i](q) [r][d]\n\n[d]: z", "[a](p) ![i](q) [r](z)") == []
    assert codes("[a](p) ![i](q)", "") == [("missing_markdown_link", "[a](p)"), ("missing_image", "![i](q)")]
    assert codes("[r][d]\n\n[d]: z", "[r][d]") == [("missing_reference_link", "[r][d]"), ("missing_link_definition", "[d]: z")]
    assert codes("x[^n] y[^n]\n\n[^n]: t", "x[^n]\n\n[^n]: t") == [("missing_footnote_reference", "[^n]")]


def test_facts_are_compared_block_by_block():
    assert codes("5 km\n\n6 kg", "6 km\n\n5 kg") == [("missing_factual_qualifier", "5 km"), ("missing_factual_qualifier", "6 kg")]
    assert codes("5 km\n\n6 kg", "6 kg\n\n5 km") == [("missing_factual_qualifier", "5 km"), ("missing_factual_qualifier", "6 kg")]
    assert codes("text", "text", original="text\n\n7 kg") == [("missing_numeric_token", "7"), ("missing_factual_qualifier", "7 kg")]
    assert codes("5 km", "5 km", original="5 km\n\n5 km") == [("missing_numeric_token", "5")]


def test_lines_are_those_of_the_text_with_furniture():
    before = "Share\nPrint\n\n# A\n\n- b 5 km"
    assert [x[:3] for x in drafts.issues(before, before, "# A")] == [("missing_numeric_token", 6, 5), ("missing_factual_qualifier", 6, 5), ("missing_list_item", 6, 1)]
    cleaned, gone = drafts.Draft(before).cleaned()
    assert cleaned.text == "# A\n\n- b 5 km" and gone == [(1, "save_share_print", "Share\nPrint")]
    assert drafts.length_ratio("", "") == 1.0 and drafts.length_ratio("Share", "x") is None


def test_code_is_found_inside_lists_and_fences():
    text = "- a\n\n      code\n  more\n\n~~~ x\n# no\n~~~\n\n# yes\n\n```\n# open"
    draft = drafts.Draft(text)
    assert [x.text for x in draft.headings()] == ["# yes"]
    assert [x.code for x in draft.lines][:4] == [False, False, True, False]
    assert drafts.Draft("a ``x `5%` y`` 6%").lines[0].text == "a" + " " * 14 + "6%"


def test_labels_are_folded():
    assert drafts.distance("Ｃｌｏｕｄ!", "cloud") == 0.0 and drafts.distance("", "…") == 0.0 and drafts.distance("a", "") == 1.0
    assert drafts.edits("kitten", "sitting") == 3 and drafts.edits("", "ab") == 2
