"""Tables by where words stand: golden pages."""

from __future__ import annotations

from tidewell.operators import layout

WORDS = "doc_id long, page int, x0 double, x1 double, top double, bottom double, text string"


def boxes(page, lines, top=0.0):
    """Lines of ``(x0, text)`` words, ten points high, twenty apart, five points a letter."""
    return [(1, page, float(x), float(x + 5 * len(t)), top + 20 * i, top + 20 * i + 10, t) for i, line in enumerate(lines) for x, t in line]


def test_golden_pages(spark):
    table = [[(10, "Plan"), (100, "Price")], [(11, "Value"), (38, "20"), (101, "$20")], [(10, "a|b"), (99, "$5")]]
    one = boxes(1, [[(0, "Our"), (20, "plans:")], *table, [(0, "See"), (18, "shop")]])
    two = boxes(2, [[(0, "left"), (100, "right")], [(0, "one"), (60, "two"), (120, "three")], [(0, "x"), (60, "y")], [(30, "x"), (90, "y")]])
    three = boxes(3, table[:2]) + boxes(3, [[(0, "between")]], 40.0) + boxes(3, [[(10, "p"), (100, "q")], [(10, "r"), (100, "s")]], 60.0)
    odd = [(1, 4, None, 1.0, 0.0, 1.0, "no"), (1, 4, 0.0, 1.0, 0.0, 1.0, ""), (1, 4, 0.0, 1.0, 0.0, 1.0, None), (None, 5, 0.0, 5.0, 0.0, 10.0, "lone")]
    words = spark.createDataFrame(one + two + three + odd, WORDS)
    found = {(r.page, r.table_no): r for r in layout.tables(words).collect()}
    assert sorted(found) == [(1, 1), (3, 1), (3, 2)]
    assert found[1, 1].rows == [["Plan", "Price"], ["Value 20", "$20"], ["a|b", "$5"]] and (found[1, 1].x0, found[1, 1].top, found[1, 1].bottom) == (10, 20, 70)
    assert found[1, 1].markdown.split("\n")[1:] == ["| --- | --- |", "| Value 20 | $20 |", "| a\\|b | $5 |"]
    texts = {(r.doc_id, r.page): r.text for r in layout.page_texts(words).collect()}
    assert texts[1, 1] == "Our plans:\nSee shop\n\n" + found[1, 1].markdown
    assert texts[1, 2] == "left right\none two three\nx y\nx y"
    assert texts[1, 3] == "between\n\n" + found[3, 1].markdown + "\n\n" + found[3, 2].markdown and texts[None, 5] == "lone" and len(texts) == 4
    assert layout.page_texts(words.limit(0)).collect() == []


def test_words_in_a_box_leave_the_body(spark):
    rows = boxes(1, [[(0, "a"), (100, "b")], [(0, "c"), (100, "d")]]) + [(1, 1, 40.0, 60.0, 14.0, 17.0, "stamp"), (1, 1, 40.0, 60.0, 80.0, 90.0, "below")]
    words = spark.createDataFrame(rows, WORDS)
    assert {r.text for r in layout.body_words(words, layout.tables(words.where("text <> 'stamp'"))).collect()} == {"below"}
