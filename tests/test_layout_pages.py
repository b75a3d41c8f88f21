"""Words on pages are read page by page: no word is shuffled, joined or sorted by Spark."""

import random

import pytest

from quillspan import catalog
from quillspan.operators import layout
from tests.oracle import SMALL

ROW = [("Line", 10.0, 30.0, 60.0), ("1", 40.0, 45.0, 61.0), ("....", 60.0, 110.0, 60.0)]
HEAD = [(f"Q{i % 4 + 1}", 200.0 + 50 * i, 210.0 + 50 * i, 40.0 + i % 2) for i in range(8)] + [("2025", 270.0, 290.0, 30.0), ("2026", 470.0, 490.0, 30.0)]
KIND = "doc int, page int, word string, x0 double, x1 double, top double"


def test_line_numbers():
    assert layout.line_numbers([5.0, 6.6, 6.7, None, 8.4, float("nan"), 5.0]) == [1, 1, 2, 0, 3, 4, 1]
    rng = random.Random(5)
    for _ in range(50):
        tops = [rng.randint(0, 40) / 4 for _ in range(rng.randint(0, 30))]
        starts = []
        for t in sorted(tops):
            starts += [t] if not starts or t - starts[-1] > layout.SAME_LINE else []
        assert layout.line_numbers(tops) == [sum(s <= t for s in starts) for t in tops]


def test_lines_of_odd_places():
    got = layout.page_lines(["b", None, "a", "c"], [2.0, 1.0, None, float("nan")], [1.0] * 4, [1.0] * 4)
    assert [w for *_, w in got[0][1]] == ["a", None, "b", "c"]


def test_captions_and_cells_of_pages(spark):
    values = [("1.0", 201.0, 215.0, 60.5), ("-", 255.0, 265.0, 60.0), ("W", 549.0, 561.0, 61.0)]
    rows = [(1, 1, *w) for w in HEAD + ROW + values] + [(1, 2, "x", 1.0, 2.0, 3.0), (1, 3, "Table", 1.0, 2.0, 3.0), (1, 3, "7b.", 3.0, 4.0, 3.5), (1, 4, None, None, 1.0, None)]
    pages = layout.by_page(spark.createDataFrame(rows, KIND), ["doc", "page"])
    assert sorted(map(tuple, layout.page_captions(pages, "doc", "page").collect())) == [(1, 1, None), (1, 2, None), (1, 3, "Table 7b."), (1, 4, "Table 7b.")]
    found = layout.cells(pages, ["doc", "page"])
    assert sorted(map(tuple, found.collect())) == [(1, 1, 3, "Line 1", 0, "2025Q1", "1.0"), (1, 1, 3, "Line 1", 1, "2025Q2", "-"), (1, 1, 3, "Line 1", 7, "2026Q4", "W")]
    assert layout.dense(found, ["doc", "page", "label"], 8).first()["values"] == ["1.0", "-", "", "", "", "", "", "W"]


@pytest.mark.parametrize("name", ["page_cells", "page_captions", "dense_rows", "bbox_words"])
def test_words_are_not_joined(spark, name):
    plan = catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "xmltostructs" not in plan  # items and their orders


def test_boxes_keep_all_text():
    word = lambda x: f"<html><body><doc><page/><page><flow><block><line>{x}</line></block></flow></page></doc></body></html>"
    assert layout.read_boxes(word('<word xMin="1" yMin="2" xMax="1,000"> a<i>b</i>&amp;c </word>')) == [[], [("a&c", 1.0, 1000.0, 2.0)]]
    assert layout.read_boxes(word("<word/>") + "tail") == [[], [("", None, None, None)]]
    assert layout.read_boxes(word("<word/>")[:-3]) == layout.read_boxes(word('<word xMin="x"/>')) == layout.read_boxes(None) == []
