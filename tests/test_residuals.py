"""Tokens that one reading has more often than another: told page by page, without a shuffle of tokens."""

import random
from collections import Counter

from quillspan.operators import pages, readings


def test_left_over():
    assert pages.left_over(["a", "b", "a", None, "a"], ["a", None, "c"]) == [(1, "b"), (2, "a"), (4, "a")]
    rng = random.Random(3)
    for _ in range(50):
        a, b = ([rng.choice("xyz") for _ in range(rng.randint(0, 9))] for _ in "ab")
        assert Counter(t for _, t in pages.left_over(a, b)) == Counter(a) - Counter(b)


def test_residual_shuffles_nothing(spark):
    out = pages.residual(spark.createDataFrame([(1, ["a", "1", "a"], ["a", ""]), (2, None, ["a"]), (3, ["x"], None)], "doc_id long, left array<string>, right array<string>"))
    assert sorted(map(tuple, out.collect())) == [(1, 1, "1"), (1, 2, "a"), (3, 0, "x")]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_numbers_of_pages_meet_once(spark):
    rows = [(1, "layout", "1 2 2"), (1, "stream", "2 3 1"), (2, "layout", "5 6"), (2, "stream", "6 5"), (3, "layout", "7"), (4, "stream", "8"), (4, "plain", "9"), (5, "layout", None), (5, "stream", ""), (6, "layout", "1"), (6, "layout", "2"), (6, "stream", "2")]
    out = readings.residuals(spark.createDataFrame(rows, "page int, reader string, text string"), ["page"], "layout", "stream")
    assert sorted(map(tuple, out.collect())) == [(1, ["2"], ["3"]), (3, ["7"], []), (4, [], ["8"]), (6, ["1"], [])]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
