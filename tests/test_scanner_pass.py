"""The quick ways of the scanner are those of its patterns, and streams of line items need one shuffle of them."""

import random
import re

from quillspan.operators import reports, scanner
from tests.oracle import SMALL


def test_numbers_and_widths_as_by_pattern():
    rng, parts = random.Random(2), ["1", "2,", ",", ".", "-", " ", "a", "\n", "1.5,", "3,4", "٣", "... ", "Steel ..... 1 2 3 4", "... 1 2 - 4 "]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 30)))
        near, leader = sorted(rng.randint(0, len(text)) for _ in range(2))
        want = near + max((m.end() for m in scanner.NUMBERS.finditer(text[near:leader])), default=0)
        assert scanner.Labels(text, [])._number_before(near, leader) == want
        for _, what, _, row, width in scanner.scan(text, set()):
            assert what != scanner.ROW_AT or width == sum(bool(re.fullmatch(scanner.VALUE, w)) for w in row[scanner.LEADERS.search(row).end() :].split())


def test_items_of_an_order_are_shuffled_once(spark):
    plan = reports.streams_of(reports._pages(spark, SMALL), ["l_orderkey"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
