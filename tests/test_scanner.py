"""Labels of table rows: where they begin, with numbers inside them, in the middle of lines, and next to captions and sections."""

import random

import pytest

from quillspan.operators import scanner

DOTS = " ........ "
CASES = [
    # text, barriers (as words of the text), labels
    ("United States" + DOTS + "1.0 2.0 3.0 4.0", [], ["United States"]),
    ("Norway" + DOTS + "1 2 3 4 Chad" + DOTS + "5 6 7 8\n", [], ["Norway", "Chad"]),
    ("Norway" + DOTS + "1 2 - -\nCongo (a)" + DOTS + "5 6 7 8\n", [], ["Norway", "Congo (a)"]),
    ("Norway" + DOTS + "1 2 - - Congo" + DOTS + "5 6 7 8\n", [], ["Norway", "Congo"]),
    ("Upper 24 regions" + DOTS + "1 2 3 4", [], ["Upper 24 regions"]),
    ("Norway" + DOTS + "1 2 3 4\nUpper 24 regions" + DOTS + "1 2 3 4", [], ["Norway", "Upper 24 regions"]),
    ("Price deflator\n(index, 2012=100)" + DOTS + "7 8 9 10", [], ["Price deflator\n(index, 2012=100)"]),
    ("Housing (millions - rate)" + DOTS + "7 8 9 10", [], ["Housing (millions - rate)"]),
    ("Energy Use\nCrude Oil" + DOTS + "7 8 9 10", ["Energy Use"], ["Crude Oil"]),
    ("Indices (base 2017=100)\nSteel" + DOTS + "7 8 9 10", ["Indices (base 2017=100)"], ["Steel"]),
    ("Oil Energy Use out" + DOTS + "7 8 9 10", ["Energy Use"], ["out"]),
    ("Q1 Q2 Q3 2025\nSteel 5 made" + DOTS + "7 8 9 10", [], ["Steel 5 made"]),
    ("11 12 13 tons of steel" + DOTS + "7 8 9 10", [], ["tons of steel"]),
    ("Prose that ends... and goes on. Steel" + DOTS + "7 8 9 10", [], ["Prose that ends... and goes on. Steel"]),
    ("item 5" + DOTS + "7 8 9 10", [], []),
    ("Steel" + DOTS + "7 8 9", [], []),
    ("Steel" + DOTS + "7 8 9\nIron" + DOTS + "1 2 3 4", [], ["Iron"]),
    ("Steel" + DOTS + "1,234.5 -2 - 4 text", [], ["Steel"]),
    ("a" * 300 + " word" + DOTS + "7 8 9 10", [], [("a" * 300 + " word")[-199:]]),
    ("", [], []),
]


@pytest.mark.parametrize("n", range(len(CASES)))
def test_labels(n):
    text, barriers, labels = CASES[n]
    found = scanner.table_rows(text, sorted((text.index(b), text.index(b) + len(b)) for b in barriers))
    assert [text[a:leader].rstrip(" ") for a, leader, _ in found] == labels


def plain_barrier(spans, at, leader):
    """Ends of the spans that begin before the leader and end after a place, of those that begin before that place only the last."""
    before = [s for s in spans if s[0] <= at]
    return max([s[1] for s in spans if at < s[0] < leader] + [s[1] for s in before[-1:] if s[1] > at], default=0)


def test_barriers_equal_a_plain_loop():
    rng = random.Random(5)
    for _ in range(300):
        spans = sorted({(a, a + rng.randint(1, 9)) for a in rng.sample(range(60), rng.randint(0, 8))})
        labels = scanner.Labels("x" * 80, spans)
        for at in range(0, 60, 7):
            assert labels._barrier(at, 60) == plain_barrier(spans, at, 60)


def test_rows_never_overlap_or_hold_barriers():
    rng, words = random.Random(6), ["Oil", "gas 12", "(a)", "-", "\n", "....", "7", "8,1", "9.5", "Use of Coal", "Q1", "2026", " "]
    for _ in range(400):
        text = " ".join(rng.choice(words) for _ in range(60))
        spans = [(i, i + 11) for i in range(len(text)) if text.startswith("Use of Coal", i)]
        done = 0
        for a, leader, z in scanner.table_rows(text, spans):
            assert done <= a < leader < z and leader - a <= scanner.LABEL_WITHIN and not text[a].isspace()
            assert not any(s < leader and e > a for s, e in spans) and text[leader - 1] != "."
            assert len([v for v in text[leader:z].lstrip(".").split() if v]) >= 4
            done = z


def test_all_events_in_order():
    text = "Table 1a. Oil Use in Summer\nQ1 Q2 Q3 Q4\n Energy Use \nOil" + DOTS + "1 2 3 4\n"
    got = [(what, t.strip(), width) for _, what, _, t, width in scanner.scan(text, {"Energy Use"})]
    assert got == [(scanner.CAPTION_AT, "Table 1a. Oil Use in Summer", None), (scanner.HEADER_AT, "Q1 Q2 Q3 Q4", 4), (scanner.SECTION_AT, "Energy Use", None), (scanner.ROW_AT, "Oil" + DOTS + "1 2 3 4", 4)]
