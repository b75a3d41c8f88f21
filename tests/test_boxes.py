"""Files of boxes: plain words go past the parser and are read as it reads them, and no written text is shuffled."""

import pytest

from quillspan import catalog
from quillspan.operators import layout
from tests.oracle import SMALL

WORD = '<word xMin="1.5" yMin="2" xMax="3" yMax="0">a&amp;b </word>'
LINE = "<html><body><doc><page><flow><block><line>{}</line></block></flow></page></doc></body></html>"


def test_plain_words_need_no_parser():
    rest, words = layout._plain_words(LINE.format(WORD + "\n" + WORD))
    assert "<word " not in rest and len(words) == 2
    assert layout.read_boxes(LINE.format(WORD)) == [[("a&b", 1.5, 3.0, 2.0)]]
    assert layout.read_boxes(LINE.format(WORD + WORD.replace(" yMax", "  yMax") + "<word/>" + WORD)) == [[("a&b", 1.5, 3.0, 2.0)] * 2 + [("", None, None, None), ("a&b", 1.5, 3.0, 2.0)]]


@pytest.mark.parametrize(
    "xml",
    [
        LINE.format(f"<!-- {WORD} -->"), LINE.format(f"<!-- {WORD.replace('a', '--')} -->"), LINE.format(f"<word><![CDATA[{WORD}]]></word>"), LINE.format(f"<word>a{WORD}b</word>"), LINE.format("<?words 0 1?>" + WORD),
        WORD, WORD + LINE.format(WORD), LINE.format(WORD) + WORD, LINE.format(WORD)[:-1], LINE.format(WORD.replace("1.5", "1.5.")), LINE.format(WORD.replace("&amp;", "&x;")), LINE.format(WORD.replace("a&amp;", "\ud800")),
        '<!DOCTYPE html [<!ENTITY x "y">]>' + LINE.format(WORD.replace("amp", "x")), "<!DOCTYPE html>" + LINE.format(WORD), LINE.format(WORD).replace("<body>", f"<body><doc>{WORD}</doc></body><body>"),
    ],
)
def test_what_looks_like_a_word(xml, monkeypatch):
    got = layout.read_boxes(xml)
    monkeypatch.setattr(layout, "_plain_words", lambda xml: (xml, layout.pa.array([], layout.WORD)))
    assert got == layout.read_boxes(xml)


def test_no_text_is_shuffled(spark):
    plan = catalog.QUERIES["bbox_words"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.index("ArrowEvalPython") < plan.index("<page>") < plan.index("Exchange")
