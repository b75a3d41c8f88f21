"""Pending questions along a conversation, and words from files of boxes."""

from quillspan.operators import layout, questions

CUT, SIZE, WAIVE, OTHER, WHOLE = "Что, если ОПЕК сократит добычу?", "на 2 млн барр/сут", "считай без сценария", "какая цена Brent", "если добыча вырастет на 2 mb/d"
TALKS = {
    "joined": ([CUT, SIZE, SIZE], ["asks", "joined", "asks"], [CUT, "Что, если ОПЕК сократит добычу " + SIZE, SIZE]),
    "waived": ([CUT, WAIVE, WAIVE], ["asks", "waived", "plain"], [CUT, CUT, WAIVE]),
    "dropped": ([CUT, OTHER, SIZE], ["asks", "plain", "asks"], [CUT, OTHER, SIZE]),
    "new question": ([CUT, WHOLE, SIZE], ["asks", "plain", "asks"], [CUT, WHOLE, SIZE]),
    "other order": ([SIZE, CUT, SIZE, CUT], ["asks", "joined", "asks", "joined"], [SIZE, f"{SIZE} {CUT}", SIZE, f"{SIZE} {CUT}"]),
    "asks again": ([CUT, CUT, SIZE], ["asks", "asks", "joined"], [CUT, CUT, "Что, если ОПЕК сократит добычу " + SIZE]),
    "nothing pending": ([WAIVE, None, WHOLE], ["plain", "plain", "plain"], [WAIVE, "", WHOLE]),
}


def test_outcomes_along_turns(spark):
    rows = [(k, n, q) for k, (said, _, _) in TALKS.items() for n, q in enumerate(said)]
    got = questions.clarified(spark.createDataFrame(rows, "talk string, turn int, question string"), ["talk"]).orderBy("talk", "turn").collect()
    for k, (_, outcomes, effective) in TALKS.items():
        assert [r.outcome for r in got if r.talk == k] == outcomes, k
        assert [r.effective for r in got if r.talk == k] == effective, k


def test_words_of_boxes(spark):
    page = '<page width="9"><flow><block><line><word xMin="1.5" yMin="2" xMax="3" yMax="4">A &amp; B</word><word xMin="4" yMin="2" xMax="5" yMax="4">c</word></line></block></flow></page>'
    empty = "<page><flow></flow></page>"
    files = [("a", f'<html xmlns="http://www.w3.org/1999/xhtml"><body><doc>{page}{empty}{page}</doc></body></html>'), ("b", "no xml"), ("c", None), ("d", "<html><body><doc></doc></body></html>")]
    got = sorted(map(tuple, layout.bbox_words(spark.createDataFrame(files, "path string, xml string")).collect()))
    assert got == [("a", n, *w) for n in (1, 3) for w in (("A & B", 1.5, 3.0, 2.0), ("c", 4.0, 5.0, 2.0))]
