"""Legends below answers, and the verdict over all checks."""

from quillspan.operators import citations


def test_legend_has_the_worst_level_first_and_once(spark):
    pages = spark.createDataFrame([(1, "geometry", "A, май 2026, с. 2"), (1, "disputed", "A, май 2026, с. 1; B, июнь 2026, с. 3–4"), (2, "unchecked", "C, май 2026, с. 9")], "k int, level string, pages string")
    answers = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "k int, answer string")
    advice = {"disputed": "look", "unchecked": "ask", "geometry": "count"}
    legends = citations.legend(pages, ["k"], advice)
    once = citations.with_legend(answers, legends, ["k"])
    got = {r.k: r.answer for r in once.collect()}
    assert got[3] == "three" and got[2] == "two\n\n---\n* **сверка чтения не выполнялась** (C, май 2026, с. 9) — ask"
    assert got[1].split("\n")[3:] == ["* **⚠ два пути чтения расходятся по цифрам** (A, май 2026, с. 1; B, июнь 2026, с. 3–4) — look", "* **текст собран по геометрии страницы** (A, май 2026, с. 2) — count"]
    assert {r.k: r.answer for r in citations.with_legend(once, legends, ["k"]).collect()} == got


def test_nothing_checked_is_not_well(spark):
    rows = [("a", 2, 0, 0, 1, True), ("a", 1, 0, 0, 0, True), ("b", 0, 0, 0, 3, False), ("c", 4, 1, 0, 0, False), ("d", 1, 0, 2, 0, False)]
    totals = spark.createDataFrame(rows, "g string, checked long, missing long, unmarked long, web long, ok boolean")
    got = {r.g: (r.answers, r.failed, r.checked, r.verdict) for r in citations.check_summary(totals, "g").collect()}
    assert got == {"a": (2, 0, 3, "ok"), "b": (1, 1, 0, "nothing checked"), "c": (1, 1, 4, "failed"), "d": (1, 1, 1, "failed"), None: (5, 3, 8, "failed")}
    assert [r.verdict for r in citations.check_summary(totals.where("g = 'b'"), "g").where("g IS NULL").collect()] == ["nothing checked"]
