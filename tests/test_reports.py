"""Literal cases of forecasts, factors, questions, reports, readings and conversations."""

import random

import pytest
from pyspark.sql import functions as F

from quillspan.functions import text as t
from quillspan.operators import citations, dialogue, factors, forecast, layout, questions, readings, registers, reports, retrieval, series
from quillspan.sources import tables


def one(spark, column, *values):
    """What the expression, a function of a column, gives for each text."""
    return [r.x for r in spark.createDataFrame([(v,) for v in values], "s string").select(column(F.col("s")).alias("x")).collect()]


def test_cells_labels_and_names(spark):
    assert one(spark, factors.cell_number, "1,234.5", "−3", "–", "--", "NA", " 7 ", "x", None) == [1234.5, -3.0, None, None, None, 7.0, None, None]
    assert [str(x) for x in one(spark, factors.quarter_end, "2026Q1", "2026Q4", "2026", "")] == ["2026-03-31", "2026-12-31", "None", "None"]
    assert [str(x) for x in one(spark, factors.vintage_of, "/x/EIA_STEO_2026-07.pdf", "no-date-here.pdf", "a_2026-13.pdf")] == ["2026-07-01", "None", "None"]
    assert [tuple(x) for x in one(spark, t.file_meta, "/a/EIA_STEO_2026-07.pdf", "X_2024.pdf", "plain name.pdf", "N_2024-15.pdf")] == [("EIA STEO", "июль 2026"), ("X", "2024"), ("plain name", ""), ("N", "15 2024")]


def test_t_quantiles(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 11, 13, 19, 22, 23, 28, 31)], "n int").select(series.t95(F.col("n")).alias("t"))
    assert [r.t for r in df.collect()] == [float("inf"), 12.706, 2.201, 2.160, 2.093, 2.086, 2.060, 2.042, 1.96]


def test_horizons(spark):
    asked = ["3 месяца", "2 недели", "1 год", "45 дней", "просто", "5 лет", "на пять лет", "на год", "на квартал", "на две недели"]
    assert one(spark, questions.horizon_days, *asked) == [90, 14, 365, 45, 90, 730, 730, 365, 90, 14]
    assert one(spark, questions.needs_fresh, "Что сейчас с ценой?", "Запасы США") == [True, False]


SCENARIOS = [
    ("если ОПЕК+ сократит добычу на 5%", -5.1, None, True), ("при сокращении добычи на 500 тыс. барр/сут", -0.5, None, True), ("если добыча упадёт на 1,5 миллиона баррелей в сутки", -1.5, None, True),
    ("если добыча вырастет на 2 mb/d", 2.0, None, True), ("при сокращении на 800 kb/d", -0.8, None, True), ("при выпадении 2 млн б/с", -2.0, None, True), ("не сократит, а увеличит на 2 млн барр/сут", 2.0, None, True),
    ("сокращение с 2 до 3 млн барр/сут", -2.0, -3.0, True), ("прогноз при сокращении добычи от 2 до 3 млн барр./сут", -2.0, -3.0, True), ("сценарий: сокращение предложения на 2–3 млн барр./сут", -2.0, -3.0, True),
    ("что с ценой при сокращении на 1.5-2 млн барр/сут", -1.5, -2.0, True), ("если добыча вырастет с 500 до 800 тыс. барр./сут", 0.5, 0.8, True), ("сокращение с 3 до 2 млн барр/сут", -2.0, -3.0, True),
    ("что с ценой Brent", 0.0, None, True), ("спрогнозируй Brent на 3 месяца", 0.0, None, True), ("сократит добычу", 0.0, None, False), (None, 0.0, None, True),
]


def test_scenarios(spark):
    rows = questions.scenario(spark.createDataFrame([(i, s[0]) for i, s in enumerate(SCENARIOS)], "i int, question string")).orderBy("i").collect()
    for r, (q, near, far, understood) in zip(rows, SCENARIOS):
        assert r.change == pytest.approx(near) and r.understood == understood and (r.change_far == pytest.approx(far) if far else r.change_far is None), q


def test_replies(spark):
    replies = ["<think>forecast</think> industry", "other, no: forecast", "<think>forecast", "Не forecasting", "<think>a</think>other<think>forecast"]
    assert one(spark, questions.route, *replies) == ["industry", "forecast", "industry", "industry", "other"]


def test_borrowed_hits(spark):
    rows = [([("a", 0.70), ("b", 0.61), ("c", 0.65)], [("x", 0.68)]), ([("a", 0.67), ("w", 0.6485), ("c", 0.69), ("t", 0.6842)], [("x", 0.6592)]), ([("a", 0.5)], [("x", 0.5), ("a", 0.9)]), ([], [("x", 0.1), ("y", 0.2)])]
    df = spark.createDataFrame(rows, "hits array<struct<id:string,score:double>>, borrowed array<struct<id:string,score:double>>")
    assert [[h.id for h in r.merged] for r in retrieval.merge_borrowed(df).collect()] == [["a", "x", "c"], ["a", "c", "t", "x"], ["a"], ["y", "x"]]


def test_forecast_of_short_series(spark):
    rows = [("a", i, 70.0 + i) for i in range(20)] + [("b", 0, 5.0)]
    df = spark.createDataFrame(rows, "k string, n int, close double").withColumn("date", F.date_add(F.lit("2025-01-01").cast("date"), F.col("n")))
    out = forecast.forecast(df, ["k"], 3).orderBy("date").collect()
    assert [str(r.date) for r in out] == ["2025-01-21", "2025-01-22", "2025-01-23"] and {(r.k, r.alpha, r.fitted, round(r.forecast, 9)) for r in out} == {("a", 0.3, False, round(out[0].forecast, 9))}
    assert 0 < out[0].lower < out[0].forecast and out[0].upper - out[0].lower < out[2].upper - out[2].lower
    with pytest.raises(ValueError):
        forecast.forecast(df, ["k"], 0)


def test_band_holds_a_random_walk(spark):
    rng, close, rows = random.Random(4), 80.0, []
    for i in range(160):
        close *= 1 + rng.gauss(0, 0.01)
        rows.append(("w", i, close))
    (r,) = forecast.coverage(spark.createDataFrame(rows, "k string, date int, close double"), ["k"], 60, 5, 4).collect()
    assert r.windows >= 15 and 0.8 <= r.share <= 1


def test_known_elasticity(spark):
    rng, rows, s, p, c, i = random.Random(2), [], 100.0, 70.0, 100.0, 2700.0
    for n in range(13):
        rows.append(("w", f"{2020 + n // 4}-{3 * (n % 4) + 3:02d}-28", p, s, c, i))
        move = rng.gauss(0, 0.02)
        s, p, c, i = s * 2.718281828**move, p * 2.718281828 ** (move / -0.31), c * 2.718281828 ** (-0.11 * move / -0.31), i + rng.gauss(0, 30)
    d = factors.changes(spark.createDataFrame(rows, "key string, quarter_end string, price double, production double, consumption double, inventories double"))
    (m,), (e,) = factors.clearing_elasticity(d).collect(), factors.demand_elasticity(d).collect()
    assert m.value == pytest.approx(-0.31, abs=1e-6) and m.usable and e.value == pytest.approx(-0.11, abs=1e-6)
    (r,) = factors.price_response(d).collect()
    assert r.supply == pytest.approx(-1 / 0.31, rel=1e-4) and r.r2 > 0.999
    assert factors.clearing_elasticity(d.limit(5)).isEmpty()


def test_rows_and_pairs(spark):
    assert spark.range(1).select(reports.row_pairs(F.lit("Alpha ... 1.0 - 3.0"), F.lit("Q1 Q2 Q3"))).first()[0] == "Alpha: Q1 = 1.0, Q2 = -, Q3 = 3.0"
    assert spark.range(1).select(reports.row_pairs(F.lit("Alpha ... 1.0 - 3.0"), F.lit("Q1 Q2"))).first()[0] == ""
    assert one(spark, reports.is_column_header, "Q1 Q2 2026", "July 2026 Q1", "Q1 Q2", "Jan Feb Year") == [True, False, False, True]


def test_pages_of_chunks(spark):
    pages = spark.createDataFrame([(1, 5, "x" * 30), (1, 6, ""), (1, 8, "y" * 30)], "doc int, page int, text string")
    none = spark.createDataFrame([], "doc int, title string")
    out = reports.chunks(pages, none, ["doc"], 30, 0).orderBy("index").collect()
    assert [(r.page_start, r.page_end, r.text[0], len(r.text)) for r in out] == [(5, 5, "x", 30), (8, 8, "y", 30)]


def test_reading_numbers(spark):
    assert one(spark, readings.numbers, "Total 1,234.5 and +7", "Q1 Table3 ref2026a", "") == [["1234.5", "7"], [], []]
    rows = [(1, "layout", "82.4 78.1"), (1, "plain", "82.4 78.1"), (1, "stream", "82.4 79.1"), (2, "layout", "1"), (2, "plain", "2"), (2, "stream", "3"), (3, "layout", "20242024 82.4"), (3, "plain", "2024 2024 82.4"), (3, "stream", "2024 2024")]
    r = spark.createDataFrame(rows, "page int, reader string, text string")
    out = {x.page: (x.verdict, x.outlier, x.effective) for x in readings.page_verdicts(readings.pair_verdicts(readings.fingerprints(r, ["page"]), ["page"]), ["page"]).collect()}
    assert out == {1: ("diverge", "stream", "agree"), 2: ("diverge", None, "diverge"), 3: ("diverge", "stream", "tokenize")}
    left = {x.page: (x.only_a, x.only_b) for x in readings.residuals(r, ["page"], "layout", "stream").collect()}
    assert left == {1: (["78.1"], ["79.1"]), 2: (["1"], ["3"]), 3: (["20242024", "82.4"], ["2024", "2024"])}


def test_citation_grammar(spark):
    a = spark.createDataFrame([(1, "x 1.5 [Отчёт EIA STEO, июль 2026, с. 3–4] y [Отчёт EIA STEO, май 2026, с. 2; note] [Источник: a, web] 7,5"), (2, None)], "k int, answer string")
    found = citations.citations(a, ["k"]).orderBy("place").collect()
    assert [(r.source_name, r.date, r.first, r.last, r.note) for r in found] == [("EIA STEO", "июль 2026", 3, 4, None), ("EIA STEO", "май 2026", 2, 2, "; note")]
    cut = citations.segments(citations.paragraphs(a, ["k"]), ["k"]).orderBy("segment").collect()
    assert [r.kind for r in cut] == ["Отчёт", "Отчёт", "Источник", None]
    two = spark.createDataFrame([(1, "109.73 и 109.78 [Отчёт E, май 2026, с. 1], [Отчёт E, июнь 2026, с. 1]\n\n```\n5.5\n```", "", "")], "k int, answer string, question string, computed string")
    pages = spark.createDataFrame([("май 2026", 1, "109,73"), ("июнь 2026", 1, "109.78")], "date string, page int, text string")
    assert sorted(r.state for r in citations.checked_numbers(two, pages, ["k"]).collect()) == ["found", "found"]
    demo = "### Запрос\nq 1.5\n### Ответ агента\nbody\n---\n#### Выход расчётного модуля\n```a\n b```"
    (r,) = citations.sections(spark.createDataFrame([(demo,)], "text string")).collect()
    assert (r.answer, r.question, r.computed) == ("body", "q 1.5", "a b")


def test_shift_of_rows(spark):
    rows = [(["2", "3", "4"], ["1", "2", "3", "4"]), (["1", "−", "3,000"], ["1", "-", "3000"]), ([], ["1"])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>").select(layout.shift(F.col("a"), F.col("b")).alias("s"))
    assert [tuple(r.s) for r in df.collect()] == [(1, -1), (0, 0), (1, -3)]


def test_records_of_a_register(spark):
    text = "# T\n### Р-1. First\n**Задача.** bolt\n## Other\nlost\n### Р-2. Second\nline\n### Not one\n"
    out = registers.records(spark.createDataFrame([("f", text)], "f string, text string"), ["f"]).orderBy("line").collect()
    assert [(r.number, r.title, r.body) for r in out] == [("Р-1", "First", "**Задача.** bolt"), ("Р-2", "Second", "line\n### Not one\n")]


def test_turns_are_recorded(spark):
    threads = spark.createDataFrame([(1, "kept", False, 0, 0, 2)], "thread_id int, title string, renamed boolean, created_at int, updated_at int, turns long")
    new = spark.createDataFrame([(1, 1, "q", "a", 5, ["x", "", "x", "y"]), (2, 1, "first?", "a", 6, None)], "thread_id int, seq int, question string, answer string, asked_at int, chunks array<string>")
    after, turns, trail = dialogue.record(threads, new)
    assert sorted(map(tuple, after.collect())) == [(1, "kept", False, 0, 5, 3), (2, "first?", False, 6, 6, 1)]
    assert sorted((r.thread_id, r.ordinal) for r in turns.collect()) == [(1, 3), (2, 1)] and sorted((r.position, r.chunk) for r in trail.collect()) == [(0, "x"), (1, "y")]
    assert [r.s for r in spark.createDataFrame([("abcdef",), ("ab",)], "s string").select(dialogue.clip(F.col("s"), 3, "+").alias("s")).collect()] == ["abc+", "ab"]


def test_files(spark, tmp_path):
    few = spark.createDataFrame([("2025-01-01", "1")], "date string, close string")
    with pytest.raises(ValueError):
        tables.write_prices(few, str(tmp_path / "p"))
    with pytest.raises(KeyError):
        tables.require(few, ["close", "volume"])
    (tmp_path / "cells").mkdir()
    (tmp_path / "cells" / "R_2026-07.csv").write_text('0,2026Q1,"1,5"\n10,2026,2\n')
    assert [tuple(r) for r in factors.report_factors(tables.report_cells(spark, str(tmp_path / "cells"))).select("production", "actual").collect()] == [(15.0, True)]
    (tmp_path / "answers").mkdir()
    (tmp_path / "answers" / "a.md").write_text("one\ntwo")
    assert [r.text for r in tables.answer_files(spark, str(tmp_path / "answers")).collect()] == ["one\ntwo"]


def test_score_of_a_page_is_that_of_matched_rows(spark):
    """Against the expressions for labels and shifts, row by row, with nulls, repeated labels and pages that were not parsed."""
    rng = random.Random(9)
    cell = lambda: rng.choice(["1", "2", " 1,0", "10", "−", "-", "", None])
    row = lambda: rng.choice([None, *[[cell() for _ in range(rng.randint(0, 5))] for _ in range(9)]])
    truth = spark.createDataFrame([(k, label, row()) for k in range(60) for label in rng.sample(["a", "B ", "ab", "x", None], 3)], "k long, label string, values array<string>")
    parsed = spark.createDataFrame([(k, n, rng.choice(["A", "b", "xab", "total x", None]), row()) for k in range(55) for n in range(4)], "k long, place long, label string, values array<string>")
    held = layout.match_labels(parsed, truth, ["k"]).join(parsed.select("k", "place", F.col("values").alias("got")), ["k", "place"], "left")
    held = held.withColumn("s", F.when(F.col("place").isNotNull(), layout.shift(F.col("got"), F.col("values"))))
    want = held.groupBy("k").agg(F.count("*"), F.count("place"), F.sum(F.size("values")), F.sum(F.coalesce("s.wrong", F.size("values"))), F.count_if(F.col("s.shift") != 0))
    got = layout.score(parsed, truth, ["k"])
    assert got.dtypes == [("k", "bigint"), *((c, "bigint") for c in ("rows", "rows_found", "cells", "misplaced", "shifted"))]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "array_min" not in plan
