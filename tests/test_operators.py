import random
import uuid

from pyspark.sql import functions as F

from quillspan.functions import text as t
from quillspan.operators import pages, series


def one(spark, column, *values):
    return [r.x for r in spark.createDataFrame([(v,) for v in values], "s string").select(column.alias("x")).collect()]


def test_content_id_is_a_name_based_uuid(spark):
    got = one(spark, t.content_id(pages.NAMESPACE, F.col("s"), F.lit("b")), "a", "é", "")
    assert got == [str(uuid.uuid5(uuid.UUID(pages.NAMESPACE), f"{s}|b")) for s in ("a", "é", "")]


def test_axis_scale(spark):
    texts = ["11.5 12.0 12.5 13.0 13.5 14.0 14.5", "2024 2025 2026 2027 2028", "1 2 3 4 5 6", "103.44 105.01 107.75 108 109", ""]
    assert one(spark, t.axis_scale(F.col("s")), *texts) == [True, False, False, False, False]


def test_stem_and_title(spark):
    assert one(spark, t.stem(F.col("s")), "прогноз", "добычи", "на", "production") == ["прогн", "добы", "на", "product"]
    assert one(spark, t.title(F.col("s")), "  a \n b ", "", None) == ["a b", "Untitled", "Untitled"]
    (long,) = one(spark, t.title(F.col("s")), "word " * 30)
    assert long.endswith("word…") and len(long) <= 61


def loop_windows(text, cuts, size, overlap):
    """Windows by a plain loop over the split points."""
    bounds, out = [0, *cuts, len(text)], []
    for i, (a, z) in enumerate(zip(bounds, bounds[1:])):
        at = a
        while True:
            stop, final = min(at + size, z), i == len(bounds) - 2
            out.append((at, stop))
            if (final and stop >= z) or (not final and at + size > z):
                break
            at += size - overlap
            if at >= z:
                break
    return out


def test_windows_equal_the_loop(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab\n") if rng.random() < 0.05 else "x" for _ in range(rng.randint(1, 300))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size, overlap in ((60, 10), (50, 0), (7, 3)):
        got = sorted((r.doc_id, r.start, r.stop) for r in pages.windows(docs, "\n", size, overlap).collect())
        want = sorted((i, a, z) for i, s in enumerate(texts) for a, z in loop_windows(s, [j for j in range(1, len(s)) if s[j] == "\n"], size, overlap))
        assert got == want


def test_verdicts(spark):
    pairs = [("1", "1", "agree"), ("1 2", "2 1", "order"), ("11", "1 1", "tokenize"), ("1", "1 2", "diverge")]
    rows = spark.createDataFrame([(a.split(), b.split(), v) for a, b, v in pairs], "a array<string>, b array<string>, v string")
    assert all(r.got == r.v for r in rows.withColumn("got", pages.verdict(F.col("a"), F.col("b"))).collect())


def test_outlier_needs_three_readers(spark):
    readings = [(1, "a", ["82.4", "78.1"]), (1, "b", ["82.4", "78.1"]), (1, "c", ["82.4", "79.1"]), (2, "a", ["1"]), (2, "b", ["2"]), (2, "c", ["3"])]
    got = pages.worst(pages.cross_check(spark.createDataFrame(readings, "doc_id long, reader string, tokens array<string>")))
    assert sorted(map(tuple, got.collect())) == [(1, "diverge", "c"), (2, "diverge", None)]


def test_blank_duplicate_wins_and_is_filled(spark):
    rows = spark.createDataFrame([("2025-01-05", 78.5, 0), ("2025-01-01", 76.25, 1), ("2025-01-01", None, 2), ("2025-01-08", 80.0, 3)], "d string, close double, ord long")
    prices = series.keep_last(rows.select(F.to_date("d").alias("date"), "close", "ord"), "date", "ord").drop("ord")
    assert [r.close for r in series.calendar(prices).orderBy("date").collect()] == [78.5] * 7 + [80.0]


def test_evidence_edges(spark):
    from quillspan.operators import evidence as e

    chunks = spark.createDataFrame([(1, 1, 3), (1, 5, 4), (2, 1, 1)], "doc long, page_start int, page_end int")
    verdicts = spark.createDataFrame([(1, 1, "agree"), (1, 2, "tokenize"), (1, 3, "diverge"), (1, 5, "agree")], "doc long, page int, verdict string")
    got = {(r.doc, r.page_start): (r.confidence, r.caveats) for r in e.chunk_confidence(chunks, verdicts, ["doc"]).collect()}
    assert got == {(1, 1): ("disputed", ["2:tokenize", "3:diverge"]), (1, 5): ("direct", []), (2, 1): ("unchecked", [])}

    numbers = spark.createDataFrame([("1,234 and 1.5, -2,5; 1234",), (None,)], "t string").select(e.normal_numbers(F.col("t"))).collect()
    assert [r[0] for r in numbers] == [["1234", "1.5", "-2.5"], None]

    odd = ["7.1234565", "0,1234565", "0.0000005", "123456789012345678901234", "9007199254740993", "12345678.1234565", "1" * 400, "-0.0000001", "1.2.3", "123,456,789,012,345"]
    numbers = spark.createDataFrame([(" ".join(odd),)], "t string").select(e.normal_numbers(F.col("t"))).first()[0]
    assert numbers == ["7.123456", "0.123456", "0", "123456789012345685803008", "9007199254740992", "12345678.123457", "inf", "-0", "12.3", "123456789012345"]

    cites = spark.createDataFrame([(1, "a", 2, 3), (2, "a", 9, 9), (3, None, 1, 1)], "citation_id int, src string, first int, last int")
    frags = spark.createDataFrame([("a", 3, 5, "direct"), ("a", 1, 2, "unchecked"), ("a", 4, 5, "disputed")], "src string, page int, page_end int, level string")
    assert {r.citation_id: r.level for r in e.citation_levels(cites, frags, ["src"]).collect()} == {1: "unchecked", 2: None, 3: None}

    links = spark.createDataFrame([(1, 2)], "conv_id long, linked long")
    new = spark.createDataFrame([(1, 2), (3, 3), (2, 1)], "conv_id long, linked long")
    assert {tuple(r) for r in e.add_links(links, new).collect()} == {(1, 2), (2, 1)}


def test_alpha_of_both_grids(spark):
    """Against a plain loop over 0.05 to 0.95 and then over the hundredths around its best; short series have no fit."""
    rng, rows, want = random.Random(7), [], {}

    def rmse(v, a):
        level, sse = v[0], 0.0
        for y in v[1:]:
            sse, level = sse + (y - level) ** 2, a * y + (1 - a) * level
        return (sse / (len(v) - 1)) ** 0.5

    for k, n in enumerate((29, 30, 60, 90)):
        v = [50.0]
        for _ in range(n - 1):
            v.append(v[-1] + rng.gauss(0, 1) * (k + 1) / 2)
        v = [y + rng.gauss(0, 1) for y in v]
        best = min((round(0.05 * i, 2) for i in range(1, 20)), key=lambda a: rmse(v, a))
        fine = [a for a in (round(best + 0.01 * i, 2) for i in range(-4, 5)) if 0.05 <= a <= 0.95]
        want[k] = min(fine, key=lambda a: rmse(v, a)) if n >= 30 else None
        rows += [(k, i, y) for i, y in enumerate(v)]
    got = {r.k: r.alpha for r in series.fit_alpha(spark.createDataFrame(rows, "k int, date int, close double"), ["k"]).collect()}
    assert got == want and any(a and round(a * 100) % 5 for a in want.values())
