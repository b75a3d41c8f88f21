"""Readings of pages held against each other: verdicts by pair, residual numbers, outliers, tallies and what they mean for the indexed text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fixed
from ..sources.tables import on_workers, table
from .pages import VERDICTS, left_over, numbers, strings

POSITIONAL = ["layout", "plain"]  # readers that order words by their place on the page
INDEXED, SHOWN = "layout", 20
SEVERITIES = ["ok", "notice", "warn", "broken"]  # from best to worst


def _digits(text: Column) -> Column:
    """How often each digit occurs in a text: their multiset, in ten numbers."""
    return F.array(*[F.length(text) - F.length(F.replace(text, F.lit(str(i)), F.lit(""))) for i in range(10)])


def fingerprints(readings: DataFrame, key: list[str]) -> DataFrame:
    """(key, reader, n, a, b, c): readings (key, reader, text) as the number of their numeric tokens and digests of these in order, sorted, and of their digits.

    Pairs are told by digests of some bytes; texts are not shuffled.
    """
    t = readings.select(*key, "reader", numbers(F.coalesce("text", F.lit(""))).alias("t"))
    digest = lambda x: F.md5(F.array_join(x.cast("array<string>"), " ").cast("binary"))
    t = t.withColumn("joined", F.array_join("t", ""))
    return t.select(*key, "reader", F.size("t").alias("n"), digest(F.col("t")).alias("a"), digest(F.sort_array("t")).alias("b"), digest(_digits(F.col("joined"))).alias("c"))


def pair_verdicts(prints: DataFrame, key: list[str]) -> DataFrame:
    """(key, pairs): of each page the verdicts of all pairs of readers, by name. A pair with a reader that knows no places can only agree or diverge."""
    held = prints.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("reader", "n", "a", "b", "c"))).alias("r"))  # readers are few

    def pair(x: Column, y: Column) -> Column:
        told = F.when(x["a"] == y["a"], "agree").when(x["b"] == y["b"], "order").when(x["c"] == y["c"], "tokenize").otherwise("diverge")
        placed = x["reader"].isin(POSITIONAL) & y["reader"].isin(POSITIONAL)
        return F.struct(x["reader"].alias("reader_a"), y["reader"].alias("reader_b"), x["n"].alias("numbers_a"), y["n"].alias("numbers_b"), F.when(placed | (told == "diverge"), told).otherwise("agree").alias("verdict"))

    pairs = F.flatten(F.transform("r", lambda x: F.transform(F.filter("r", lambda y: x["reader"] < y["reader"]), lambda y: pair(x, y))))
    return held.select(*key, pairs.alias("pairs"))


def _rank(verdict: Column) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in VERDICTS]), verdict).cast("int")


def _worst(ranks: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(v) for v in VERDICTS]), F.array_max(ranks))


def page_verdicts(pairs: DataFrame, key: list[str]) -> DataFrame:
    """(key, pairs, verdict, outlier, effective, caveat): the worst verdict of a page, the reader that alone differs, and the verdict on the indexed text.

    The outlier is the first of three readers or more that is worse with each other than those are among themselves. If it is not the indexed
    reader, the others judge the page, and the caveat names it.
    """
    ranked = pairs.withColumn("p", F.transform("pairs", lambda p: F.struct(p["reader_a"].alias("a"), p["reader_b"].alias("b"), _rank(p["verdict"]).alias("k"))))
    ranked = ranked.withColumn("k", F.transform("p", lambda p: p["k"]))
    names = F.sort_array(F.array_distinct(F.flatten(F.transform("p", lambda p: F.array(p["a"], p["b"])))))
    own = lambda r: F.transform(F.filter("p", lambda p: (p["a"] == r) | (p["b"] == r)), lambda p: p["k"])
    rest = lambda r: F.transform(F.filter("p", lambda p: (p["a"] != r) & (p["b"] != r)), lambda p: p["k"])
    # Where all pairs have one verdict, no reader is worse: most pages need no search.
    outlier = F.when((F.array_min("k") < F.array_max("k")) & (F.size(names) >= 3), F.try_element_at(F.filter(names, lambda r: F.array_min(own(r)) > F.array_max(rest(r))), F.lit(1)))
    out = ranked.withColumns({"verdict": _worst(F.col("k")), "outlier": outlier})
    blamed = F.col("outlier").isNotNull() & (F.col("outlier") != INDEXED)
    kept = F.transform(F.filter("p", lambda p: (p["a"] != F.col("outlier")) & (p["b"] != F.col("outlier"))), lambda p: p["k"])
    return out.withColumns({"effective": F.when(blamed, _worst(kept)).otherwise(F.col("verdict")), "caveat": F.when(blamed, F.concat(F.col("outlier"), F.lit(" reads it otherwise; the indexed text agrees with the others")))}).drop("p", "k")


def residuals(readings: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """(key, only_a, only_b): numbers that one reading has more often than the other, in order; pages with equal multisets are left out.

    The two readings of a page meet as texts; only the numbers of pages that differ are told apart, page by page. Several readings
    of one reader count together.
    """
    on_workers(readings.sparkSession)
    tokens = lambda name: numbers(F.array_join(F.array_sort(F.collect_list(F.when(F.col("reader") == name, F.col("text")))), "\n"))
    held = readings.where(F.col("reader").isin(a, b)).groupBy(*key).agg(tokens(a).alias("__a"), tokens(b).alias("__b")).where(F.sort_array("__a") != F.sort_array("__b"))

    @F.arrow_udf("only_a array<string>, only_b array<string>")
    def apart(x: pa.Array, y: pa.Array) -> pa.Array:
        pages = [(strings(p), strings(q)) for p, q in zip(x, y)]
        sides = [pa.array([[token for _, token in left_over(*page)] for page in side], pa.list_(pa.string())) for side in (pages, [(q, p) for p, q in pages])]
        return pa.StructArray.from_arrays(sides, ["only_a", "only_b"])

    return held.select(*key, apart("__a", "__b").alias("r")).select(*key, "r.*")


def report(verdicts: DataFrame, left: DataFrame, key: list[str]) -> DataFrame:
    """Verdicts with lost (numbers that one of the primary pair lacks) and the first 20 of each side."""
    held = verdicts.join(left, key, "left")
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    shown = lambda c: F.coalesce(F.slice(c, 1, SHOWN), F.array().cast("array<string>")).alias(c)
    return held.select(*[c for c in verdicts.columns], (n("only_a") + n("only_b")).alias("lost"), shown("only_a"), shown("only_b"))


def tally(reported: DataFrame, group: list[str]) -> DataFrame:
    """Pages by verdict, numbers lost on pages that diverge, and pages whose fault lies with one reader, by group."""
    return reported.groupBy(*group).agg(
        F.count("*").alias("pages"), *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS], F.coalesce(F.sum(F.when(F.col("verdict") == "diverge", F.col("lost"))), F.lit(0)).alias("numbers_lost"), F.count("outlier").alias("localised")
    )


def unreadable(pages: DataFrame, witness: DataFrame, key: list[str]) -> DataFrame:
    """``pages`` (key, text) with unreadable: true where the text is blank but the witness (key, seen) has text, false where both are blank, null where the
    page has text or the witness did not answer."""
    held = pages.join(witness.select(*key, "seen"), key, "left")
    return held.withColumn("unreadable", F.when(~F.coalesce("text", F.lit("")).rlike(r"\S") & F.col("seen").isNotNull(), F.col("seen").rlike(r"\S"))).drop("seen")


def severity(findings: DataFrame, key: list[str]) -> DataFrame:
    """(key, severity, readable, caveats) of files by their findings (key, code, severity, detail): the worst of them, whether it is ok or a notice,
    and what to tell a reader: known codes in words of their own, and the detail of any other that is serious."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity")).cast("int")
    said = (
        F.when(F.col("code") == "fonts_without_tounicode", "fonts without ToUnicode: characters may be decoded wrongly")
        .when(F.col("code") == "incremental_updates", "the file holds incremental revisions")
        .when(F.col("severity").isin("warn", "broken"), F.col("detail"))
    )
    out = findings.groupBy(*key).agg(F.max(rank).alias("r"), F.array_sort(F.collect_set(said)).alias("caveats"))
    return out.select(*key, F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("r")).alias("severity"), (F.col("r") <= 2).alias("readable"), "caveats")


# ---- Readings of pages made of line items ------------------------------------------------------


def _readings(spark: SparkSession, d: str) -> DataFrame:
    """An order's items on a page: as laid out; plain, where some orders are reversed or read a point as a space; and as a stream, where some lack their first number."""
    li = table(spark, d, "lineitem")
    held = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_extendedprice"))).alias("i"))
    # An item is written once, not anew for each reading.
    words = lambda x: F.concat(F.lit("Q1 +"), fixed(x["l_quantity"], 1), F.lit(" "), F.format_number(x["l_extendedprice"], 2), F.lit(" ref"), x["l_linenumber"].cast("string"), F.lit("a;"))
    held = held.select("l_orderkey", F.transform("i", words).alias("w"))
    held = held.select("l_orderkey", F.array_join("w", " ").alias("layout"), F.array_join(F.reverse("w"), " ").alias("back"))
    k, layout, back = F.col("l_orderkey"), F.col("layout"), F.col("back")
    plain = F.when(k % 3 == 0, back).when(k % 3 == 1, F.replace(layout, F.lit(".0 "), F.lit(" 0 "))).otherwise(layout)
    stream = F.when(k % 5 == 0, F.regexp_replace(back, r"^Q1 \S+ ", "")).otherwise(back)
    return held.select("l_orderkey", F.inline(F.array(*[F.struct(F.lit(n).alias("reader"), t.alias("text")) for n, t in (("layout", layout), ("plain", plain), ("stream", stream))])))


def q_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pair_verdicts(fingerprints(_readings(spark, d), ["l_orderkey"]), ["l_orderkey"]).select("l_orderkey", F.inline("pairs"))


def _report(spark: SparkSession, d: str) -> DataFrame:
    r, key = _readings(spark, d), ["l_orderkey"]
    return report(page_verdicts(pair_verdicts(fingerprints(r, key), key), key), residuals(r, key, "layout", "stream"), key)


def q_report(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d).select("l_orderkey", "verdict", "outlier", "effective", F.col("caveat").isNotNull().alias("caveat"), "lost", F.array_join("only_a", " ").alias("only_a"), F.array_join("only_b", " ").alias("only_b"))


def q_tally(spark: SparkSession, d: str) -> DataFrame:
    rows = _report(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return tally(rows, ["o_custkey"])


def q_unreadable(spark: SparkSession, d: str) -> DataFrame:
    """Orders are pages; urgent ones came out blank, and a witness saw those that are not open."""
    o = table(spark, d, "orders")
    pages = o.select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", " \n").otherwise("text").alias("text"))
    seen = o.where("o_orderstatus <> 'O'").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "seen").otherwise(" ").alias("seen"))
    return unreadable(pages, seen, ["o_orderkey"]).select("o_orderkey", "unreadable")


def q_severity(spark: SparkSession, d: str) -> DataFrame:
    """Users are files, events their findings."""
    e = table(spark, d, "events")
    code = F.when(F.col("event_type") == "error", "fonts_without_tounicode").when(F.col("event_type") == "signup", "incremental_updates").otherwise(F.col("event_type"))
    level = F.when(F.col("value") > 400, "broken").when(F.col("value") > 250, "warn").when(F.col("value") > 50, "notice").otherwise("ok")
    return severity(e.select("user_id", code.alias("code"), level.alias("severity"), F.col("event_type").alias("detail")), ["user_id"]).withColumn("caveats", F.array_join("caveats", "; "))


_SAME = "list_sort(string_split(regexp_replace(array_to_string({x}, ''), '[^0-9]', '', 'g'), ''))"
_READ = f"""i AS (SELECT l_orderkey AS k, list({{'q': l_quantity, 'x': l_extendedprice}} ORDER BY l_linenumber, l_quantity, l_extendedprice) AS i FROM lineitem GROUP BY 1),
  l AS (SELECT k, flatten([[printf('%.1f', e.q), printf('%.2f', e.x)] FOR e IN i]) AS a, flatten([[printf('%.1f', e.q), printf('%.2f', e.x)] FOR e IN list_reverse(i)]) AS b,
    flatten([[printf('%d', CAST(e.q AS INTEGER)), '0', printf('%.2f', e.x)] FOR e IN i]) AS g FROM i),
  r AS (SELECT k, 'layout' AS reader, a AS t FROM l UNION ALL SELECT k, 'plain', CASE k % 3 WHEN 0 THEN b WHEN 1 THEN g ELSE a END FROM l UNION ALL SELECT k, 'stream', CASE WHEN k % 5 = 0 THEN b[2:] ELSE b END FROM l),
  z AS MATERIALIZED (SELECT k, reader, len(t) AS n, md5(array_to_string(t, ' ')) AS same, md5(array_to_string(list_sort(t), ' ')) AS bag, md5(array_to_string({_SAME.format(x="t")}, '')) AS digits FROM r),
  v AS (SELECT x.k, x.reader AS reader_a, y.reader AS reader_b, x.n AS numbers_a, y.n AS numbers_b, CASE WHEN x.same = y.same THEN 'agree' WHEN x.bag = y.bag THEN 'order' WHEN x.digits = y.digits THEN 'tokenize' ELSE 'diverge' END AS told
    FROM z x JOIN z y ON x.k = y.k AND x.reader < y.reader),
  p AS (SELECT *, CASE WHEN reader_b = 'stream' AND told <> 'diverge' THEN 'agree' ELSE told END AS verdict FROM v),
  w AS (SELECT *, list_position(['agree', 'order', 'tokenize', 'diverge'], verdict) AS rank FROM p),
  o AS (SELECT k, s.reader FROM w, (VALUES ('layout'), ('plain'), ('stream')) s(reader) GROUP BY 1, 2 HAVING min(CASE WHEN s.reader IN (reader_a, reader_b) THEN rank END) > max(CASE WHEN s.reader NOT IN (reader_a, reader_b) THEN rank END)),
  f AS (SELECT k, max(rank) AS worst, (SELECT min(reader) FROM o WHERE o.k = w.k) AS outlier FROM w GROUP BY 1),
  e AS (SELECT f.k, worst, outlier, max(rank) FILTER (WHERE outlier NOT IN (reader_a, reader_b)) AS kept FROM f JOIN w USING (k) GROUP BY 1, 2, 3),
  q AS (SELECT k AS l_orderkey, ['agree', 'order', 'tokenize', 'diverge'][worst] AS verdict, outlier, ['agree', 'order', 'tokenize', 'diverge'][CASE WHEN outlier IS NULL OR outlier = 'layout' THEN worst ELSE kept END] AS effective,
    coalesce(outlier <> 'layout', false) AS caveat, CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS lost, CASE WHEN k % 5 = 0 THEN b[1] ELSE '' END AS only_a, '' AS only_b FROM e JOIN l USING (k))"""
SQL = {
    "reading_pairs": f"WITH {_READ} SELECT k AS l_orderkey, reader_a, reader_b, CAST(numbers_a AS INTEGER) AS numbers_a, CAST(numbers_b AS INTEGER) AS numbers_b, verdict FROM p",
    "reading_report": f"WITH {_READ} SELECT * FROM q",
    "reading_tally": f"""
      WITH {_READ} SELECT o_custkey, count(*) AS pages, count(*) FILTER (WHERE verdict = 'agree') AS agree, count(*) FILTER (WHERE verdict = 'order') AS "order", count(*) FILTER (WHERE verdict = 'tokenize') AS tokenize,
        count(*) FILTER (WHERE verdict = 'diverge') AS diverge, coalesce(sum(lost) FILTER (WHERE verdict = 'diverge'), 0) AS numbers_lost, count(outlier) AS localised FROM q JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""",
    "unreadable_pages": """
      SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN true WHEN o_orderpriority = '1-URGENT' AND o_orderstatus <> 'O' THEN false END AS unreadable FROM orders""",
    "file_severity": """
      WITH f AS (SELECT user_id, CASE WHEN value > 400 THEN 4 WHEN value > 250 THEN 3 WHEN value > 50 THEN 2 ELSE 1 END AS r, event_type FROM events),
      s AS (SELECT *, CASE event_type WHEN 'error' THEN 'fonts without ToUnicode: characters may be decoded wrongly' WHEN 'signup' THEN 'the file holds incremental revisions' ELSE CASE WHEN r > 2 THEN event_type END END AS said FROM f)
      SELECT user_id, ['ok', 'notice', 'warn', 'broken'][max(r)] AS severity, max(r) <= 2 AS readable, coalesce(string_agg(DISTINCT said, '; ' ORDER BY said), '') AS caveats FROM s GROUP BY 1""",
}
QUERIES = {"reading_pairs": q_pairs, "reading_report": q_report, "reading_tally": q_tally, "unreadable_pages": q_unreadable, "file_severity": q_severity}
