"""Answers and their citations: grammar, marks, paragraphs and segments, and numbers held against the cited pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import answer_files, shared_folder, table
from .evidence import LEVELS, normal_numbers

#: Formats of answers (fixed values): the citation of a report's pages, any mark, and the words that stand in a mark for each level.
CITATION = r"\[Отчёт\s+([^,\]]+),\s*([а-яё]+\s+\d{4}),\s*с\.\s*(\d+)(?:\s*[–—-]\s*(\d+))?(;\s*[^\]]*)?\]"
KINDS = r"\[(Отчёт|Расчёт|Источник|Веб-источник)"
MARKS = {"direct": "", "geometry": "текст собран по геометрии страницы", "disputed": "⚠ два пути чтения расходятся по цифрам", "unchecked": "сверка чтения не выполнялась"}
DECIMAL = r"\d+[.,]\d+"
#: Text up to a mark and all marks of its kind that follow it at once, or the text after the last mark.
SEGMENT = rf"(?s).*?{KINDS}[^\]]*\](?:[\s,;]*(?:и\s+)?\[\1[^\]]*\])*|.+$"


def mark_of(level: Column) -> Column:
    """What a citation says of its level; nothing for direct or an unknown one."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv]), level), F.lit(""))


def claim(text: Column, kind: Column, source: Column, date: Column, page: Column, level: Column) -> Column:
    """A claim with its citation: of a report's page with its level's mark, or of a web source; another kind is an error, and so is a null field.

    A claim without a level was not checked, and its citation says so.
    """
    note = mark_of(F.coalesce(level, F.lit("unchecked")))
    report = F.concat(text, F.lit(" [Отчёт "), source, F.lit(", "), date, F.lit(", с. "), page.cast("string"), F.when(note != "", F.concat(F.lit("; "), note)).otherwise(""), F.lit("]"))
    web = F.concat(text, F.lit(" [Источник: "), source, F.lit(", web]"))
    out = F.when(kind == "report", report).when(kind == "web", web)
    return F.coalesce(out, F.raise_error(F.lit("a claim of an unknown kind, or without one of its fields")).cast("string"))


def answer(claims: DataFrame, key: list[str]) -> DataFrame:
    """(key, answer) of claims (key, place, claim): each a paragraph of its own, in order."""
    held = claims.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "claim"))).alias("c"))
    return held.select(*key, F.array_join("c.claim", "\n\n").alias("answer"))


def citations(answers: DataFrame, key: list[str], text: str = "answer") -> DataFrame:
    """(key, place, source_name, date, first, last, note, found) of the citations of reports in answers, in order from 0."""
    part = lambda i: F.regexp_extract("found", CITATION, i)
    rows = answers.select(*key, F.posexplode(F.regexp_extract_all(text, F.lit(CITATION), F.lit(0))).alias("place", "found"))
    first, last = part(3).cast("int"), part(4).try_cast("int")
    return rows.select(*key, "place", part(1).alias("source_name"), part(2).alias("date"), first.alias("first"), F.coalesce(last, first).alias("last"), F.nullif(part(5), F.lit("")).alias("note"), "found")


def levels(cited: DataFrame, fragments: DataFrame, key: list[str]) -> DataFrame:
    """Citations with the worst level of the answer's own fragments (key, source_name, date, page, page_end, confidence) that they meet; null for none."""
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("confidence")).cast("int")
    f = fragments.select(*key, "source_name", "date", "page", "page_end", rank.alias("r"))
    meets = cited.join(f, [*key, "source_name", "date"]).where("NOT (page_end < first OR page > last)").groupBy(*key, "place").agg(F.max("r").alias("r"))
    level = F.when(F.col("r").isNotNull(), F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.col("r")))
    return cited.join(meets, [*key, "place"], "left").withColumn("level", level).drop("r")


def annotate(answers: DataFrame, fragments: DataFrame, key: list[str]) -> DataFrame:
    """(key, answer, citations, marked, unmatched): answers whose citations say at which level their pages were read.

    Citations that carry a note keep it; direct ones get none; those that meet no fragment stay as they are and are counted.
    """
    cited = levels(citations(answers, key), fragments, key)
    note = F.when(F.col("note").isNull(), mark_of(F.col("level"))).otherwise("")
    new = F.when(note != "", F.concat(F.expr("substring(found, 1, length(found) - 1)"), F.lit("; "), note, F.lit("]"))).otherwise(F.col("found"))
    by_answer = cited.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("place", new.alias("new")))).alias("c"), F.count("*").alias("citations"), F.count_if(note != "").alias("marked"), F.count_if(F.col("note").isNull() & F.col("level").isNull()).alias("unmatched")
    )
    rows = answers.join(by_answer, key, "left")
    between = F.split("answer", CITATION, -1)
    text = F.array_join(F.flatten(F.zip_with(between, F.concat(F.col("c.new"), F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return rows.select(*key, F.when(F.col("c").isNull(), F.col("answer")).otherwise(text).alias("answer"), zero("citations"), zero("marked"), zero("unmatched"))


def marked_pages(cited: DataFrame, key: list[str]) -> DataFrame:
    """(key, level, pages): the pages behind each mark of an answer, as the note below it lists them, worst level first in order of rank."""
    span = F.when(F.col("first") == F.col("last"), F.concat(F.lit("с. "), F.col("first"))).otherwise(F.concat(F.lit("с. "), F.col("first"), F.lit("–"), F.col("last")))
    rows = cited.where("note IS NULL AND level IS NOT NULL AND level <> 'direct'").select(*key, "level", F.concat_ws(", ", "source_name", "date", span).alias("p"))
    return rows.groupBy(*key, "level").agg(F.array_join(F.array_sort(F.collect_set("p")), "; ").alias("pages"))


#: What a reader should do about each level, the worst level first; callers give their own words.
ADVICE = {
    "disputed": "two readings of the page differ: look at the report before you rely on the number",
    "unchecked": "the page was read once and by no other reader: nobody knows whether it was read well",
    "geometry": "the numbers agree, their places were put together here: check the row, the column and the unit",
}


def legend(pages: DataFrame, key: list[str], advice: dict[str, str] = ADVICE) -> DataFrame:
    """(key, legend) of the marks of an answer (``marked_pages``): a line a level, the worst first, with its pages and what to do about it."""
    order = F.array(*[F.lit(x) for x in advice])
    words = F.element_at(F.create_map(*[F.lit(x) for kv in advice.items() for x in kv]), F.col("level"))
    line = F.concat(F.lit("* **"), mark_of(F.col("level")), F.lit("** ("), "pages", F.lit(") — "), words)
    held = pages.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.array_position(order, F.col("level")).alias("n"), line.alias("line")))).alias("l"))
    return held.select(*key, F.array_join("l.line", "\n").alias("legend"))


def with_legend(answers: DataFrame, legends: DataFrame, key: list[str]) -> DataFrame:
    """Answers (key, answer) with the legend of their marks once below a rule; those without marks, or that have it already, stay as they are."""
    below = F.concat(F.lit("\n\n---\n"), "legend")
    rows = answers.join(legends, key, "left")
    return rows.withColumn("answer", F.when(F.col("legend").isNull() | F.contains("answer", below), F.col("answer")).otherwise(F.concat("answer", below))).drop("legend")


def paragraphs(answers: DataFrame, key: list[str], text: str = "answer") -> DataFrame:
    """(key, block, text): runs of lines up to an empty one, joined by spaces; those with verbatim output are left out."""
    parts = F.transform(F.split(text, r"\n[ \t\r]*(?=\n|$)"), lambda p: F.array_join(F.filter(F.split(p, "\n"), lambda x: F.trim(x) != ""), " "))
    rows = answers.select(*key, F.posexplode(F.filter(parts, lambda p: F.trim(p) != "")).alias("block", "text"))
    return rows.where(~F.contains("text", F.lit("```")))


def segments(blocks: DataFrame, key: list[str]) -> DataFrame:
    """(key, block, segment, text, kind): a paragraph cut after its marks, marks of one kind in a row as one; a number belongs to the next mark. Text after the last has no kind."""
    rows = blocks.select(*key, "block", F.posexplode(F.regexp_extract_all("text", F.lit(SEGMENT), F.lit(0))).alias("segment", "text"))
    return rows.where(F.trim("text") != "").withColumn("kind", F.nullif(F.regexp_extract("text", KINDS, 1), F.lit("")))


def has_number(text: Column, number: Column) -> Column:
    """Whether a text holds a decimal number with a point or with a comma."""
    return F.contains(text, F.replace(number, F.lit(","), F.lit("."))) | F.contains(text, F.replace(number, F.lit("."), F.lit(",")))


def checked_numbers(answers: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    """(key, block, segment, number, state): decimal numbers of answers (key, answer, question, computed) held against pages (date, page, text).

    state: found or missing (on the pages cited, or in the computed output), no source (those pages are not there), web (not held against anything), bare (no
    mark follows it) or echo (bare, but in the question).
    """
    cut = segments(paragraphs(answers, key), key)
    numbers = cut.select(*key, "block", "segment", "kind", "text", F.posexplode(F.regexp_extract_all("text", F.lit(DECIMAL), F.lit(0))).alias("n", "number"))
    cited = citations(cut.where("kind = 'Отчёт'"), [*key, "block", "segment"], "text")
    cited = cited.select(*key, "block", "segment", "date", F.explode(F.sequence("first", F.greatest("first", "last"))).alias("page")).distinct()
    source = cited.join(pages, ["date", "page"], "left").groupBy(*key, "block", "segment").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("source"))
    rows = numbers.join(source, [*key, "block", "segment"], "left").join(answers.select(*key, "question", "computed"), key)
    held = F.when(F.col("kind") == "Расчёт", F.col("computed")).otherwise(F.col("source"))
    state = (
        F.when(F.col("kind").isNull(), F.when(has_number(F.coalesce("question", F.lit("")), F.col("number")), "echo").otherwise("bare"))
        .when(F.col("kind").isin("Источник", "Веб-источник"), "web")
        .when((F.col("kind") == "Отчёт") & F.col("source").isNull(), None)  # a mark that is no citation of pages
        .when(F.trim(F.coalesce(held, F.lit(""))) == "", "no source")
        .when(has_number(held, F.col("number")), "found")
        .otherwise("missing")
    )
    return rows.select(*key, "block", "segment", "number", state.alias("state")).where("state IS NOT NULL")


def check_totals(numbers: DataFrame, group: list[str]) -> DataFrame:
    """checked, missing, unmarked and web by group, and whether all is well. A segment without its source is one missing."""
    silent = F.count_distinct(F.when(F.col("state") == "no source", F.struct(*[c for c in numbers.columns if c not in ("number", "state")])))
    out = numbers.groupBy(*group).agg(
        F.count_if(F.col("state").isin("found", "missing")).alias("checked"), (F.count_if(F.col("state") == "missing") + silent).alias("missing"), F.count_if(F.col("state") == "bare").alias("unmarked"), F.count_if(F.col("state") == "web").alias("web")
    )
    return out.withColumn("ok", (F.col("missing") == 0) & (F.col("unmarked") == 0) & (F.col("checked") > 0))


def check_summary(totals: DataFrame, group: str) -> DataFrame:
    """Sums of ``check_totals`` by a group, and over all (a null group), with answers, those that failed, and a verdict; where no number was held against anything, nothing was checked."""
    sums = [F.sum(c).alias(c) for c in ("checked", "missing", "unmarked", "web")]
    out = totals.rollup(group).agg(F.count("*").alias("answers"), F.count_if(~F.col("ok")).alias("failed"), *sums)
    bad = (F.col("missing") > 0) | (F.col("unmarked") > 0)
    return out.withColumn("verdict", F.when(bad, "failed").when(F.col("checked") == 0, "nothing checked").otherwise("ok"))


def allowed_numbers(sources: list[DataFrame], key: list[str]) -> DataFrame:
    """(key, number): numbers of all sources (key, text) that an answer may use, in one spelling."""
    rows = reduce(lambda a, b: a.unionByName(b), [s.select(*key, "text") for s in sources])
    return rows.select(*key, F.explode(normal_numbers(F.col("text"))).alias("number")).distinct()


def sections(files: DataFrame) -> DataFrame:
    """``files`` (with text) and the answer, question and computed sections of a demo file; without an answer section all text is the answer."""
    part = lambda rx: F.regexp_extract("text", rx, 1)
    found = part(r"(?s)### Ответ агента\n(.*?)\n---\n")
    whole = F.when(F.col("text").rlike(r"(?s)### Ответ агента\n.*?\n---\n"), found).otherwise(F.col("text"))
    computed = F.regexp_replace(part(r"(?s)#### Выход расчётного модуля\s*```(.*?)```"), r"[\s ]+", " ")
    return files.withColumns({"answer": whole, "question": part(r"(?s)### Запрос\n(.*?)\n### "), "computed": computed})


# ---- Answers about orders: each line item is a claim that cites the page of its number -------

_FLAG = {"A": "архив", "N": "новый", "R": "возврат"}


def _lines(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_quantity", "l_discount", "l_shipdate", "l_returnflag", "l_linestatus")).alias("i")).select("l_orderkey", "l_linenumber", "i.*")
    source = F.element_at(F.create_map(*[F.lit(x) for kv in _FLAG.items() for x in kv]), F.col("l_returnflag"))
    date = F.concat(F.when(F.month("l_shipdate") <= 6, "июнь ").otherwise("декабрь "), F.year("l_shipdate"))
    return li.select("l_orderkey", "l_linenumber", "l_linestatus", source.alias("source_name"), date.alias("date"), F.format_string("%.1f", "l_quantity").alias("q"), F.format_string("%.2f", "l_discount").alias("disc"))


def _answers(spark: SparkSession, d: str, level: Column | None = None) -> DataFrame:
    """A claim an item, each read directly or at ``level``; open items come from the web, and the order's total closes the answer without a mark, as the question names it for urgent ones."""
    rows = _lines(spark, d)
    text = F.concat(F.lit("объём "), "q", F.lit("\nпри скидке "), F.replace("disc", F.lit("."), F.lit(",")))
    kind = F.when(F.col("l_linestatus") == "O", "web").otherwise("report")
    made = answer(rows.select("l_orderkey", F.col("l_linenumber").alias("place"), claim(text, kind, F.col("source_name"), F.col("date"), F.col("l_linenumber"), F.lit("direct") if level is None else level).alias("claim")), ["l_orderkey"])
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", F.format_string("%.2f", "o_totalprice").alias("total"))
    rows = made.join(orders, "l_orderkey")
    asked = F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("Верно ли, что "), "total")).otherwise("Что известно")
    return rows.select("l_orderkey", F.concat("answer", F.lit("\n \nвсего "), "total").alias("answer"), asked.alias("question"), F.lit("").alias("computed"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages hold the quantities of closed items that were not returned, by date and page number."""
    rows = _lines(spark, d).where("source_name = 'архив' AND l_linestatus = 'F'")
    return rows.groupBy("date", F.col("l_linenumber").alias("page")).agg(F.array_join(F.array_sort(F.collect_set("q")), "; ").alias("text"))


def q_sections(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation as a file of a question, an answer and what was computed, written and read back; some have no answer section."""
    c = table(spark, d, "conversations")
    said = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"]), "\n")
    rows = c.groupBy("conv_id").agg(said("user").alias("q"), said("assistant").alias("a"), F.count("*").cast("string").alias("n"))
    answer = F.when(F.col("conv_id") % 5 != 0, F.concat(F.lit("### Ответ агента\n"), "a", F.lit("\n---\n"))).otherwise("### Other\n")
    text = F.concat(F.lit("### Запрос\n"), "q", F.lit("\n"), answer, F.lit("#### Выход расчётного модуля\n```turns\n  "), "n", F.lit("```"))
    home = shared_folder(spark, "answers")
    rows.select("conv_id", text.alias("value")).repartition("conv_id").write.partitionBy("conv_id").text(home)
    out = sections(answer_files(spark, home)).withColumn("conv_id", F.regexp_extract("path", r"conv_id=(\d+)/", 1).cast("bigint"))
    return out.select("conv_id", F.md5(F.col("question").cast("binary")).alias("question"), F.when(F.col("conv_id") % 5 != 0, F.md5(F.col("answer").cast("binary"))).alias("answer"), (F.col("answer") == F.col("text")).alias("whole"), "computed")


def q_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims of all levels; every third has none."""
    level = F.when(F.col("l_linenumber") % 3 != 0, F.element_at(F.array(*[F.lit(x) for x in LEVELS]), (F.col("l_linenumber") % 4 + 1).cast("int")))
    return _answers(spark, d, level).select("l_orderkey", F.md5(F.col("answer").cast("binary")).alias("md5"))


def q_citations(spark: SparkSession, d: str) -> DataFrame:
    return citations(_answers(spark, d), ["l_orderkey"]).select("l_orderkey", "place", "source_name", "date", "first", "last")


def _annotated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    level = F.element_at(F.array(*[F.lit(x) for x in LEVELS]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    fed = _lines(spark, d).where("l_linenumber % 5 <> 0").select("l_orderkey", "source_name", "date", F.col("l_linenumber").alias("page"), F.col("l_linenumber").alias("page_end"), level.alias("confidence"))
    return _answers(spark, d), fed


def q_annotated(spark: SparkSession, d: str) -> DataFrame:
    out = annotate(*_annotated(spark, d), ["l_orderkey"])
    return out.select("l_orderkey", F.md5(F.col("answer").cast("binary")).alias("md5"), "citations", "marked", "unmatched")


def q_marked(spark: SparkSession, d: str) -> DataFrame:
    answers, fed = _annotated(spark, d)
    return marked_pages(levels(citations(answers, ["l_orderkey"]), fed, ["l_orderkey"]), ["l_orderkey"])


def q_segments(spark: SparkSession, d: str) -> DataFrame:
    return segments(paragraphs(_answers(spark, d), ["l_orderkey"]), ["l_orderkey"]).select("l_orderkey", "block", "kind", F.md5(F.trim("text").cast("binary")).alias("md5"))


def q_checked(spark: SparkSession, d: str) -> DataFrame:
    return checked_numbers(_answers(spark, d), _pages(spark, d), ["l_orderkey"]).select("l_orderkey", "block", "number", "state")


def q_totals(spark: SparkSession, d: str) -> DataFrame:
    return check_totals(checked_numbers(_answers(spark, d), _pages(spark, d), ["l_orderkey"]), ["l_orderkey"])


def q_legends(spark: SparkSession, d: str) -> DataFrame:
    answers, fed = _annotated(spark, d)
    pages = marked_pages(levels(citations(answers, ["l_orderkey"]), fed, ["l_orderkey"]), ["l_orderkey"])
    out = with_legend(annotate(answers, fed, ["l_orderkey"]).select("l_orderkey", F.lit("").alias("answer")), legend(pages, ["l_orderkey"]), ["l_orderkey"])
    return out.select("l_orderkey", F.md5(F.col("answer").cast("binary")).alias("md5"))


def q_summary(spark: SparkSession, d: str) -> DataFrame:
    """By the first letter of an order's clerk and priority; some groups have web sources only."""
    totals = check_totals(checked_numbers(_answers(spark, d), _pages(spark, d), ["l_orderkey"]), ["l_orderkey"])
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus", (F.col("o_orderkey") % 7).cast("string")).alias("kind"))
    return check_summary(totals.join(orders, "l_orderkey"), "kind")


def q_allowed(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that pages' addresses, markup and numbers together allow."""
    p = table(spark, d, "pages")
    return allowed_numbers([p.select("page_id", F.col(c).cast("string").alias("text")) for c in ("url", "html", "page_id")], ["page_id"])


_BASE = """i AS (SELECT l_orderkey, l_linenumber, l_linestatus, CASE l_returnflag WHEN 'A' THEN 'архив' WHEN 'N' THEN 'новый' ELSE 'возврат' END AS source_name,
    CASE WHEN month(l_shipdate) <= 6 THEN 'июнь ' ELSE 'декабрь ' END || year(l_shipdate) AS date, printf('%.1f', l_quantity) AS q, printf('%.2f', l_discount) AS disc FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity, l_discount, l_shipdate, l_returnflag, l_linestatus) = 1),
  t AS (SELECT o_orderkey AS l_orderkey, printf('%.2f', o_totalprice) AS total, o_orderpriority = '1-URGENT' AS echo FROM orders SEMI JOIN lineitem ON l_orderkey = o_orderkey)"""
_CLAIM = """'объём ' || q || {sep} || 'при скидке ' || replace(disc, '.', ',') || CASE WHEN l_linestatus = 'O' THEN ' [Источник: ' || source_name || ', web]' ELSE ' [Отчёт ' || source_name || ', ' || date || ', с. ' || l_linenumber || {note} || ']' END"""
_LEVEL = "CASE WHEN l_linenumber % 5 <> 0 AND l_linestatus = 'F' THEN ['direct', 'geometry', 'unchecked', 'disputed'][l_linenumber % 4 + 1] END"
_NOTE = "CASE WHEN l_linenumber % 5 = 0 THEN '' ELSE ['', '; текст собран по геометрии страницы', '; сверка чтения не выполнялась', '; ⚠ два пути чтения расходятся по цифрам'][l_linenumber % 4 + 1] END"
_READ = "['', '; текст собран по геометрии страницы', '; сверка чтения не выполнялась', '; ⚠ два пути чтения расходятся по цифрам'][CASE WHEN l_linenumber % 3 = 0 THEN 3 ELSE l_linenumber % 4 + 1 END]"
_BLOCKS = f"""{_BASE}, n AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS INTEGER) AS block FROM i),
  z AS (SELECT l_orderkey, CAST(max(block) + 1 AS INTEGER) AS block FROM n GROUP BY 1)"""
_STATES = f"""{_BLOCKS}, pg AS (SELECT date, l_linenumber AS page, string_agg(DISTINCT q, '; ' ORDER BY q) AS text FROM i WHERE source_name = 'архив' AND l_linestatus = 'F' GROUP BY 1, 2),
  x AS (SELECT l_orderkey, block, unnest([q, replace(disc, '.', ',')]) AS number, l_linestatus, text FROM n LEFT JOIN pg ON pg.date = n.date AND page = l_linenumber),
  st AS (SELECT l_orderkey, block, number, CASE WHEN l_linestatus = 'O' THEN 'web' WHEN text IS NULL THEN 'no source' WHEN contains(text, replace(number, ',', '.')) OR contains(text, replace(number, '.', ',')) THEN 'found' ELSE 'missing' END AS state FROM x
    UNION ALL SELECT l_orderkey, block, total, CASE WHEN echo THEN 'echo' ELSE 'bare' END FROM z JOIN t USING (l_orderkey))"""
SQL = {
    "answer_sections": """
      WITH r AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) FILTER (WHERE role = 'user') AS q, string_agg(text, chr(10) ORDER BY turn, text) FILTER (WHERE role = 'assistant') AS a, count(*) AS n FROM conversations GROUP BY 1)
      SELECT conv_id, md5(coalesce(q, '')) AS question, CASE WHEN conv_id % 5 <> 0 THEN md5(coalesce(a, '')) END AS answer, conv_id % 5 = 0 AS whole, 'turns ' || n AS computed FROM r""",
    "claims": f"WITH {_BASE} SELECT l_orderkey, md5(string_agg({_CLAIM.format(sep='chr(10)', note=_READ)}, chr(10) || chr(10) ORDER BY l_linenumber) || chr(10) || ' ' || chr(10) || 'всего ' || any_value(total)) AS md5 FROM i JOIN t USING (l_orderkey) GROUP BY 1",
    "citations": f"WITH {_BASE} SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS INTEGER) AS place, source_name, date, l_linenumber AS first, l_linenumber AS last FROM i JOIN t USING (l_orderkey) WHERE l_linestatus = 'F'",
    "annotated_answers": f"""
      WITH {_BASE} SELECT l_orderkey, md5(string_agg({_CLAIM.format(sep="chr(10)", note=_NOTE)}, chr(10) || chr(10) ORDER BY l_linenumber) || chr(10) || ' ' || chr(10) || 'всего ' || any_value(total)) AS md5,
        count(*) FILTER (WHERE l_linestatus = 'F') AS citations, count(*) FILTER (WHERE l_linestatus = 'F' AND l_linenumber % 5 <> 0 AND l_linenumber % 4 <> 0) AS marked, count(*) FILTER (WHERE l_linestatus = 'F' AND l_linenumber % 5 = 0) AS unmatched
      FROM i JOIN t USING (l_orderkey) GROUP BY 1""",
    "marked_pages": f"""
      WITH {_BASE}, w AS (SELECT l_orderkey, {_LEVEL} AS level, source_name || ', ' || date || ', с. ' || l_linenumber AS p FROM i JOIN t USING (l_orderkey))
      SELECT l_orderkey, level, string_agg(DISTINCT p, '; ' ORDER BY p) AS pages FROM w WHERE level <> 'direct' GROUP BY 1, 2""",
    "answer_segments": f"""
      WITH {_BLOCKS} SELECT l_orderkey, block, CASE WHEN l_linestatus = 'O' THEN 'Источник' ELSE 'Отчёт' END AS kind, md5({_CLAIM.format(sep="' '", note=chr(39) * 2)}) AS md5 FROM n JOIN t USING (l_orderkey)
      UNION ALL SELECT l_orderkey, block, NULL, md5('всего ' || total) FROM z JOIN t USING (l_orderkey)""",
    "checked_numbers": f"WITH {_STATES} SELECT * FROM st SEMI JOIN t USING (l_orderkey)",
    "check_totals": f"""
      WITH {_STATES}, c AS (SELECT l_orderkey, count(*) FILTER (WHERE state IN ('found', 'missing')) AS checked, count(*) FILTER (WHERE state = 'missing') + count(DISTINCT block) FILTER (WHERE state = 'no source') AS missing,
        count(*) FILTER (WHERE state = 'bare') AS unmarked, count(*) FILTER (WHERE state = 'web') AS web FROM st SEMI JOIN t USING (l_orderkey) GROUP BY 1)
      SELECT *, missing = 0 AND unmarked = 0 AND checked > 0 AS ok FROM c""",
    "answer_legends": f"""
      WITH {_BASE}, w AS (SELECT l_orderkey, {_LEVEL} AS level, source_name || ', ' || date || ', с. ' || l_linenumber AS p FROM i JOIN t USING (l_orderkey)),
      g AS (SELECT l_orderkey, level, string_agg(DISTINCT p, '; ' ORDER BY p) AS pages FROM w WHERE level <> 'direct' GROUP BY 1, 2),
      l AS (SELECT l_orderkey, string_agg('* **' || CASE level WHEN 'disputed' THEN '⚠ два пути чтения расходятся по цифрам' WHEN 'unchecked' THEN 'сверка чтения не выполнялась' ELSE 'текст собран по геометрии страницы' END || '** (' || pages || ') — ' ||
        CASE level WHEN 'disputed' THEN '{ADVICE["disputed"]}' WHEN 'unchecked' THEN '{ADVICE["unchecked"]}' ELSE '{ADVICE["geometry"]}' END, chr(10) ORDER BY CASE level WHEN 'disputed' THEN 1 WHEN 'unchecked' THEN 2 ELSE 3 END) AS l FROM g GROUP BY 1)
      SELECT t.l_orderkey, md5(coalesce(chr(10) || chr(10) || '---' || chr(10) || l, '')) AS md5 FROM t LEFT JOIN l USING (l_orderkey)""",
    "check_summary": f"""
      WITH {_STATES}, c AS (SELECT l_orderkey, count(*) FILTER (WHERE state IN ('found', 'missing')) AS checked, count(*) FILTER (WHERE state = 'missing') + count(DISTINCT block) FILTER (WHERE state = 'no source') AS missing,
        count(*) FILTER (WHERE state = 'bare') AS unmarked, count(*) FILTER (WHERE state = 'web') AS web FROM st SEMI JOIN t USING (l_orderkey) GROUP BY 1),
      g AS (SELECT o_orderpriority || ' ' || o_orderstatus || ' ' || o_orderkey % 7 AS kind, count(*) AS answers, count(*) FILTER (WHERE NOT (missing = 0 AND unmarked = 0 AND checked > 0)) AS failed, CAST(sum(checked) AS BIGINT) AS checked,
        CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(unmarked) AS BIGINT) AS unmarked, CAST(sum(web) AS BIGINT) AS web FROM c JOIN orders ON o_orderkey = l_orderkey GROUP BY ROLLUP (1))
      SELECT *, CASE WHEN missing > 0 OR unmarked > 0 THEN 'failed' WHEN checked = 0 THEN 'nothing checked' ELSE 'ok' END AS verdict FROM g""",
    "allowed_numbers": rf"""
      WITH a AS (SELECT DISTINCT page_id, x FROM (SELECT page_id, unnest(regexp_extract_all(concat_ws(' ', url, html, page_id), '-?\d+(?:[.,]\d+)*')) AS x FROM pages)),
      b AS (SELECT page_id, x, string_split(replace(x, ',', '.'), '.') AS p FROM a)
      SELECT DISTINCT page_id, CASE WHEN regexp_full_match(x, '-?\d{{1,3}}([.,]\d{{3}})+') THEN regexp_replace(x, '[.,]', '', 'g')
        ELSE regexp_replace(printf('%.6f', CAST(CASE WHEN len(p) > 1 THEN array_to_string(p[1:len(p) - 1], '') || '.' || p[len(p)] ELSE x END AS DOUBLE)), '\.?0+$', '') END AS number FROM b""",
}
QUERIES = {
    "answer_sections": q_sections,
    
    "claims": q_claims, "citations": q_citations, "annotated_answers": q_annotated, "marked_pages": q_marked, "answer_segments": q_segments, "checked_numbers": q_checked, "check_totals": q_totals, "allowed_numbers": q_allowed,
    "answer_legends": q_legends, "check_summary": q_summary,
}
