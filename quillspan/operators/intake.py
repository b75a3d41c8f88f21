"""Acceptance of PDF files: what their bytes say about the container, its revisions, pages, fonts and text, without a PDF library.

Files are rows (path, content). Objects and cross-reference sections become rows of their own, so pages meet their contents and
entries meet the objects they point at by joins; only deflated streams pass through a small function.
"""

from __future__ import annotations

import zlib
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import table
from .reports import find_all

#: Steps of severity, the worst last, and how many bytes may come before a header and after the end mark (fixed values).
SEVERITY = ["ok", "notice", "unknown", "warn", "broken"]
HEAD, TAIL, LOOK = 1024, 4096, 32
OBJECT = r"(?s)\b\d{1,10}\s+\d{1,5}\s+obj\b.*?\bendobj\b"
SECTION = r"(?s)\bxref\b.*?\bstartxref\b"
SHOWS_TEXT = r"[)>\]]\s*(?:Tj|TJ|'|\")"


def number(text: Column, pattern: str) -> Column:
    """The first group of a pattern as a number, null where it does not match."""
    return F.regexp_extract(text, pattern, 1).try_cast("bigint")


def inflated(streams: Column) -> Column:
    """Deflated bytes as ISO-8859-1 text, empty where they can't be read; null stays null."""

    def all_(column: pd.Series) -> pd.Series:
        def one(data: bytes | None) -> str | None:
            try:
                return None if data is None else zlib.decompressobj().decompress(bytes(data)).decode("latin-1")
            except zlib.error:
                return ""

        return column.map(one)

    return F.pandas_udf(all_, "string")(streams)


def objects(files: DataFrame) -> DataFrame:
    """(path, at, num, body, latest) of all objects of files (path, text); of those of one number the last in a file is the latest."""
    found = find_all(files, ["path"], "text", OBJECT)
    w = W.partitionBy("path", "num").orderBy(F.col("at").desc())
    rows = found.select("path", "at", number(F.col("found"), r"^(\d+)").alias("num"), F.col("found").alias("body"))
    return rows.withColumn("latest", F.row_number().over(w) == 1)


def sections(files: DataFrame, objs: DataFrame) -> DataFrame:
    """(path, at, prev, body) of the cross-reference sections: tables, and streams of objects (body null); prev is where the one before stands."""
    prev = lambda c: number(F.col(c), r"/Prev\s+(\d+)")
    plain = find_all(files, ["path"], "text", SECTION).select("path", "at", prev("found").alias("prev"), F.col("found").alias("body"))
    streams = objs.where(F.col("body").rlike(r"/Type\s*/XRef\b")).select("path", "at", prev("body").alias("prev"), F.lit(None).cast("string").alias("body"))
    return plain.unionByName(streams)


def entries(found: DataFrame) -> DataFrame:
    """(path, num, offset) of the entries in use of cross-reference tables: numbers run on from the head of each part of a table."""
    token = r"(\d{10} \d{5} [nf]|\d+ \d+(?=[ \t]*[\r\n]))"
    each = found.where("body IS NOT NULL").select("path", F.col("at").alias("section"), F.posexplode(F.regexp_extract_all("body", F.lit(token), F.lit(1))).alias("i", "token"))
    head = F.when(F.length("token") != 18, F.struct(number(F.col("token"), r"^(\d+)").alias("first"), "i"))
    w = W.partitionBy("path", "section").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    each = each.withColumn("head", F.last(head, True).over(w)).where(F.col("token").endswith("n") & F.col("head").isNotNull())
    return each.select("path", (F.col("head.first") + F.col("i") - F.col("head.i") - 1).alias("num"), number(F.col("token"), r"^(\d{10})").alias("offset"))


def chains(files: DataFrame, found: DataFrame) -> DataFrame:
    """(path, chain): how many sections the last startxref of files (path, startxref) leads to, one by one; a ring ends where it began."""
    held = found.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("at", "prev"))).alias("to"))
    seed = F.struct(F.col("startxref").alias("at"), F.array().cast("array<bigint>").alias("seen"))

    def step(a: Column, _: Column) -> Column:
        goes = a["at"].isNotNull() & F.coalesce(F.map_contains_key("to", a["at"]), F.lit(False)) & ~F.array_contains(a["seen"], F.coalesce(a["at"], F.lit(-1)))
        return F.struct(F.when(goes, F.try_element_at("to", a["at"])).alias("at"), F.when(goes, F.concat(a["seen"], F.array(a["at"]))).otherwise(a["seen"]).alias("seen"))

    walked = F.aggregate(F.sequence(F.lit(1), F.size("to")), seed, step)
    return files.select("path", "startxref").join(held, "path").select("path", F.size(walked["seen"]).alias("chain"))


def _layers(objs: DataFrame) -> DataFrame:
    """(path, pages, count, fonts, fonts_unmapped, textless): pages found and told by the page tree, fonts, and pages that show no text."""
    now = objs.where("latest")
    kind = lambda name: F.col("body").rlike(rf"/Type\s*/{name}(?![A-Za-z])")
    font = kind("Font") & ~F.col("body").rlike(r"/Subtype\s*/CIDFont")
    counts = now.groupBy("path").agg(
        F.count_if(kind("Page")).alias("pages"), F.max(F.when(kind("Pages") & ~F.contains("body", F.lit("/Parent")), number(F.col("body"), r"/Count\s+(\d+)"))).alias("count"),
        F.count_if(font).alias("fonts"), F.count_if(font & ~F.contains("body", F.lit("/ToUnicode"))).alias("fonts_unmapped"),
    )
    refs = F.regexp_extract_all(F.regexp_extract("body", r"(?s)/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", 1), F.lit(r"(\d+)\s+\d+\s+R"), F.lit(1))
    pages = now.where(kind("Page")).select("path", F.col("num").alias("page"), F.explode_outer(refs).alias("ref"))
    pages = pages.select("path", "page", F.col("ref").try_cast("bigint").alias("num"))
    raw = F.regexp_extract("body", r"(?s)\bstream\r?\n(.*?)\r?\n?endstream", 1)
    deflated = F.contains("body", F.lit("/FlateDecode"))
    streams = now.where(F.contains("body", F.lit("endstream"))).join(pages.select("path", "num").distinct(), ["path", "num"], "left_semi")
    shown = F.when(deflated, inflated(F.when(deflated, F.encode(raw, "ISO-8859-1")))).otherwise(raw)
    streams = streams.select("path", "num", shown.rlike(SHOWS_TEXT).alias("text"))
    each = pages.join(streams, ["path", "num"], "left").groupBy("path", "page").agg(F.coalesce(F.bool_or("text"), F.lit(False)).alias("text"))
    return counts.join(each.groupBy("path").agg(F.count_if(~F.col("text")).alias("textless")), "path", "left")


def inspect(files: DataFrame) -> DataFrame:
    """One row a file (path, content; null content: it could not be read): severity, readable, facts and findings (code, severity, detail), in the order of the checks.

    Facts: size, version, revisions (end marks), startxref, chain (sections that are reached from it), astray (entries in use that point at no object of their number), pages, count, fonts, fonts_unmapped, textless.
    """
    base = files.select("path", F.length("content").cast("bigint").alias("size"), F.decode("content", "ISO-8859-1").alias("text"))
    last = F.element_at(F.split("text", "startxref"), -1)
    base = base.withColumns({
        "header": F.contains(F.substring("text", 1, HEAD), F.lit("%PDF-")), "version": F.nullif(F.regexp_extract(F.substring("text", 1, HEAD), r"%PDF-(\d+\.\d+)", 1), F.lit("")),
        "eof": F.contains(F.expr(f"right(text, {TAIL})"), F.lit("%%EOF")), "revisions": F.regexp_count("text", F.lit("%%EOF")), "encrypted": F.contains("text", F.lit("/Encrypt")),
        "startxref": F.when(F.contains("text", F.lit("startxref")), number(last, r"^\s+(\d+)")), "entry": F.contains("text", F.lit("startxref")),
    })
    base = base.withColumn("there", F.when(F.col("startxref").between(1, F.col("size") - 1), F.substring("text", (F.col("startxref") + 1).cast("int"), F.lit(LOOK))))
    # Texts go no further: objects and sections are cut from them here, facts are numbers.
    texts, facts = base.select("path", "text"), base.drop("text")
    objs = objects(texts)
    found = sections(texts, objs)
    astray = entries(found).join(objs.select("path", "num", F.col("at").alias("offset"), F.lit(True).alias("here")), ["path", "num", "offset"], "left")
    astray = astray.groupBy("path").agg(F.count_if(F.col("here").isNull()).alias("astray"))
    facts = facts.join(_layers(objs), "path", "left").join(chains(facts, found), "path", "left").join(astray, "path", "left")

    def finding(when: Column, code: str, severity: str, *detail: Column | str) -> Column:
        words = F.concat(*[F.lit(d) if isinstance(d, str) else F.coalesce(d.cast("string"), F.lit("?")) for d in detail])
        return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), words.alias("detail")))

    some, at = F.col("size") > 0, F.col("startxref")
    lost = some & F.col("entry") & (at.isNull() | (at < 1) | (at >= F.col("size")))
    aligned = F.col("there").rlike(r"^\s*(?:xref|%|<<)") | F.col("there").rlike(r"^\s*\d+\s+\d+\s+obj")
    empty, pages = F.coalesce("textless", F.lit(0)), F.coalesce("pages", F.lit(0))
    found = F.array(
        finding(F.col("size").isNull(), "unreadable", "broken", "the file could not be read"),
        finding(F.col("size") == 0, "empty", "broken", "the file has no bytes"),
        finding(some & ~F.col("header"), "no_header", "broken", f"no %PDF- in the first {HEAD} bytes"),
        finding(some & ~F.col("eof"), "no_eof", "broken", "no %%EOF at the end: the file was cut off"),
        finding(F.col("revisions") > 1, "incremental_updates", "notice", F.col("revisions"), " revisions: the last one counts"),
        finding(some & ~F.col("entry"), "no_startxref", "broken", "nothing tells where the cross-references are"),
        finding(lost & at.isNull(), "bad_startxref", "broken", "no number after startxref"),
        finding(lost & at.isNotNull(), "startxref_out_of_range", "broken", "startxref ", at, " of ", F.col("size"), " bytes"),
        finding(F.col("there").isNotNull() & ~aligned, "startxref_misaligned", "warn", "neither xref nor an object at ", at),
        finding(F.col("encrypted"), "encrypted", "warn", "the file says that it is encrypted"),
        finding(some & F.col("count").isNull(), "no_page_count", "warn", "no page tree tells a count"),
        finding(F.col("fonts_unmapped") > 0, "fonts_without_tounicode", "notice", F.col("fonts_unmapped"), " of ", F.col("fonts"), " fonts have no map to Unicode"),
        finding((pages > 0) & (empty == pages), "no_text_layer", "warn", "no page shows text"),
        finding((pages > 0) & (empty > 0) & (empty < pages), "pages_without_text", "notice", empty, " of ", pages, " pages show no text"),
        finding(F.col("count") != pages, "page_count_mismatch", "warn", "the page tree tells ", F.col("count"), " pages, ", pages, " are there"),
    )
    order = F.array(*[F.lit(s) for s in SEVERITY])
    out = facts.withColumn("findings", F.filter(found, lambda x: x.isNotNull()))
    worst = F.array_max(F.transform("findings", lambda x: F.array_position(order, x["severity"]).cast("int")))
    out = out.withColumn("severity", F.when(F.size("findings") == 0, SEVERITY[0]).otherwise(F.element_at(order, worst)))
    return out.select(
        "path", "severity", F.col("severity").isin("ok", "notice").alias("readable"), "size", "version", "revisions", "startxref", F.coalesce("chain", F.lit(0)).alias("chain"),
        F.coalesce("astray", F.lit(0)).alias("astray"), pages.alias("pages"), "count", F.coalesce("fonts", F.lit(0)).alias("fonts"), F.coalesce("fonts_unmapped", F.lit(0)).alias("fonts_unmapped"), empty.alias("textless"), "findings",
    )


def inspect_folder(spark: SparkSession, path: str) -> DataFrame:
    """``inspect`` of all PDF files below a folder, in any case of the suffix; files whose content cannot be read are reported, not left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(path)
    # Spark reads no files without bytes: they are listed, but no rows.
    listed = spark.createDataFrame([(unquote(f).replace("file:///", "file:/", 1),) for f in files.inputFiles()], "path string")
    sized, whole = files.select("path", F.lit(True).alias("some")), files.select("path", "content")
    content = F.when(F.col("some").isNull(), F.lit(b"")).otherwise(F.col("content"))
    return inspect(listed.join(sized, "path", "left").join(whole, "path", "left").select("path", content.alias("content")))


# ---- Files made of pages: one a page, each of them whole or spoiled in one way --------------------

WAYS = ["whole", "cut", "revised", "beyond", "astray", "encrypted", "unmapped", "textless", "counted", "headless", "empty", "unread", "misdirected", "deflated"]


def _deflated(texts: Column) -> Column:
    def all_(column: pd.Series) -> pd.Series:
        return column.map(lambda t: None if t is None else zlib.compress(t.encode("latin-1")))

    return F.pandas_udf(all_, "binary")(texts)


def made_files(pages: DataFrame) -> DataFrame:
    """(path, way, content) of PDF files that hold the tags' text of pages (page_id, html), spoiled by turns."""
    n = F.col("page_id") % len(WAYS)
    way = F.element_at(F.array(*[F.lit(w) for w in WAYS]), (n + 1).cast("int"))
    rows = pages.select("page_id", way.alias("way"), F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " "), r"[^A-Za-z0-9 ]+", " ").alias("words"))
    shows = F.concat(F.lit("BT ("), "words", F.lit(") Tj ET"))
    stream = F.when(F.col("way") == "textless", "0 0 m 9 9 l S").when(F.col("way") == "deflated", F.decode(_deflated(F.when(F.col("way") == "deflated", shows)), "ISO-8859-1")).otherwise(shows)
    is_ = lambda *ways: F.col("way").isin(*ways)
    rows = rows.withColumns({
        "o0": F.when(is_("headless"), "no header\n").otherwise("%PDF-1.4\n"), "o1": F.lit("1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n"),
        "o2": F.concat(F.lit("2 0 obj\n<< /Type /Pages /Kids [3 0 R] /Count "), F.when(is_("counted"), "2").otherwise("1"), F.lit(" >>\nendobj\n")),
        "o3": F.lit("3 0 obj\n<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>\nendobj\n"),
        "o4": F.concat(F.lit("4 0 obj\n<< /Length 1"), F.when(is_("deflated"), " /Filter /FlateDecode").otherwise(""), F.lit(" >>\nstream\n"), stream, F.lit("\nendstream\nendobj\n")),
        "o5": F.concat(F.lit("5 0 obj\n<< /Type /Font /Subtype /Type1"), F.when(is_("unmapped"), "").otherwise(" /ToUnicode 9 0 R"), F.lit(" >>\nendobj\n")),
    })
    places = [F.length(F.concat(*[F.col(f"o{j}") for j in range(i)])) for i in range(1, 7)]
    table_ = lambda first, offsets: F.concat(F.lit(f"xref\n0 1\n{0:010d} 65535 f \n{first} {len(offsets)}\n"), *[F.format_string("%010d 00000 n \n", o.cast("bigint")) for o in offsets])
    body, start = F.concat(*[F.col(f"o{j}") for j in range(6)]), places[5]
    shifted = [places[0], places[1] + F.when(is_("misdirected"), 2).otherwise(0), *places[2:5]]
    at = F.when(is_("beyond"), start + 100_000_000).when(is_("astray"), start - 30).otherwise(start)
    end = F.concat(F.lit("trailer\n<< /Size 6 /Root 1 0 R"), F.when(is_("encrypted"), " /Encrypt 8 0 R").otherwise(""), F.lit(" >>\nstartxref\n"), at.cast("string"), F.lit("\n%%EOF\n"))
    rows = rows.select("page_id", "way", "o4", start.alias("start"), F.concat(body, table_(1, shifted), end).alias("file"))
    # A revision: the contents again, with a section that names the one before.
    size = F.length("file")
    again = F.concat("o4", table_(4, [size]), F.lit("trailer\n<< /Size 6 /Root 1 0 R /Prev "), F.col("start").cast("string"), F.lit(" >>\nstartxref\n"), (size + F.length("o4")).cast("string"), F.lit("\n%%EOF\n"))
    file = F.when(is_("revised"), F.concat("file", again)).when(is_("cut"), F.substring(F.col("file"), F.lit(1), size - 7)).when(is_("empty"), "").when(~is_("unread"), F.col("file"))
    return rows.select(F.format_string("%d.pdf", "page_id").alias("path"), "way", F.encode(file, "ISO-8859-1").alias("content"))


def q_intake(spark: SparkSession, d: str) -> DataFrame:
    out = inspect(made_files(table(spark, d, "pages")).drop("way"))
    codes = F.array_join(F.transform("findings", lambda x: x["code"]), ",")
    return out.select("path", "severity", "readable", "revisions", "chain", "astray", "pages", "count", "fonts", "fonts_unmapped", "textless", codes.alias("codes"), "version")


_WAY = f"list_extract({WAYS!r}, CAST(page_id % {len(WAYS)} AS INTEGER) + 1)"
SQL = {
    "pdf_intake": f"""
      WITH p AS (SELECT page_id || '.pdf' AS path, {_WAY} AS w FROM pages)
      SELECT path, CASE WHEN w IN ('cut', 'beyond', 'headless', 'empty', 'unread') THEN 'broken' WHEN w IN ('astray', 'encrypted', 'textless', 'counted') THEN 'warn' WHEN w IN ('revised', 'unmapped') THEN 'notice' ELSE 'ok' END AS severity,
        w IN ('whole', 'revised', 'unmapped', 'misdirected', 'deflated') AS readable, CASE w WHEN 'revised' THEN 2 WHEN 'cut' THEN 0 WHEN 'empty' THEN 0 WHEN 'unread' THEN NULL ELSE 1 END AS revisions,
        CASE WHEN w = 'revised' THEN 2 WHEN w IN ('beyond', 'astray', 'empty', 'unread') THEN 0 ELSE 1 END AS chain, CASE w WHEN 'misdirected' THEN 1 ELSE 0 END AS astray,
        CASE WHEN w IN ('empty', 'unread') THEN 0 ELSE 1 END AS pages, CASE WHEN w IN ('empty', 'unread') THEN NULL WHEN w = 'counted' THEN 2 ELSE 1 END AS count, CASE WHEN w IN ('empty', 'unread') THEN 0 ELSE 1 END AS fonts,
        CASE w WHEN 'unmapped' THEN 1 ELSE 0 END AS fonts_unmapped, CASE w WHEN 'textless' THEN 1 ELSE 0 END AS textless,
        CASE w WHEN 'cut' THEN 'no_eof' WHEN 'revised' THEN 'incremental_updates' WHEN 'beyond' THEN 'startxref_out_of_range' WHEN 'astray' THEN 'startxref_misaligned' WHEN 'encrypted' THEN 'encrypted' WHEN 'unmapped' THEN 'fonts_without_tounicode'
          WHEN 'textless' THEN 'no_text_layer' WHEN 'counted' THEN 'page_count_mismatch' WHEN 'headless' THEN 'no_header' WHEN 'empty' THEN 'empty' WHEN 'unread' THEN 'unreadable' ELSE '' END AS codes,
        CASE WHEN w IN ('headless', 'empty', 'unread') THEN NULL ELSE '1.4' END AS version FROM p""",
}
QUERIES = {"pdf_intake": q_intake}
