"""Evidence: confidence of fragments, citations, supported numbers, tags, and trails of shown fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import NUMBER, host
from ..sources.tables import table
from .pages import verdict
from .registry import turns

LEVELS = ["direct", "geometry", "unchecked", "disputed"]  # from best to worst
RARE, BROAD = 3, 0.4  # tags on fewer records, or on a larger share of them, tell little


def _rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level).cast("int")


def _level(rank: Column) -> Column:
    return F.when(rank.isNotNull(), F.element_at(F.array(*[F.lit(x) for x in LEVELS]), rank))


def level_of(found: Column) -> Column:
    """Confidence level of a page's verdict; no verdict is unchecked."""
    return F.when(found == "agree", "direct").when(found.isin("order", "tokenize"), "geometry").when(found == "diverge", "disputed").otherwise("unchecked")


def chunk_confidence(chunks: DataFrame, verdicts: DataFrame, key: list[str]) -> DataFrame:
    """(key, page_start, page_end, confidence, caveats): the worst level over a chunk's pages, and its pages that do not agree.

    Chunks have ``key``, page_start and page_end (taken as page_start if before it); verdicts have ``key``, page and verdict.
    A page without a verdict is unchecked and gives no caveat. Caveats are "page:verdict", in page order.
    """
    last = F.greatest("page_start", "page_end")
    spread = chunks.select(*key, "page_start", "page_end", F.explode(F.sequence("page_start", last)).alias("page"))
    rows = spread.join(verdicts.select(*key, "page", "verdict"), [*key, "page"], "left")
    caveat = F.when(F.col("verdict") != "agree", F.struct("page", F.concat_ws(":", F.col("page").cast("string"), "verdict").alias("said")))
    out = rows.groupBy(*key, "page_start", "page_end").agg(F.max(_rank(level_of(F.col("verdict")))).alias("worst"), F.sort_array(F.collect_set(caveat)).alias("c"))
    return out.select(*key, "page_start", "page_end", _level(F.col("worst")).alias("confidence"), F.col("c.said").alias("caveats"))


def citation_levels(citations: DataFrame, fragments: DataFrame, key: list[str]) -> DataFrame:
    """Each citation (citation_id, key, first, last) with the worst level of the fragments (key, page, page_end, level) whose pages meet its own, or null."""
    f = fragments.select(*key, F.col("page").alias("__p"), F.col("page_end").alias("__e"), _rank(F.col("level")).alias("__r"))
    meets = citations.join(f, key).where("NOT (__e < first OR __p > last)").groupBy("citation_id").agg(F.max("__r").alias("__r"))
    return citations.join(meets, "citation_id", "left").withColumn("level", _level(F.col("__r"))).drop("__r")


def citation_stats(marked: DataFrame, group: list[str]) -> DataFrame:
    """citations, marked (a level that is not direct) and unmatched, by group."""
    return marked.groupBy(*group).agg(F.count("*").alias("citations"), F.count_if(F.col("level") != "direct").alias("marked"), F.count_if(F.col("level").isNull()).alias("unmatched"))


def normal_numbers(text: Column) -> Column:
    """Distinct numbers of a text, in order and in one spelling: groups of three digits lose their separators, the last of other separators is the
    decimal point, and six decimals are kept, less the zeros at their end.

    A number is rounded by the exact value of its double. The JVM rounds the shortest decimal of it instead, which is another number from
    sixteen digits or seven decimals on: only such numbers go to Python.
    """
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    point = lambda x: F.regexp_replace(F.regexp_replace(x, r"[.,](?=.*[.,])", ""), ",", ".")
    grouped = lambda x: x.rlike(r"^-?\d{1,3}(?:[.,]\d{3})+$")
    fine = lambda x: ~grouped(x) & ((F.length(x) > 15) | x.rlike(r"[.,]\d{7,}$"))

    @F.udf("map<string,string>")
    def exact(values):  # type hints would choose another kind of UDF
        return {x: f"{float(x):.6f}".rstrip("0").rstrip(".") for x in values or []}

    def plain(x: Column, known: Column) -> Column:
        value = F.regexp_replace(F.format_string("%.6f", point(x).cast("double")), r"\.?0+$", "")
        return F.when(grouped(x), F.regexp_replace(x, "[.,]", "")).when(fine(x), F.element_at(known, point(x))).otherwise(value)

    both = F.array(F.struct(found.alias("found"), exact(F.transform(F.filter(found, fine), point)).alias("exact")))
    return F.array_distinct(F.transform(both, lambda b: F.transform(b["found"], lambda x: plain(x, b["exact"])))[0])


def unsupported_numbers(answers: DataFrame, sources: DataFrame, key: list[str]) -> DataFrame:
    """(key, number) of numbers in the answers (key, text) that none of their sources (key, text) has."""
    numbers = lambda x: x.select(*key, F.explode(normal_numbers(F.col("text"))).alias("number")).distinct()
    return numbers(answers).join(numbers(sources), [*key, "number"], "left_anti")


def tagged(rows: DataFrame, fields: list[str], tags: list[str]) -> DataFrame:
    """``rows`` with ``tags``: those that occur in any of the fields, in any case, in the given order."""
    low = F.lower(F.concat_ws("\n", *fields))
    return rows.withColumn("tags", F.filter(F.array(*[F.lit(t) for t in tags]), lambda t: F.contains(low, F.lower(t))))


def tag_statistics(rows: DataFrame) -> DataFrame:
    """(tag, records, share, rare, broad) of all tags in use, from rows that ``tagged`` gave."""
    held = rows.select(F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("tags"))).alias("tag"))  # null: the row itself
    counts = held.groupBy("tag").agg(F.count("*").alias("records"))  # as many rows as tags
    total = counts.where("tag IS NULL").select(F.col("records").alias("total"))
    out = counts.where("tag IS NOT NULL").join(F.broadcast(total))
    return out.select("tag", "records", (F.col("records") / F.col("total")).alias("share"), (F.col("records") < RARE).alias("rare"), (F.col("records") / F.col("total") > BROAD).alias("broad"))


def host_statistics(rows: DataFrame, group: list[str], denied: list[str], preferred: list[str]) -> DataFrame:
    """results, preferred, denied and failed (no host) of rows with a ``url``, by group; a name stands for its subdomains too."""
    at = host(F.col("url"))
    under = lambda names: F.exists(F.array(*[F.lit(n) for n in names]).cast("array<string>"), lambda n: (F.col("__host") == n) | F.endswith(F.col("__host"), F.concat(F.lit("."), n)))
    known = rows.withColumn("__host", F.coalesce(at, F.lit("")))
    return known.groupBy(*group).agg(
        F.count("*").alias("results"), F.count_if(under(preferred)).alias("preferred"), F.count_if(under(denied)).alias("denied"), F.count_if(F.col("__host") == "").alias("failed")
    )


def chunk_trail(shown: DataFrame) -> DataFrame:
    """Fragments (conv_id, chunk, ordinal, position) once a conversation, where they were shown last: latest turn, then first position."""
    w = W.partitionBy("conv_id", "chunk").orderBy(F.col("ordinal").desc(), "position")
    return shown.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def add_links(links: DataFrame, new: DataFrame) -> DataFrame:
    """Links (conv_id, linked) with new ones; a link to itself is refused, a known one ignored."""
    return links.unionByName(new).where("conv_id <> linked").distinct()


def linked_chunks(links: DataFrame, trail: DataFrame) -> DataFrame:
    """(conv_id, linked, chunk) of directly linked conversations only."""
    return links.join(trail.select(F.col("conv_id").alias("linked"), "chunk"), "linked").select("conv_id", "linked", "chunk")


def without(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` less those whose key is gone; applied to each table of a conversation, it deletes the conversation."""
    return rows.join(gone.select(*key).distinct(), key, "left_anti")


def _shown(spark: SparkSession, d: str) -> DataFrame:
    """Lines of turns as fragments."""
    t = turns(table(spark, d, "conversations")).select("conv_id", "ordinal", F.posexplode(F.split("text", "\n")).alias("position", "line"))
    return t.select("conv_id", F.md5(F.col("line").cast("binary")).alias("chunk"), "ordinal", "position")


def q_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Lines are pages; every other reading of a line differs in its order or its digits, and empty lines are not read."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("doc_id", (F.col("i") + 1).alias("page"), "line")
    a = F.split("line", " ")
    b = F.when(F.col("page") % 2 == 0, F.reverse(a)).when(F.col("page") % 3 == 0, F.transform(a, lambda x: F.regexp_replace(x, "[0-9]", ""))).otherwise(a)
    verdicts = lines.where("line <> ''").select("doc_id", "page", verdict(a, b).alias("verdict"))
    chunks = lines.where("page % 2 = 1").select("doc_id", F.col("page").alias("page_start"), (F.col("page") + 2).alias("page_end"))
    return chunk_confidence(chunks, verdicts, ["doc_id"]).withColumn("caveats", F.array_join("caveats", ","))


def _marked(spark: SparkSession, d: str) -> DataFrame:
    """Orders cite pages 2 and 3 of themselves; their lines that are closed are fragments of two pages."""
    lines = table(spark, d, "lineitem")
    level = F.when(F.col("l_returnflag") == "A", "direct").when(F.col("l_returnflag") == "N", "geometry").otherwise("disputed")
    fragments = lines.where("l_linestatus = 'F'").select("l_orderkey", F.col("l_linenumber").alias("page"), (F.col("l_linenumber") + 1).alias("page_end"), level.alias("level"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("citation_id"), F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.lit(2).alias("first"), F.lit(3).alias("last"))
    return citation_levels(orders, fragments, ["l_orderkey"])


def q_citations(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).select("citation_id", "level")


def q_citation_stats(spark: SparkSession, d: str) -> DataFrame:
    return citation_stats(_marked(spark, d), ["o_custkey"])


def q_unsupported(spark: SparkSession, d: str) -> DataFrame:
    """Numbers on a page that its address does not have."""
    p = table(spark, d, "pages")
    return unsupported_numbers(p.select("page_id", F.col("html").alias("text")), p.select("page_id", F.col("url").alias("text")), ["page_id"])


WORDS = ["small", "medium", "ring", "bolt", "gear", "economy"]


def q_tags(spark: SparkSession, d: str) -> DataFrame:
    return tagged(table(spark, d, "part"), ["p_name", "p_type"], WORDS).select("p_partkey", F.array_join("tags", ",").alias("tags"))


def q_tag_stats(spark: SparkSession, d: str) -> DataFrame:
    return tag_statistics(tagged(table(spark, d, "part"), ["p_name", "p_type"], WORDS)).withColumn("share", F.round("share", 9))


def q_hosts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").withColumn("lang", F.regexp_extract("html", '<html lang="([a-z]+)"', 1))
    return host_statistics(p, ["lang"], ["example.net"], ["example.org"])


def q_trail(spark: SparkSession, d: str) -> DataFrame:
    return chunk_trail(_shown(spark, d))


def _links(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation is linked to that of half its number and to its predecessor."""
    ids = table(spark, d, "conversations").select("conv_id").distinct()
    return add_links(ids.select("conv_id", F.expr("conv_id div 2").alias("linked")), ids.select("conv_id", (F.col("conv_id") - 1).alias("linked")))


def q_linked(spark: SparkSession, d: str) -> DataFrame:
    return linked_chunks(_links(spark, d), chunk_trail(_shown(spark, d)))


def q_delete(spark: SparkSession, d: str) -> DataFrame:
    """What is left of all turns once conversations of more than four turns are deleted."""
    rows = table(spark, d, "conversations")
    return without(rows, rows.where("turn >= 4"), ["conv_id"]).select("conv_id", "turn", "role")


_SHOWN = """t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS ordinal FROM conversations),
  s AS (SELECT conv_id, ordinal, unnest(string_split(text, chr(10))) AS line, CAST(unnest(range(0, len(string_split(text, chr(10))))) AS INTEGER) AS position FROM t),
  trail AS (SELECT conv_id, md5(line) AS chunk, ordinal, position FROM s QUALIFY row_number() OVER (PARTITION BY conv_id, md5(line) ORDER BY ordinal DESC, position) = 1)"""
_MARKED = """g AS (SELECT l_orderkey, l_linenumber AS p, l_linenumber + 1 AS e, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 4 END AS r FROM lineitem WHERE l_linestatus = 'F'),
  m AS (SELECT o_orderkey AS citation_id, o_custkey, ['direct', 'geometry', 'unchecked', 'disputed'][max(r)] AS level
    FROM orders LEFT JOIN g ON o_orderkey = l_orderkey AND NOT (e < 2 OR p > 3) GROUP BY 1, 2)"""
_PARTS = "string_split(replace(x, ',', '.'), '.')"
_PLAIN = rf"""CASE WHEN regexp_full_match(x, '-?\d{{1,3}}([.,]\d{{3}})+') THEN regexp_replace(x, '[.,]', '', 'g')
  ELSE regexp_replace(printf('%.6f', CAST(CASE WHEN len({_PARTS}) > 1 THEN array_to_string({_PARTS}[1:len({_PARTS}) - 1], '') || '.' || {_PARTS}[len({_PARTS})] ELSE x END AS DOUBLE)), '\.?0+$', '') END"""
_HAS = "contains(lower(p_name || chr(10) || p_type), x)"
SQL = {
    "chunk_confidence": """
      WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS INTEGER) AS page FROM documents),
      r AS (SELECT doc_id, page, string_split(line, ' ') AS a, CASE WHEN page % 2 = 0 THEN list_reverse(string_split(line, ' '))
        WHEN page % 3 = 0 THEN list_transform(string_split(line, ' '), lambda x: regexp_replace(x, '[0-9]', '', 'g')) ELSE string_split(line, ' ') END AS b FROM l WHERE line <> ''),
      v AS (SELECT doc_id, page, CASE WHEN a = b THEN 'agree' WHEN list_sort(a) = list_sort(b) THEN 'order'
        WHEN list_sort(string_split(regexp_replace(array_to_string(a, ''), '[^0-9]', '', 'g'), '')) = list_sort(string_split(regexp_replace(array_to_string(b, ''), '[^0-9]', '', 'g'), '')) THEN 'tokenize' ELSE 'diverge' END AS verdict FROM r),
      c AS (SELECT doc_id, page AS page_start, CAST(page + 2 AS INTEGER) AS page_end, CAST(unnest([page, page + 1, page + 2]) AS INTEGER) AS page FROM l WHERE page % 2 = 1)
      SELECT doc_id, page_start, page_end, ['direct', 'geometry', 'unchecked', 'disputed'][max(CASE verdict WHEN 'agree' THEN 1 WHEN 'order' THEN 2 WHEN 'tokenize' THEN 2 WHEN 'diverge' THEN 4 ELSE 3 END)] AS confidence,
        coalesce(string_agg(page || ':' || verdict, ',' ORDER BY page) FILTER (WHERE verdict <> 'agree'), '') AS caveats
      FROM c LEFT JOIN v USING (doc_id, page) GROUP BY 1, 2, 3""",
    "citation_levels": f"WITH {_MARKED} SELECT citation_id, level FROM m",
    "citation_stats": f"WITH {_MARKED} SELECT o_custkey, count(*) AS citations, count(*) FILTER (WHERE level <> 'direct') AS marked, count(*) FILTER (WHERE level IS NULL) AS unmatched FROM m GROUP BY 1",
    "unsupported_numbers": rf"""
      WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '-?\d+(?:[.,]\d+)*')) AS x FROM pages), s AS (SELECT page_id, unnest(regexp_extract_all(url, '-?\d+(?:[.,]\d+)*')) AS x FROM pages)
      SELECT page_id, {_PLAIN} AS number FROM a EXCEPT SELECT page_id, {_PLAIN} FROM s""",
    "tagged_parts": f"SELECT p_partkey, array_to_string(list_filter({WORDS}, lambda x: {_HAS}), ',') AS tags FROM part",
    "tag_statistics": f"""
      SELECT x AS tag, count(*) AS records, round(count(*) / (SELECT count(*) FROM part), 9) AS share, count(*) < 3 AS rare, count(*) / (SELECT count(*) FROM part) > 0.4 AS broad
      FROM part, (SELECT unnest({WORDS}) AS x) WHERE {_HAS} GROUP BY 1""",
    "host_statistics": r"""
      WITH h AS (SELECT regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, coalesce(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', ''), '') AS host FROM pages)
      SELECT lang, count(*) AS results, count(*) FILTER (WHERE host = 'example.org' OR ends_with(host, '.example.org')) AS preferred,
        count(*) FILTER (WHERE host = 'example.net' OR ends_with(host, '.example.net')) AS denied, count(*) FILTER (WHERE host = '') AS failed FROM h GROUP BY 1""",
    "chunk_trail": f"WITH {_SHOWN} SELECT conv_id, chunk, ordinal, position FROM trail",
    "linked_chunks": f"""
      WITH {_SHOWN}, i AS (SELECT DISTINCT conv_id FROM conversations), k AS (SELECT conv_id, conv_id // 2 AS linked FROM i UNION SELECT conv_id, conv_id - 1 FROM i)
      SELECT k.conv_id, linked, chunk FROM k JOIN trail ON trail.conv_id = linked WHERE k.conv_id <> linked""",
    "delete_threads": "SELECT conv_id, turn, role FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn >= 4)",
}
QUERIES = {
    "chunk_confidence": q_confidence, "citation_levels": q_citations, "citation_stats": q_citation_stats, "unsupported_numbers": q_unsupported, "tagged_parts": q_tags, "tag_statistics": q_tag_stats,
    "host_statistics": q_hosts, "chunk_trail": q_trail, "linked_chunks": q_linked, "delete_threads": q_delete,
}
