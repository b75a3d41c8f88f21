"""Registers and stores: numbered records of a register, their tags, upserts, stamps, price files, file names and claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import collapse, file_meta, strip_tags
from ..sources import tables
from ..sources.tables import table
from .series import calendar, daily_price, keep_last

BEST_TAGS = 4


def records(files: DataFrame, key: list[str]) -> DataFrame:
    """(key, number, title, body, line): numbered records of Markdown registers (key, text). A heading of the third level opens one, the next record or a higher heading ends it."""
    lines = files.select(*key, F.posexplode(F.split("text", "\n")).alias("line", "s"))
    opens = F.col("s").rlike(r"^### Р-\d+\. .+$")
    w = W.partitionBy(*key).orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    # Each line learns the last heading above it: an opening one has its line, a higher one ends the record.
    mark = F.when(opens, F.col("line")).when(F.col("s").rlike("^##? "), F.lit(-1))
    held = lines.withColumn("of", F.last(mark, True).over(w)).where("of >= 0")
    rows = held.groupBy(*key, "of").agg(F.min(F.when(F.col("line") == F.col("of"), F.col("s"))).alias("h"), F.array_sort(F.collect_list(F.when(F.col("line") > F.col("of"), F.struct("line", "s")))).alias("b"))
    part = lambda i: F.regexp_extract("h", r"^### (Р-\d+)\. (.+)$", i)
    return rows.select(*key, part(1).alias("number"), part(2).alias("title"), F.array_join(F.transform("b", lambda x: x["s"]), "\n").alias("body"), F.col("of").alias("line"))


def subjects(rows: DataFrame, key: list[str], tags: dict[str, list[str]]) -> DataFrame:
    """``rows`` with ``tags``: the four whose words occur most in title, task and choice of a record, by name; of equal ones the first by name."""
    field = lambda name: F.regexp_extract("body", rf"(?s)\*\*{name}\.\*\*(.*?)(?=\n\*\*|\z)", 1)
    low = F.lower(F.concat_ws("\n", "title", field("Задача"), field("Выбранная альтернатива")))
    hits = [F.struct((-sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))).alias("n"), F.lit(tag).alias("tag")) for tag, words in sorted(tags.items())]
    best = F.slice(F.array_sort(F.filter(F.array(*hits), lambda h: h["n"] < 0)), 1, BEST_TAGS)
    return rows.withColumn("tags", F.array_sort(F.transform(best, lambda h: h["tag"])))


def tag_summary(rows: DataFrame, group: list[str]) -> DataFrame:
    """records, untagged, the median and the most of tags a record, by group; of an even number of records the upper of the two in the middle is the median."""
    often = rows.groupBy(*group, F.size("tags").alias("n")).agg(F.count("*").alias("times"))
    w = W.partitionBy(*group)
    placed = often.withColumns({"upto": F.sum("times").over(w.orderBy("n").rowsBetween(W.unboundedPreceding, 0)), "all": F.sum("times").over(w)})
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("n")))
    return placed.groupBy(*group).agg(F.sum("times").alias("records"), F.sum(F.when(F.col("n") == 0, F.col("times")).otherwise(0)).alias("untagged"), middle.alias("median_tags"), F.max("n").alias("most_tags"))


def upsert(points: DataFrame, new: DataFrame, dimension: int) -> DataFrame:
    """Points (id, vector, payload) with new ones in place of those of the same id; of new ones with one id the largest payload counts. A vector of another dimension is an error."""
    good = F.when(F.size("vector") == dimension, F.col("vector")).otherwise(F.raise_error(F.concat(F.lit("not of the store's dimension: "), F.col("id").cast("string"))))
    w = W.partitionBy("id").orderBy(F.col("payload").desc())
    some = new.select("id", good.alias("vector"), "payload").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return points.join(some, "id", "left_anti").select("id", "vector", "payload").unionByName(some)


def claims_of(hits: DataFrame, web: DataFrame) -> DataFrame:
    """Claims (kind, source_name, date, page, text, score) of report hits and of web results, which have no page; blank texts give none."""
    r = hits.select(F.lit("report").alias("kind"), "source_name", "date", "page", F.trim("text").alias("text"), "score")
    s = web.select(F.lit("web").alias("kind"), F.col("host").alias("source_name"), F.lit(None).cast("string").alias("date"), F.lit(None).cast("int").alias("page"), F.trim(F.concat_ws(". ", "title", "snippet")).alias("text"), F.lit(None).cast("double").alias("score"))
    return r.unionByName(s).where("text <> ''")


def preferred_first(rows: DataFrame, group: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows (preferred, position) of each group: preferred ones first, each kind in its order."""
    w = W.partitionBy(*group).orderBy(F.col("preferred").desc(), "position")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


# ---- Queries over the given tables -------------------------------------------------------------

SUBJECTS = {"сталь": ["steel", "bolt"], "мелкое": ["small", "economy"], "крупное": ["large", "standard"], "холод": ["cold", "promo"], "кольца": ["ring", "gear"], "виджеты": ["widget", "valve"]}


def _registers(spark: SparkSession, d: str) -> DataFrame:
    """A register a brand: parts are its records; parts of a size divisible by ten follow a section that is no record."""
    p = table(spark, d, "part")
    text = F.concat(
        F.lit("### Р-"), F.col("p_partkey").cast("string"), F.lit(". "), "p_name", F.lit("\nintro gear\n**Задача.** Make "), "p_type", F.lit("\nof size\n**Обоснование.** widget ring\n**Выбранная альтернатива.** "), F.when(F.col("p_size") > 25, "large").otherwise("small"),
        F.when(F.col("p_size") % 10 == 0, "\n## Notes\nno record\n# Top\nnone").otherwise(""),
    )
    held = p.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", text.alias("t")))).alias("t"))
    return held.select("p_brand", F.concat(F.lit("# Register\nnothing\n"), F.array_join(F.transform("t", lambda x: x["t"]), "\n")).alias("text"))


def q_records(spark: SparkSession, d: str) -> DataFrame:
    return records(_registers(spark, d), ["p_brand"]).select("p_brand", "number", "title", F.md5(F.col("body").cast("binary")).alias("body"))


def q_subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects(records(_registers(spark, d), ["p_brand"]), ["p_brand"], SUBJECTS).select("number", F.array_join("tags", ",").alias("tags"))


def q_summary(spark: SparkSession, d: str) -> DataFrame:
    return tag_summary(subjects(records(_registers(spark, d), ["p_brand"]), ["p_brand"], SUBJECTS), ["p_brand"])


def q_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh vector comes anew, turned round and twice, beside new ones."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("payload"))
    turned = e.where("id % 7 = 0").select("id", F.reverse("vector").alias("vector"), F.explode(F.array(F.col("payload") + 100, F.col("payload") + 50)).alias("payload"))
    out = upsert(e, turned.unionByName(turned.withColumn("id", F.col("id") + 1_000_000)), 64)
    return out.select("id", F.round(F.element_at("vector", 1).cast("double"), 6).alias("first"), "payload")


def q_stamps(spark: SparkSession, d: str) -> DataFrame:
    """Properties of events as stamps, some cut off; the setting now is the user's number."""
    e = table(spark, d, "events")
    text = F.when(F.col("event_id") % 11 == 0, F.expr("substring(props, 1, length(props) - 1)")).when(F.col("event_id") % 13 == 0, "[1]").otherwise(F.col("props"))
    stamp = e.select("event_id", tables.settings(text, "k int").alias("s")).where("s IS NOT NULL").select("event_id", F.lit("k").alias("field"), F.col("s.k").cast("string").alias("value"))
    now = e.select("event_id", F.lit("k").alias("field"), F.col("user_id").cast("string").alias("value"))
    return tables.mismatches(stamp, now, ["event_id"])


def q_prices(spark: SparkSession, d: str) -> DataFrame:
    """Daily prices to CSV files, with a wrong line before each and a blank one after some Mondays, and back: the last line of a day counts, blanks take the price before."""
    p = daily_price(spark, d).withColumn("cents", F.round(F.col("close") * 100).cast("bigint"))
    good = p.select("date", F.lit(1).alias("k"), (F.col("cents") / 100).cast("string").alias("close"))
    wrong = p.select("date", F.lit(0).alias("k"), F.lit("n/a 1").alias("close"))
    blank = p.where("dayofweek(date) = 2").select("date", F.lit(2).alias("k"), F.lit(None).cast("string").alias("close"))
    path = tables.shared_folder(spark, "prices")
    tables.write_prices(good.unionByName(wrong).unionByName(blank), path)
    rows = keep_last(tables.require(tables.price_csv(spark, path), ["date", "close"]), "date", "ord").drop("ord")
    return calendar(rows).select("date", F.round("close", 2).alias("close"))


def q_names(spark: SparkSession, d: str) -> DataFrame:
    """Files named after orders: by month, by year, or neither."""
    o = table(spark, d, "orders")
    stamp = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "_yyyy-MM")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "-yyyy")).otherwise("_final")
    path = F.concat(F.lit("/data/in.put/"), F.replace("o_orderpriority", F.lit("-"), F.lit("_")), F.lit("_Report"), stamp, F.lit(".PDF"))
    return o.select("o_orderkey", file_meta(path).alias("m")).select("o_orderkey", "m.*")


def q_claims(spark: SparkSession, d: str) -> DataFrame:
    """Documents are hits, pages web results; the first words of each stand for titles and snippets."""
    docs = table(spark, d, "documents").select(F.col("source").alias("source_name"), F.col("lang").alias("date"), (F.col("doc_id") % 9).cast("int").alias("page"), F.col("text"), F.col("n_chars").cast("double").alias("score"))
    pages = table(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("host"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), collapse(strip_tags(F.col("html"))).alias("snippet"))
    out = claims_of(docs, pages)
    return out.groupBy("kind", "source_name", "date", "page").agg(F.count("*").alias("n"), F.sum("score").alias("score"), F.sum(F.length("text")).alias("chars"))


def q_preferred(spark: SparkSession, d: str) -> DataFrame:
    """Of each user's events the first five, purchases before others."""
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("preferred"), F.col("event_id").alias("position"))
    return preferred_first(e, ["user_id"], 5).select("user_id", "event_id", "place")


_PART = """p AS (SELECT *, p_type || chr(10) || 'of size' AS task, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS pick, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) = 1 AS last FROM part),
  h AS (SELECT *, lower(p_name || chr(10) || ' Make ' || task || chr(10) || ' ' || pick) AS low FROM p),
  t AS (SELECT p_brand, p_partkey, x.tag, len(list_filter(x.words, lambda w: contains(low, w))) AS n FROM h,
    (VALUES ('сталь', ['steel', 'bolt']), ('мелкое', ['small', 'economy']), ('крупное', ['large', 'standard']), ('холод', ['cold', 'promo']), ('кольца', ['ring', 'gear']), ('виджеты', ['widget', 'valve'])) x(tag, words)),
  b AS (SELECT * FROM t WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY n DESC, tag) <= 4),
  g AS (SELECT p.p_brand, p.p_partkey, count(tag) AS n, coalesce(string_agg(tag, ',' ORDER BY tag), '') AS tags FROM p LEFT JOIN b USING (p_partkey) GROUP BY 1, 2)"""
SQL = {
    "register_records": f"""
      WITH {_PART} SELECT p_brand, 'Р-' || p_partkey AS number, p_name AS title, md5('intro gear' || chr(10) || '**Задача.** Make ' || task || chr(10) || '**Обоснование.** widget ring' || chr(10) || '**Выбранная альтернатива.** ' || pick) AS body FROM p""",
    "record_subjects": f"WITH {_PART} SELECT 'Р-' || p_partkey AS number, tags FROM g",
    "tag_summary": f"WITH {_PART} SELECT p_brand, count(*) AS records, count(*) FILTER (WHERE n = 0) AS untagged, CAST(list_sort(list(n))[count(*) // 2 + 1] AS INTEGER) AS median_tags, CAST(max(n) AS INTEGER) AS most_tags FROM g GROUP BY 1",
    "vector_upsert": """
      SELECT vec_id AS id, round(CAST(CASE WHEN vec_id % 7 = 0 THEN embedding[64] ELSE embedding[1] END AS DOUBLE), 6) AS first, CASE WHEN vec_id % 7 = 0 THEN label + 100 ELSE label END AS payload FROM embeddings
      UNION ALL SELECT vec_id + 1000000, round(CAST(embedding[64] AS DOUBLE), 6), label + 100 FROM embeddings WHERE vec_id % 7 = 0""",
    "stamp_mismatches": """
      SELECT event_id, 'k' AS field, regexp_extract(props, '"k": (-?[0-9]+)', 1) AS stamped, CAST(user_id AS VARCHAR) AS now FROM events
      WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 AND regexp_extract(props, '"k": (-?[0-9]+)', 1) <> CAST(user_id AS VARCHAR)""",
    "price_files": """
      WITH o AS (SELECT CAST(o_orderdate AS DATE) AS date, sum(CAST(round(o_totalprice * 100) AS BIGINT)) / count(*) / 100 AS close FROM orders GROUP BY 1),
      k AS (SELECT date, CASE WHEN dayofweek(date) <> 1 THEN round(close * 100) / 100 END AS close FROM o),
      d AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM o)
      SELECT date, round(coalesce(last_value(close IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), first_value(close IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 2) AS close FROM d LEFT JOIN k USING (date)""",
    "file_names": """
      SELECT o_orderkey, replace(o_orderpriority, '-', ' ') || ' Report' || CASE WHEN o_orderkey % 3 = 2 THEN ' final' ELSE '' END AS source_name,
        CASE o_orderkey % 3 WHEN 0 THEN ['январь', 'февраль', 'март', 'апрель', 'май', 'июнь', 'июль', 'август', 'сентябрь', 'октябрь', 'ноябрь', 'декабрь'][month(o_orderdate)] || ' ' || year(o_orderdate) WHEN 1 THEN CAST(year(o_orderdate) AS VARCHAR) ELSE '' END AS date FROM orders""",
    "shaped_claims": r"""
      WITH w AS (SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, trim(regexp_extract(html, '<title>([^<]*)', 1) || '. ' || regexp_replace(regexp_replace(trim(regexp_replace(html, '<[^>]+>', '', 'g'), ' '), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ') AS text FROM pages),
      c AS (SELECT 'report' AS kind, source AS source_name, lang AS date, CAST(doc_id % 9 AS INTEGER) AS page, trim(text, ' ') AS text, CAST(n_chars AS DOUBLE) AS score FROM documents UNION ALL SELECT 'web', host, NULL, NULL, text, NULL FROM w)
      SELECT kind, source_name, date, page, count(*) AS n, sum(score) AS score, CAST(sum(length(text)) AS BIGINT) AS chars FROM c WHERE text <> '' GROUP BY 1, 2, 3, 4""",
    "preferred_first": "SELECT user_id, event_id, row_number() OVER w AS place FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_type = 'purchase' DESC, event_id) QUALIFY row_number() OVER w <= 5",
}
QUERIES = {
    "register_records": q_records, "record_subjects": q_subjects, "tag_summary": q_summary, "vector_upsert": q_upsert, "stamp_mismatches": q_stamps, "price_files": q_prices, "file_names": q_names, "shaped_claims": q_claims,
    "preferred_first": q_preferred,
}
