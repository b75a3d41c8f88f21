"""Pages of text: character streams, window chunks, as-of context, readings that are compared, and web pages."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import content_id, digit_ratio, host, strip_tags
from ..sources.tables import on_workers, table

SIZE, OVERLAP = 1200, 200
VERDICTS = ["agree", "order", "tokenize", "diverge"]  # from best to worst
NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def windows(docs: DataFrame, cut: str | None = None, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, start, stop, text): windows over each text, in closed form.

    With ``cut`` (a regular expression) the text is split before each match that is not at its start, and no window
    crosses a split; a window starts anew there, without overlap. An empty text has none.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    step = size - overlap
    # Each segment with its start and whether it is the last; then its windows as one array, so that no row repeats a whole text.
    parts = F.split("text", f"(?={cut})") if cut else F.array("text")
    starts = "aggregate(parts, array(0), (acc, p) -> concat(acc, array(element_at(acc, -1) + length(p))))"
    seg = docs.where("text <> ''").select("doc_id", parts.alias("parts")).select("doc_id", "parts", F.expr(starts).alias("starts"))
    seg = seg.select("doc_id", F.explode(F.expr("transform(parts, (p, i) -> struct(p, starts[i] as st, i = size(parts) - 1 as final))")).alias("s")).select("doc_id", "s.*")
    n = F.length("p")
    last = F.greatest(F.lit(0), F.ceil((n - size) / step))
    inner = F.when(n < size, 0).otherwise(F.floor((n - size) / step) + 1)
    inner = inner - F.when(inner * step >= n, 1).otherwise(0)
    k = F.when(F.col("final"), last).otherwise(inner).cast("int")
    at = lambda i: i.cast("bigint") * step
    window = lambda i: F.struct((F.col("st") + at(i)).alias("start"), (F.col("st") + F.least(at(i) + size, n)).alias("stop"), F.substring("p", at(i).cast("int") + 1, F.lit(size)).alias("text"))
    return seg.where(n > 0).select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), k), window)).alias("w")).select("doc_id", "w.*")


def as_of(rows: DataFrame, marks: DataFrame, key: list[str], at: str, value: str, tolerance: int) -> DataFrame:
    """Each row with the value of the nearest mark at or before it, if that is no further than the tolerance. Both have ``key`` and ``at``."""
    both = rows.withColumn("__mark", F.lit(None).cast("struct<v:string,at:bigint>")).unionByName(
        marks.select(*key, at, F.struct(F.col(value).cast("string").alias("v"), F.col(at).cast("bigint").alias("at")).alias("__mark")), allowMissingColumns=True
    )
    w = W.partitionBy(*key).orderBy(F.col(at), F.col("__mark").isNull()).rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("__near", F.last("__mark", True).over(w)).where("__mark IS NULL")
    near = F.when(F.col(at) - F.col("__near.at") <= tolerance, F.col("__near.v"))
    return found.withColumn(value, near).drop("__mark", "__near")


def numbers(text: Column) -> Column:
    """Numbers that are not glued to letters, without signs of plus and thousands commas."""
    found = F.regexp_extract_all(text, F.lit(r"(?U)(?=[+-]?\d)(?<![\w.])[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?!\w)"), F.lit(0))
    return F.transform(found, lambda x: F.translate(x, ",+", ""))


def _digits(tokens: Column) -> Column:
    """How often each digit occurs in the tokens: their multiset, in ten numbers."""
    text = F.array_join(tokens, "")
    return F.array(*[F.length(text) - F.length(F.replace(text, F.lit(str(i)), F.lit(""))) for i in range(10)])


def verdict(a: Column, b: Column) -> Column:
    """How two readings' numbers compare: equal, reordered, cut otherwise (same digits), or different."""
    return F.when(a == b, "agree").when(F.sort_array(a) == F.sort_array(b), "order").when(_digits(a) == _digits(b), "tokenize").otherwise("diverge")


def cross_check(readings: DataFrame) -> DataFrame:
    """(doc_id, reader_a, reader_b, verdict) of all pairs of readings (doc_id, reader, tokens) of a page.

    A reading is told by digests of its tokens in order, sorted, and of their digits: some bytes a row are shuffled once.
    """
    digest = lambda t: F.sha2(F.array_join(t.cast("array<string>"), "\x01").cast("binary"), 256)
    t = F.col("tokens")
    prints = readings.select("doc_id", "reader", digest(t).alias("a"), digest(F.sort_array(t)).alias("b"), digest(_digits(t)).alias("c"))
    held = prints.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("reader", "a", "b", "c"))).alias("r"))  # readers are few
    told = lambda x, y: F.when(x["a"] == y["a"], "agree").when(x["b"] == y["b"], "order").when(x["c"] == y["c"], "tokenize").otherwise("diverge")
    pair = lambda x, y: F.struct(x["reader"].alias("reader_a"), y["reader"].alias("reader_b"), told(x, y).alias("verdict"))
    pairs = F.flatten(F.transform("r", lambda x: F.transform(F.filter("r", lambda y: x["reader"] < y["reader"]), lambda y: pair(x, y))))
    return held.select("doc_id", F.inline(pairs))


def worst(verdicts: DataFrame) -> DataFrame:
    """The worst verdict of each page and its outlier: the first reader that is worse with every other than those are among themselves."""
    rank = F.array_position(F.array(*[F.lit(v) for v in VERDICTS]), F.col("verdict")).cast("int")
    v = verdicts.withColumn("rank", rank)
    page = v.groupBy("doc_id").agg(F.max("rank").alias("worst"), F.collect_list(F.struct("reader_a", "reader_b", "rank")).alias("pairs"))  # readers are few
    readers = "array_sort(array_distinct(flatten(transform(pairs, p -> array(p.reader_a, p.reader_b)))))"
    out = f"""get(filter({readers}, r -> size({readers}) >= 3
        AND array_min(transform(filter(pairs, p -> p.reader_a = r OR p.reader_b = r), p -> p.rank))
          > array_max(transform(filter(pairs, p -> p.reader_a <> r AND p.reader_b <> r), p -> p.rank))), 0)"""
    return page.select("doc_id", F.element_at(F.array(*[F.lit(x) for x in VERDICTS]), F.col("worst")).alias("verdict"), F.expr(out).alias("outlier"))


def left_over(left: Iterable[str | None], right: Iterable[str | None]) -> list[tuple[int, str]]:
    """(pos, token) of the left that the right has not as often, in order: the k-th occurrence meets the k-th. Nulls are no tokens."""
    more, out = Counter(right), []
    for pos, token in enumerate(left):
        if more[token] > 0:
            more[token] -= 1
        elif token is not None:
            out.append((pos, token))
    return out


def strings(cell: pa.ListScalar) -> Iterable[str | None]:
    """The strings of one array; null has none."""
    return cell.values.to_numpy(zero_copy_only=False) if cell.is_valid else ()


def residual(readings: DataFrame) -> DataFrame:
    """(doc_id, pos, token): tokens of the left array that the right has not as often, of readings (doc_id, left, right). Nothing is shuffled."""
    on_workers(readings.sparkSession)

    @F.arrow_udf("array<struct<pos int, token string>>")
    def held(left: pa.Array, right: pa.Array) -> pa.Array:
        # One page's tokens at a time are Python's.
        rows = [[{"pos": n, "token": x} for n, x in left_over(strings(a), strings(b))] for a, b in zip(left, right)]
        return pa.array(rows, pa.list_(pa.struct([("pos", pa.int32()), ("token", pa.string())])))

    return readings.select("doc_id", held("left", "right").alias("r")).select("doc_id", F.inline("r"))


def one_per_host(pages: DataFrame, denied: list[str], preferred: list[str]) -> DataFrame:
    """(host, page_id, preferred): the first page of each host that is neither denied nor below a denied domain."""
    under = lambda names: F.lit(False) if not names else F.exists(F.array(*[F.lit(n) for n in names]), lambda n: (F.col("host") == n) | F.endswith(F.col("host"), F.concat(F.lit("."), n)))
    rows = pages.withColumn("host", host(F.col("url"))).where("host <> ''").where(~under(denied))
    first = rows.groupBy("host").agg(F.min("page_id").alias("page_id"))
    return first.withColumn("preferred", under(preferred))


def _readings(spark: SparkSession, d: str) -> DataFrame:
    """Three readings of every document: as it is, in reverse order, and without its digits."""
    docs = table(spark, d, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), " ").alias("t"))
    three = F.array(
        F.struct(F.lit("alpha").alias("reader"), F.col("t").alias("tokens")),
        F.struct(F.lit("beta").alias("reader"), F.reverse("t").alias("tokens")),
        F.struct(F.lit("gamma").alias("reader"), F.transform("t", lambda x: F.regexp_replace(x, "[0-9]", "")).alias("tokens")),
    )
    return docs.select("doc_id", F.inline(three))


def q_windows(spark: SparkSession, d: str) -> DataFrame:
    return windows(table(spark, d, "documents")).select("doc_id", "start", "stop", F.md5(F.col("text").cast("binary")).alias("md5"))


def q_windows_cut(spark: SparkSession, d: str) -> DataFrame:
    return windows(table(spark, d, "documents"), cut="\n").select("doc_id", "start", "stop")


def q_chunk_id(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", content_id(NAMESPACE, F.col("source"), F.col("lang"), F.col("text")).alias("chunk_id"))


def q_as_of(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type", "event_id")
    marks = e.where("event_type = 'purchase'").groupBy("user_id", "at").agg(F.max("event_id").alias("mark"))
    return as_of(e.where("event_type <> 'purchase'").select("user_id", "at", "event_id"), marks, ["user_id"], "at", "mark", 86_400_000_000).select("event_id", F.col("mark").cast("bigint").alias("mark"))


def q_cross(spark: SparkSession, d: str) -> DataFrame:
    return cross_check(_readings(spark, d))


def q_worst(spark: SparkSession, d: str) -> DataFrame:
    return worst(cross_check(_readings(spark, d)))


def q_residual(spark: SparkSession, d: str) -> DataFrame:
    """The tokens of every document against those without their digits."""
    docs = table(spark, d, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), " ").alias("left"))
    return residual(docs.select("doc_id", "left", F.transform("left", lambda x: F.regexp_replace(x, "[0-9]", "")).alias("right")))


def q_hosts(spark: SparkSession, d: str) -> DataFrame:
    return one_per_host(table(spark, d, "pages"), ["example.net"], ["example.org"])


def q_digits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.round(digit_ratio(F.col("text")), 9).alias("ratio"))


def q_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(strip_tags(F.col("html")).cast("binary")).alias("md5"))


_R = """r AS (SELECT doc_id, 'alpha' AS reader, string_split(text, ' ') AS t FROM documents UNION ALL SELECT doc_id, 'beta', list_reverse(string_split(text, ' ')) FROM documents
  UNION ALL SELECT doc_id, 'gamma', list_transform(string_split(text, ' '), lambda x: regexp_replace(x, '[0-9]', '', 'g')) FROM documents),
x AS (SELECT a.doc_id, a.reader AS reader_a, b.reader AS reader_b, CASE WHEN a.t = b.t THEN 'agree' WHEN list_sort(a.t) = list_sort(b.t) THEN 'order'
  WHEN list_sort(string_split(regexp_replace(array_to_string(a.t, ''), '[^0-9]', '', 'g'), '')) = list_sort(string_split(regexp_replace(array_to_string(b.t, ''), '[^0-9]', '', 'g'), '')) THEN 'tokenize' ELSE 'diverge' END AS verdict
  FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.reader < b.reader)"""
SQL = {
    "chunk_windows": """
      SELECT doc_id, CAST(k * 1000 AS BIGINT) AS start, CAST(least(k * 1000 + 1200, length(text)) AS BIGINT) AS stop, md5(substr(text, k * 1000 + 1, 1200)) AS md5
      FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(0, ceil((length(text) - 1200) / 1000)) AS BIGINT) + 1)) AS k FROM documents WHERE text <> '')""",
    "asof_caption": """
      WITH e AS (SELECT user_id, epoch_us(ts) AS us, event_type, event_id FROM events),
      m AS (SELECT user_id, us, max(event_id) AS mark FROM e WHERE event_type = 'purchase' GROUP BY 1, 2)
      SELECT e.event_id, CASE WHEN e.us - m.us <= 86400000000 THEN m.mark END AS mark FROM (SELECT * FROM e WHERE event_type <> 'purchase') e ASOF LEFT JOIN m ON e.user_id = m.user_id AND e.us >= m.us""",
    "reader_crosscheck": f"WITH {_R} SELECT * FROM x",
    "worst_verdict": f"""
      WITH {_R}, k AS (SELECT *, list_position(['agree', 'order', 'tokenize', 'diverge'], verdict) AS rank FROM x),
      o AS (SELECT doc_id, s.reader FROM k, (VALUES ('alpha'), ('beta'), ('gamma')) s(reader) GROUP BY 1, 2
            HAVING min(CASE WHEN s.reader IN (reader_a, reader_b) THEN rank END) > max(CASE WHEN s.reader NOT IN (reader_a, reader_b) THEN rank END))
      SELECT doc_id, ['agree', 'order', 'tokenize', 'diverge'][max(rank)] AS verdict, (SELECT min(reader) FROM o WHERE o.doc_id = k.doc_id) AS outlier FROM k GROUP BY doc_id""",
    "multiset_residual": """
      WITH t AS (SELECT doc_id, unnest(string_split(text, ' ')) AS token, CAST(unnest(range(len(string_split(text, ' ')))) AS INTEGER) AS pos FROM documents),
      n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, token ORDER BY pos) AS k FROM t), g AS (SELECT doc_id, regexp_replace(token, '[0-9]', '', 'g') AS token, count(*) AS n FROM t GROUP BY ALL)
      SELECT doc_id, token, pos FROM n LEFT JOIN g USING (doc_id, token) WHERE k > coalesce(g.n, 0)""",
    "chunk_windows_cut": """
      WITH s AS (SELECT doc_id, text, unnest(string_split(substr(text, 2), chr(10))) AS p, unnest(range(len(string_split(substr(text, 2), chr(10))))) AS i, len(string_split(substr(text, 2), chr(10))) AS m FROM documents WHERE text <> ''),
      l AS (SELECT doc_id, i, i = m - 1 AS final, CAST(length(p) + 1 AS BIGINT) AS n FROM s),
      o AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS st FROM l),
      k AS (SELECT *, unnest(range(0, n // 1000 + 1)) AS k FROM o)
      SELECT doc_id, st + k * 1000 AS start, CAST(st + least(k * 1000 + 1200, n) AS BIGINT) AS stop FROM k
      WHERE CASE WHEN final THEN k = 0 OR (k - 1) * 1000 + 1200 < n ELSE k = 0 OR ((k - 1) * 1000 + 1200 <= n AND k * 1000 < n) END""",
    "chunk_id": """
      WITH h AS (SELECT doc_id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(coalesce(source, '') || '|' || coalesce(lang, '') || '|' || coalesce(text, ''))) AS h FROM documents)
      SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8', '9', 'a', 'b'][CAST('0x' || h[17] AS INTEGER) % 4 + 1] || h[18:20] || '-' || h[21:32] AS chunk_id FROM h""",
    "one_per_domain": r"""
      WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') AS host FROM pages)
      SELECT host, min(page_id) AS page_id, host = 'example.org' OR ends_with(host, '.example.org') AS preferred FROM h WHERE host <> '' AND host <> 'example.net' AND NOT ends_with(host, '.example.net') GROUP BY 1""",
    "digit_ratio": "SELECT doc_id, round(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^0-9]', '', 'g')) / length(text) ELSE 0 END, 9) AS ratio FROM documents",
    "strip_tags": "SELECT page_id, md5(trim(regexp_replace(html, '<[^>]+>', '', 'g'), ' ')) AS md5 FROM pages",
}
QUERIES = {
    "chunk_windows": q_windows, "chunk_windows_cut": q_windows_cut, "chunk_id": q_chunk_id, "asof_caption": q_as_of, "reader_crosscheck": q_cross, "worst_verdict": q_worst,
    "multiset_residual": q_residual, "one_per_domain": q_hosts, "digit_ratio": q_digits, "strip_tags": q_tags,
}
