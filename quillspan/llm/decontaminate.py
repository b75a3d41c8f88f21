"""Benchmark decontamination by winnowing, with DataFrame functions only.

Of every nine consecutive hashes of five words the smallest is a fingerprint, so any shared
span of thirteen words shares one. Document fingerprints meet the benchmark's; around
each hit the thirteen-word spans are compared as text with the benchmark's windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, less, maybe_in, stored, table, whole_rows, words

WINDOW, GRAM = 13, 5
GUARD = WINDOW - GRAM + 1  # hashes in a winnowing window
POSITION_BITS = 28
#: Broadcast up to this many benchmark fingerprints and windows (about 100 MB); beyond it both meet documents in shuffled joins.
BROADCAST_ROWS = 500_000


def _span(ws: Column, start: Column, n: Column | int) -> Column:
    """n words from the 0-based start, A-Z in lower case, joined by spaces."""
    return F.translate(F.array_join(F.slice(ws, start + 1, n), " "), UPPER, LOWER)


def _fingerprints(ws: str) -> Column:
    """(hash << 28 | position) of the smallest hash of each window; the hash ignores case.

    A text of 13 words or more has them; equal windows have equal smallest hashes.
    """
    hashed = f"transform({ws}, w -> xxhash64(lower(w)))"
    gram = ", ".join(f"g[i + {j}]" for j in range(GRAM))
    grams = f"transform(sequence(0, size(g) - {GRAM}), i -> (xxhash64({gram}) & -{1 << POSITION_BITS}) | cast(i as bigint))"
    window = ", ".join(f"p[i + {j}]" for j in range(GUARD))
    winnow = f"array_distinct(transform(sequence(0, size(p) - {GUARD}), i -> least({window})))"
    # Each step once a row: an array of one element stands in for a name.
    inner = f"transform(transform(array({hashed}), g -> {grams}), p -> {winnow})[0]"
    return F.expr(f"if(size({ws}) >= {WINDOW}, {inner}, array())")


def _windows(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, n (words of the window) and window: every distinct one of every item."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("ws")).where("size(ws) > 0")
    items = items.withColumn("n", F.least(F.size("ws"), F.lit(WINDOW)))
    each = items.select("item_id", "n", "ws", F.explode(F.expr("sequence(0, size(ws) - n)")).alias("at"))
    return each.select("item_id", "n", _span(F.col("ws"), F.col("at"), F.col("n")).alias("window")).distinct()


def _candidates(docs: DataFrame, windows: DataFrame, hint) -> DataFrame:
    """(doc_id, k, n_words, copies, at): places (0-based word, words) where a window may stand; one row for each id and text.

    Exploded rows carry hashes and positions only. One sentinel (-1) a document keeps documents without places and counts copies.
    """
    keyed = docs.select("doc_id", F.xxhash64("text").alias("k"), words(F.col("text")).alias("ws"))
    prints = keyed.select("doc_id", "k", F.size("ws").alias("n_words"), _fingerprints("ws").alias("p"))
    prints = prints.select("doc_id", "k", "n_words", F.explode(F.concat(F.array(F.lit(-1).cast("long")), "p")).alias("p"))
    prints = prints.withColumn("hash", F.expr(f"if(p = -1, null, shiftright(p, {POSITION_BITS}))")).withColumn("pos", F.expr(f"cast(p & {(1 << POSITION_BITS) - 1} as int)"))
    long_items = windows.where(F.col("n") == WINDOW).select(F.split("window", " ").alias("ws"))
    known = long_items.select(F.explode(_fingerprints("ws")).alias("p")).select(F.expr(f"shiftright(p, {POSITION_BITS})").alias("hash")).distinct()
    # A hit's window may start at any of nine words.
    near = F.expr(f"if(met, sequence(greatest(0, pos - {GUARD - 1}), least(pos, n_words - {WINDOW})), null)")
    rows = prints.join(hint(known.withColumn("met", F.lit(True))), "hash", "left").where("met OR p = -1")
    rows = rows.select("doc_id", "k", "n_words", (F.col("p") == -1).alias("own"), F.explode_outer(near).alias("i"), F.lit(WINDOW).alias("n"))
    # An item of fewer than 13 words is found by its longest word, wherever that is: at most 12 lengths and places a word.
    first = windows.where(F.col("n") < WINDOW).withColumn("ws", F.split("window", " "))
    if not first.isEmpty():
        anchor = first.select("n", F.expr("array_max(transform(ws, (w, i) -> struct(length(w) as l, -i as o, w)))").alias("a"))
        anchor = anchor.select(F.xxhash64(F.lower("a.w")).alias("word"), F.struct("n", (-F.col("a.o")).alias("o")).alias("s"))
        anchor = anchor.groupBy("word").agg(F.collect_set("s").alias("shapes"))
        each = keyed.select("doc_id", "k", F.size("ws").alias("n_words"), F.expr("transform(ws, w -> xxhash64(lower(w)))").alias("hs"))
        each = each.select("doc_id", "k", "n_words", F.posexplode("hs").alias("pos", "word")).join(hint(anchor), "word")
        each = each.select("doc_id", "k", "n_words", "pos", F.explode("shapes").alias("s"))
        each = each.select("doc_id", "k", "n_words", F.lit(False).alias("own"), (F.col("pos") - F.col("s.o")).alias("i"), F.col("s.n").alias("n"))
        rows = rows.unionByName(each.where("i >= 0 AND i + n <= n_words"))
    return rows.groupBy("doc_id", "k").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count_if("own").alias("copies"), F.collect_set(F.when(F.col("i").isNotNull(), F.struct("i", "n"))).alias("at")
    )


def _checked(docs: DataFrame, windows: DataFrame, hint) -> DataFrame:
    """``_candidates`` with ``spans`` (the places where a window does stand, as start and stop) and ``items``; k tells texts of one id apart."""
    marks = stored(_candidates(docs, windows, hint), "candidates")
    some = marks.where("size(at) > 0").select("doc_id", "k", "at")
    # Texts of documents with candidates are read again; beyond the bound those that a filter lets through are moved.
    size = some.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("at")), F.lit(0)).alias("places")).first()
    few = size.rows <= BROADCAST_ROWS // 5 and size.places <= 4 * BROADCAST_ROWS
    texts = docs.select("doc_id", "text") if few else maybe_in(docs.select("doc_id", "text").withColumn("__t", F.xxhash64("text")), "__t", some.select("k"))
    texts = texts.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__k"), words(F.col("text")).alias("ws"))
    found = texts.join(F.broadcast(some) if few else some, F.expr("doc_id <=> __id AND k = __k"))
    spans = F.transform("at", lambda s: F.struct(s["i"].alias("i"), s["n"].alias("n"), _span(F.col("ws"), s["i"], s["n"]).alias("window")))
    each = found.select("doc_id", "k", F.explode(spans).alias("s")).select("doc_id", "k", "s.*")
    owners = windows.groupBy("n", "window").agg(F.collect_set("item_id").alias("items"))
    hit = each.join(hint(owners), ["n", "window"])
    hit = hit.groupBy("doc_id", "k").agg(F.collect_set(F.struct("i", (F.col("i") + F.col("n")).alias("stop"))).alias("hits"), F.collect_set("items").alias("items"))
    hit = hit.select(F.col("doc_id").alias("__id"), F.col("k").alias("__k"), "hits", F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))
    merge = """
      aggregate(array_sort(hits), cast(array() as array<struct<start:int,stop:int>>), (acc, s) ->
        if(size(acc) > 0 AND s.i <= element_at(acc, -1).stop,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'stop', greatest(element_at(acc, -1).stop, s.stop)))),
           concat(acc, array(named_struct('start', s.i, 'stop', s.stop)))))"""
    hit = stored(hit.select("__id", "__k", F.expr(merge).alias("spans"), "items"), "hits")
    none = F.array().cast("array<struct<start:int,stop:int>>")
    out = marks.drop("at").join(hit, F.expr("doc_id <=> __id AND k = __k"), "left")
    return out.select("doc_id", "k", "n_words", "copies", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    Words are runs of letters, digits and characters beyond ASCII; A-Z count as a-z. An item's
    windows are its spans of 13 words, or all of a shorter item; an item without words has none.
    A document's word is hit inside any occurrence of a window; it is contaminated if a
    twentieth of its words or more are. ``spans`` are the merged hits as (start, end).
    Null texts have no words. Rows with one id and one text count once in the work and come out
    as often as they went in; rows with one id and different texts are told apart. Extra columns
    are ignored. Null item ids are left out of the digest's list but their windows hit. An empty table of either kind is no error.
    """
    out = _flagged(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, item_col, item_text)
    return out.withColumn("copy", F.explode(F.expr("sequence(1, copies)"))).drop("copy", "copies", "k")


def _flagged(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    windows = stored(_windows(benchmark, item_col, item_text), "windows")
    hint = F.broadcast if windows.count() <= BROADCAST_ROWS else lambda df: df
    out = _checked(docs, windows, hint).withColumn("n_hit", F.expr("aggregate(spans, 0L, (a, s) -> a + s.stop - s.start)"))
    return out.select(
        "doc_id",
        "k",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "spans",
        "copies",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns.

    Rows are known by id and text, so rows that share an id stay or go on their own, and rows that repeat in both go together.
    """
    bad = stored(_flagged(docs.select("doc_id", "text"), benchmark, "item_id", "text").where("contaminated").select("doc_id", "k"), "contaminated")
    return less(whole_rows(docs), [F.col("doc_id"), F.xxhash64("text")], bad).select("row.*")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


OP1_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[i : i + least(len(ws), 13) - 1], ' ') AS w
  FROM (SELECT *, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS i FROM iw WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT n FROM win
), dwin AS (
  SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS w
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, sizes)
), hits AS (SELECT d.doc_id, d.i, d.n, item_id FROM dwin d JOIN win USING (n, w)
), pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1
), items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
             FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)
"""

QUERIES = {"op1_decontamination": op1_decontamination}
SQL = {"op1_decontamination": OP1_SQL}
