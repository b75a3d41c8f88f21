"""Ranked search: word statistics, BM25, cosine ranking, and the fusion of both."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import axis_scale, boilerplate, carries_no_data, digit_ratio, expand, tokens, written
from ..sources.tables import on_workers, stored, table

K1, B, FUSION = 1.5, 0.75, 60
EXACT = 1e14  # parts of a score are summed in units of its inverse
BLOCK, SHARD, ROWS = 4096, 16_384, 256  # query vectors and vectors that meet in one group, and query vectors that are multiplied at once
TOP_K, FLOOR = 5, 0.1  # the floor fits random vectors; trained ones would take 0.55


def document_frequency(docs: DataFrame) -> DataFrame:
    """(word, df, tf) over all documents (text). A word's first place in the order of its document's words counts for df, so only sums by word are shuffled."""
    held = docs.select(F.array_sort(tokens(F.col("text"))).alias("w"))
    each = held.select(F.explode(F.transform("w", lambda x, i: F.struct(x.alias("word"), ((i == 0) | (x != F.get("w", i - 1))).cast("bigint").alias("first")))).alias("e"))
    return each.groupBy("e.word").agg(F.sum("e.first").alias("df"), F.count("*").alias("tf"))


def asked_postings(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, word, tf, len) of the ``asked`` words (word) in documents (doc_id, text, and context where they have one), and a row of the empty word for each document.

    One pass over the texts, written once: all that a ranking needs is read from it.
    """
    whole = F.concat_ws("\n", "context", "text") if "context" in docs.columns else F.col("text")
    words = docs.select(F.col("doc_id").alias("id"), written(whole).alias("w"))
    each = words.select("id", F.size("w").alias("len"), F.explode(F.concat(F.array(F.lit("")), "w")).alias("word")).withColumn("word", F.lower("word"))
    wanted = asked.select("word").unionByName(docs.sparkSession.range(1).select(F.lit("").alias("word"))).distinct()
    return stored(each.join(wanted, "word", "left_semi").groupBy("id", "word").agg(F.count("*").alias("tf"), F.first("len").alias("len")), "postings")


def bm25(docs: DataFrame, queries: DataFrame, pool: int) -> DataFrame:
    """(query_id, id, score, place) of the ``pool`` best documents a query; queries are (query_id, word), distinct. The context of a document counts with its text.

    Words that nobody asks for are dropped before anything is shuffled.
    """
    held = asked_postings(docs, queries)
    corpus = held.where("word = ''").agg(F.count("*").alias("docs"), F.coalesce(F.avg("len"), F.lit(1.0)).alias("avg_len"))
    held = held.where("word <> ''")
    df = stored(held.groupBy("word").agg(F.count("*").alias("df")), "frequencies")  # small, and known to be: postings are not shuffled to meet it
    # A document's postings lie together, so that what all queries make of them is summed without a shuffle.
    scored = held.repartition("id").join(df, "word").join(queries, "word").crossJoin(F.broadcast(corpus))  # one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    # Sums of whole numbers do not depend on the order of rows: equal documents have equal scores. A sum beyond 92,233 is an error.
    total = scored.groupBy("query_id", "id").agg((F.sum((part * EXACT).cast("bigint")) / EXACT).alias("score")).where("score > 0")
    return best(total, "score", pool)


def best(scored: DataFrame, score: str, pool: int) -> DataFrame:
    """The ``pool`` rows of the highest score a query_id, then smallest id, with their place from 0. Tasks cut their own rows before the shuffle."""
    w = W.partitionBy("query_id").orderBy(F.round(score, 9).desc(), "id")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= pool).withColumn("place", F.col("place") - 1)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; a zero norm counts as 1, and vectors of different length are an error."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.sqrt(dot(x, x))
    one = lambda x: F.when(x == 0, 1.0).otherwise(x)
    cos = dot(a, b) / (one(norm(a)) * one(norm(b)))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different length"))).otherwise(cos)


def _ranked_shard(pool: int):
    """For a cogroup of queries and vectors: the ``pool`` best rows a query. A product of matrices picks them, and the plain sum in order scores what it picked."""

    def matrix(rows, name):
        arrays = [None if x is None else np.asarray(x, dtype=object) for x in rows[name]]
        sizes = {len(x) for x in arrays if x is not None}
        if len(sizes) > 1:
            raise ValueError("vectors of different length")
        width = sizes.pop() if sizes else 0
        there = np.array([x is not None and not any(y is None for y in x) for x in arrays], dtype=bool)
        return np.stack([x.astype(float) if ok else np.zeros(width) for x, ok in zip(arrays, there)]), there

    def norms(m):
        total = np.zeros(len(m))
        for i in range(m.shape[1]):
            total += m[:, i] * m[:, i]
        return np.where(total == 0, 1.0, np.sqrt(total))

    def run(queries, vectors):
        none = pd.DataFrame({"query_id": queries["query_id"][:0], "id": vectors["id"][:0], "cos": pd.Series([], dtype=float), "there": pd.Series([], dtype=bool)})
        if queries.empty or vectors.empty:
            return none
        vectors = vectors.sort_values("id", kind="stable")
        (q, q_there), (v, v_there) = matrix(queries, "query"), matrix(vectors, "vector")
        if q_there.any() and v_there.any() and q.shape[1] != v.shape[1]:
            raise ValueError("vectors of different length")
        q_norm, v_norm, found = norms(q), norms(v), []
        for lo in range(0, len(q), ROWS):
            hi = min(lo + ROWS, len(q))
            if q.shape[1] == v.shape[1]:
                near = (q[lo:hi] @ v.T) / q_norm[lo:hi, None] / v_norm
            else:  # all of one side are null
                near = np.zeros((hi - lo, len(v)))
            near[np.isnan(near)] = np.inf  # NaN comes first and null last, as Spark sorts them
            near[~q_there[lo:hi]], near[:, ~v_there] = -np.inf, -np.inf
            least = np.partition(near, -pool, axis=1)[:, -pool] if near.shape[1] > pool else np.full(hi - lo, -np.inf)
            a, b = np.nonzero(near >= least[:, None] - 1e-8)
            a, exact, there = a + lo, np.zeros(len(a)), q_there[a + lo] & v_there[b]
            for i in range(min(q.shape[1], v.shape[1])):
                exact += q[a, i] * v[b, i]
            exact /= q_norm[a] * v_norm[b]
            # Of equal scores only the smallest ids can matter.
            rows = pd.DataFrame({"a": a, "b": b, "cos": exact, "there": there})
            found.append(rows[rows.groupby(["a", "there", "cos"], dropna=False).cumcount() < pool])
        rows = pd.concat(found)
        return pd.DataFrame({"query_id": queries["query_id"].to_numpy()[rows["a"]], "id": vectors["id"].to_numpy()[rows["b"]], "cos": rows["cos"].to_numpy(), "there": rows["there"].to_numpy()})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, pool: int) -> DataFrame:
    """(query_id, id, cos, place) of the ``pool`` nearest vectors (id, vector) of each query (query_id, query): a stated query set against all rows.

    Blocks of about BLOCK queries meet shards of about SHARD vectors, each pair of them in one group; groups give their best rows only.
    """
    on_workers(vectors.sparkSession)
    blocks, shards = (max(1, -(-rows.count() // size)) for rows, size in ((queries, BLOCK), (vectors, SHARD)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    asked = queries.select("query_id", "query", part("query_id", blocks).alias("block"), every(shards).alias("shard"))
    held = vectors.select("id", "vector", part("id", shards).alias("shard"), every(blocks).alias("block"))
    kinds = dict(queries.dtypes) | dict(vectors.dtypes)
    schema = f"query_id {kinds['query_id']}, id {kinds['id']}, cos double, there boolean"
    found = asked.groupBy("block", "shard").cogroup(held.groupBy("block", "shard")).applyInPandas(_ranked_shard(pool), schema)
    return best(found.select("query_id", "id", F.when(F.col("there"), F.col("cos")).alias("cos")), "cos", pool)


def rerank(text: Column, score: Column) -> Column:
    """A score with a bonus for texts rich in digits, a malus for chart axes and a smaller one for boilerplate."""
    bonus = 0.06 * F.least(F.greatest((digit_ratio(text) - 0.02) / 0.18, F.lit(0.0)), F.lit(1.0))
    return score + bonus - F.when(axis_scale(text), 0.10).otherwise(0.0) - F.when(boilerplate(text), 0.04).otherwise(0.0)


def search(docs: DataFrame, vectors: DataFrame, queries: DataFrame, words: DataFrame, top_k: int = TOP_K, floor: float = FLOOR) -> DataFrame:
    """(query_id, place, doc_id, score) of the best ``top_k`` documents, by fusion of both branches.

    Both take 4 * top_k. The vector branch drops cosines below the floor, then orders by the adjusted score; in the
    keyword branch texts that carry no data keep their place but give nothing. Places add 1 / (60 + place + 1);
    the floor holds for all that is fused, and the score given is the plain cosine.
    """
    pool = 4 * top_k
    near, found = stored(nearest(vectors, queries, pool).where(F.col("cos") >= floor), "near"), stored(bm25(docs, words, pool), "found")
    # Texts meet the few pooled rows first and are judged after: written, as a filter on them would go below the join, to all documents.
    texts = stored(docs.select(F.col("doc_id").alias("id"), "text").join(near.select("id").union(found.select("id")).distinct(), "id"), "texts")
    near = near.join(texts, "id")
    w = W.partitionBy("query_id").orderBy(F.round(rerank(F.col("text"), F.col("cos")), 9).desc(), "id")
    near = near.select("query_id", "id", (F.row_number().over(w) - 1).alias("vp"))
    found = texts.join(found, "id").where(~carries_no_data(F.coalesce("text", F.lit(""))))
    found = found.select("query_id", "id", F.col("place").alias("kp"))
    fused = near.join(found, ["query_id", "id"], "full_outer")
    score = F.coalesce(1 / (FUSION + F.col("vp") + 1), F.lit(0.0)) + F.coalesce(1 / (FUSION + F.col("kp") + 1), F.lit(0.0))
    fused = fused.withColumn("fused", score).join(vectors, "id").join(queries, "query_id")
    fused = fused.withColumn("score", cosine(F.col("vector"), F.col("query"))).where(F.col("score") >= floor)
    w = W.partitionBy("query_id").orderBy(F.round("fused", 12).desc(), "id")
    out = fused.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top_k)
    return out.select("query_id", "place", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), F.round("fused", 9).alias("fused"))


def _inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents with their source and language as context, vectors (vec_id stands for doc_id), query vectors, and query words: all benchmark items are the queries."""
    docs = table(spark, d, "documents").withColumn("context", F.concat_ws(" ", "source", "lang"))
    emb, asked = table(spark, d, "embeddings"), table(spark, d, "benchmark")
    vectors = emb.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = asked.join(emb, asked.item_id == emb.vec_id).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("query"))
    words = asked.select(F.col("item_id").alias("query_id"), F.explode(expand(F.col("text"))).alias("word"))
    return docs, vectors, queries, words


def q_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return search(*_inputs(spark, d))


def q_bm25(spark: SparkSession, d: str) -> DataFrame:
    docs, _, _, words = _inputs(spark, d)
    return bm25(docs, words, 4 * TOP_K).select("query_id", "place", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def q_nearest(spark: SparkSession, d: str) -> DataFrame:
    emb = table(spark, d, "embeddings")
    asked = emb.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return nearest(emb.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), asked, 4 * TOP_K).select("query_id", "place", F.col("id").alias("vec_id"), F.round("cos", 6).alias("cos"))


def q_frequency(spark: SparkSession, d: str) -> DataFrame:
    return document_frequency(table(spark, d, "documents"))


def fetch_scored(wanted: DataFrame, vectors: DataFrame, docs: DataFrame, queries: DataFrame, floor: float = FLOOR) -> DataFrame:
    """(query_id, place, id, score) of fragments that other conversations ask for (query_id, id), by the same measure and floor as a search.

    Ids that are no longer there, and texts that carry no data, give nothing; ``stale`` counts the former. Order: score, then text.
    """
    held = wanted.distinct().join(vectors, "id").join(docs.select(F.col("doc_id").alias("id"), "text"), "id").join(queries, "query_id")
    held = held.withColumn("score", cosine(F.col("vector"), F.col("query"))).where((F.col("score") >= floor) & ~carries_no_data(F.coalesce("text", F.lit(""))))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "text", "id"))
    return held.select("query_id", place.alias("place"), "id", F.round("score", 6).alias("score"))


def stale(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, asked, stale): ids asked for and those that no document has any more."""
    held = wanted.distinct().join(docs.select(F.col("doc_id").alias("id"), F.lit(1).alias("__here")).distinct(), "id", "left")
    return held.groupBy("query_id").agg(F.count("*").alias("asked"), F.count_if(F.col("__here").isNull()).alias("stale"))


def merge_borrowed(rows: DataFrame) -> DataFrame:
    """``rows`` (hits, borrowed: arrays of (id, score) in order) with ``merged``: borrowed hits enter where they beat a score, and only if they
    beat the weakest, which then leaves; the order of the others stays, and so does the length (5 for no hits)."""
    limit = F.when(F.size("hits") > 0, F.size("hits")).otherwise(TOP_K)

    def enter(held: Column, x: Column) -> Column:
        weak = F.array_min(F.transform(held, lambda h: h["score"]))
        at = F.array_position(F.transform(held, lambda h: h["score"]), weak).cast("int")
        kept = F.when(F.size(held) >= limit, F.filter(held, lambda h, i: i != at - 1)).otherwise(held)
        before = F.coalesce(F.try_element_at(F.filter(F.transform(kept, lambda h, i: F.when(x["score"] > h["score"], i)), lambda i: i.isNotNull()), F.lit(1)), F.size(kept))
        put = F.concat(F.filter(kept, lambda h, i: i < before), F.array(x), F.filter(kept, lambda h, i: i >= before))
        known = F.exists(held, lambda h: h["id"] == x["id"])
        return F.when(known | ((F.size(held) >= limit) & (x["score"] <= weak)), held).otherwise(put)

    return rows.withColumn("merged", F.aggregate("borrowed", F.col("hits"), enter))


def _wanted(spark: SparkSession, d: str) -> DataFrame:
    """Fragments asked for by each query: fifty by a rule of its number, some of which are gone, and one of them twice."""
    _, _, queries, _ = _inputs(spark, d)
    q, i = F.col("query_id"), F.col("i")
    each = queries.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("i"))
    return each.select("query_id", F.when(i % 7 == 6, q + i + 1_000_000).when(i == 49, q).otherwise((q * 31 + i * 17) % 400).alias("id"))


def q_fetch(spark: SparkSession, d: str) -> DataFrame:
    docs, vectors, queries, _ = _inputs(spark, d)
    return fetch_scored(_wanted(spark, d), vectors, docs, queries)


def q_stale(spark: SparkSession, d: str) -> DataFrame:
    return stale(_wanted(spark, d), table(spark, d, "documents"))


def q_merge(spark: SparkSession, d: str) -> DataFrame:
    """Each user's first five events are its hits, the most valuable of all others is borrowed."""
    e = table(spark, d, "events").withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")))
    one = F.struct(F.col("event_id").alias("id"), F.col("value").alias("score"))
    hits = e.where("n <= 5").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", one.alias("h")))), lambda x: x["h"]).alias("hits"))
    top = e.where("n > 5").groupBy("user_id").agg(F.array(F.max_by(one, F.struct("value", -F.col("event_id")))).alias("borrowed"))
    rows = merge_borrowed(hits.join(top, "user_id"))
    return rows.select("user_id", F.array_join(F.transform("merged", lambda h: h["id"].cast("string")), ",").alias("ids"))


def q_expand(spark: SparkSession, d: str) -> DataFrame:
    """Questions in both languages, a word of each kind by the parts of a line item's number."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").distinct()
    pick = lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (n % len(words) + 1).cast("int"))
    text = F.concat_ws(" ", pick(["Прогноз добычи", "Запасы нефтью", "Цены на газ", "Brent и Brent"], F.col("l_linenumber")), pick(["в США", "сокращение квот", "Oil price 2026", "сыром"], F.col("l_orderkey")), pick(["угля", "МАЗУТА", "электроэнергии"], F.col("l_suppkey")))
    return li.select("l_orderkey", "l_linenumber", "l_suppkey", F.array_join(expand(text), " ").alias("words"))


_T = "list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-zА-Яа-яЁё]{2,}'), lambda x: lower(x))"
_BM25 = f"""
tok AS (SELECT doc_id AS id, {_T} AS w FROM (SELECT doc_id, concat_ws(chr(10), concat_ws(' ', source, lang), text) AS text FROM documents)),
post AS (SELECT id, word, count(*) AS tf, any_value(n) AS len FROM (SELECT id, len(w) AS n, unnest(w) AS word FROM tok) GROUP BY 1, 2),
corpus AS (SELECT count(*) AS docs, avg(len(w)) AS avg_len FROM tok),
asked AS (SELECT DISTINCT item_id AS query_id, unnest({_T}) AS word FROM benchmark),
df AS (SELECT word, count(*) AS df FROM post GROUP BY 1),
bm AS (
  SELECT query_id, id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) AS score
  FROM post JOIN df USING (word) JOIN asked USING (word), corpus GROUP BY 1, 2),
kw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) - 1 AS place FROM bm WHERE score > 0 QUALIFY place < 20)"""
_COS = "list_dot_product(a::DOUBLE[], b::DOUBLE[]) / (sqrt(list_dot_product(a::DOUBLE[], a::DOUBLE[])) * sqrt(list_dot_product(b::DOUBLE[], b::DOUBLE[])))"
_N = "list_transform(regexp_extract_all(coalesce(text, ''), '-?[0-9]+[.]?[0-9]*'), lambda x: CAST(x AS DOUBLE))"
_AXIS = f"""(len(list_filter(range(1, len({_N}) - 3), lambda i: round({_N}[i + 1] - {_N}[i], 6) <> 0
  AND len(list_distinct([round({_N}[i + j + 1] - {_N}[i + j], 6) FOR j IN range(0, 4)])) = 1
  AND NOT (len(list_filter({_N}[i : i + 4], lambda v: v <> floor(v))) = 0 AND (len(list_filter({_N}[i : i + 4], lambda v: v < 1900 OR v > 2100)) = 0 OR abs(round({_N}[i + 1] - {_N}[i], 6)) = 1)))) > 0)"""
_BOILER = "(len(list_filter(['defined in the glossary', '= organization for', 'purchasing power parity', 'apparent consumption', 'oxford economics', 'stand-alone report'], lambda b: contains(lower(coalesce(text, '')), b))) > 0)"
_WANTED = """q AS (SELECT item_id AS query_id FROM benchmark JOIN embeddings ON item_id = vec_id),
  v AS (SELECT DISTINCT query_id, CASE WHEN i % 7 = 6 THEN query_id + i + 1000000 WHEN i = 49 THEN query_id ELSE (query_id * 31 + i * 17) % 400 END AS id FROM q, range(50) r(i))"""
SQL = {
    "no_data": f"SELECT conv_id, turn, role, {_AXIS} AS axis, {_BOILER} AS boilerplate FROM (SELECT conv_id, turn, role, text || CASE turn % 5 WHEN 0 THEN ' 11.5 12.0 12.5 13.0 13.5' WHEN 1 THEN ' 1990 1991 1992 1993 1994 are 1 2 3 4 5' WHEN 2 THEN ' as defined in the GLOSSARY' WHEN 3 THEN ' 5 15 25 35 45.0' ELSE ' 3 5 7 9 12' END AS text FROM conversations)",
    "fetch_scored": f"""
      WITH {_WANTED}, c AS (SELECT query_id, v.id, text, {_COS.replace("a::", "e.embedding::").replace("b::", "q.embedding::")} AS cos FROM v JOIN embeddings e ON e.vec_id = v.id JOIN embeddings q ON q.vec_id = query_id JOIN documents ON doc_id = v.id)
      SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(cos, 9) DESC, text, id) AS place, id, round(cos, 6) AS score FROM c WHERE cos >= 0.1 AND NOT ({_AXIS} OR {_BOILER})""",
    "stale_links": f"WITH {_WANTED} SELECT query_id, count(*) AS asked, count(*) FILTER (WHERE id NOT IN (SELECT doc_id FROM documents)) AS stale FROM v GROUP BY 1",
    "merged_hits": """
      WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), h AS (SELECT user_id, n, event_id, value FROM e WHERE n <= 5),
      b AS (SELECT user_id, event_id AS x, value AS s FROM e WHERE n > 5 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1),
      m AS (SELECT user_id, arg_min(n, (value, n)) AS weak, min(value) AS low, count(*) AS c FROM h GROUP BY 1),
      k AS (SELECT h.user_id, n * 2 AS p, event_id, value FROM h JOIN m USING (user_id) JOIN b USING (user_id) WHERE s <= low OR n <> weak),
      i AS (SELECT b.user_id, coalesce((SELECT min(p) FROM k WHERE k.user_id = b.user_id AND b.s > k.value), 100) - 1 AS p, x AS event_id FROM b JOIN m USING (user_id) WHERE s > low)
      SELECT user_id, string_agg(event_id, ',' ORDER BY p) AS ids FROM (SELECT user_id, p, event_id FROM k UNION ALL SELECT * FROM i) GROUP BY 1""",
    "expanded_words": """
      WITH t AS (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey FROM lineitem)
      SELECT *, CASE l_linenumber % 4 WHEN 0 THEN 'forecast forecasts production' WHEN 1 THEN 'inventories reserves stocks storage oil crude petroleum' WHEN 2 THEN 'price prices spot gas natural' ELSE 'brent' END ||
        CASE l_orderkey % 4 WHEN 0 THEN ' united states' WHEN 1 THEN ' quota cuts curtailment' WHEN 2 THEN CASE l_linenumber % 4 WHEN 1 THEN ' price' WHEN 2 THEN ' oil' ELSE ' oil price' END ELSE CASE l_linenumber % 4 WHEN 1 THEN '' ELSE ' oil crude petroleum' END END ||
        CASE l_suppkey % 3 WHEN 0 THEN ' coal' WHEN 1 THEN ' distillate diesel' ELSE ' electricity generation' END AS words FROM t""",
    "doc_frequency": f"SELECT word, count(*) AS df, sum(tf) AS tf FROM (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest({_T}) AS word FROM documents) GROUP BY 1, 2) GROUP BY 1",
    "bm25_rank": f"WITH {_BM25} SELECT query_id, place, id AS doc_id, round(score, 6) AS score FROM kw",
    "vector_topk": f"""
      WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {_COS.replace("a::", "e.embedding::").replace("b::", "q.embedding::")} AS cos
                 FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)
      SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(cos, 9) DESC, vec_id) - 1 AS place, vec_id, round(cos, 6) AS cos FROM s QUALIFY place < 20""",
    "hybrid_search": f"""
      WITH {_BM25},
      c AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COS.replace("a::", "e.embedding::").replace("b::", "q.embedding::")} AS cos
            FROM embeddings e, embeddings q JOIN benchmark ON item_id = q.vec_id),
      near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cos, 9) DESC, id) - 1 AS p FROM c QUALIFY p < 20),
      adj AS (SELECT query_id, id, cos + 0.06 * least(greatest((CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^0-9]', '', 'g')) / length(text) ELSE 0 END - 0.02) / 0.18, 0), 1)
                - CASE WHEN {_AXIS} THEN 0.1 ELSE 0 END - CASE WHEN {_BOILER} THEN 0.04 ELSE 0 END AS a
              FROM near JOIN documents ON doc_id = id WHERE cos >= 0.1),
      v AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(a, 9) DESC, id) - 1 AS vp FROM adj),
      f AS (SELECT query_id, id, coalesce(1.0 / (61 + vp), 0) + coalesce(1.0 / (61 + place), 0) AS fused
            FROM v FULL JOIN (SELECT query_id, id, place FROM kw JOIN documents ON doc_id = id WHERE NOT ({_AXIS} OR {_BOILER})) k USING (query_id, id)),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 12) DESC, id) AS place FROM f JOIN c USING (query_id, id) WHERE cos >= 0.1)
      SELECT query_id, place, id AS doc_id, round(cos, 6) AS score, round(fused, 9) AS fused FROM r WHERE place <= 5""",
}
def q_no_data(spark: SparkSession, d: str) -> DataFrame:
    """Turns with the ends that chart axes, years, numbering, glossaries and tables have."""
    ends = [" 11.5 12.0 12.5 13.0 13.5", " 1990 1991 1992 1993 1994 are 1 2 3 4 5", " as defined in the GLOSSARY", " 5 15 25 35 45.0", " 3 5 7 9 12"]
    text = F.concat("text", F.element_at(F.array(*[F.lit(e) for e in ends]), (F.col("turn") % 5 + 1).cast("int")))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", axis_scale(text).alias("axis"), boilerplate(text).alias("boilerplate"))


QUERIES = {"no_data": q_no_data, "fetch_scored": q_fetch, "stale_links": q_stale, "merged_hits": q_merge, "expanded_words": q_expand, "hybrid_search": q_hybrid, "bm25_rank": q_bm25, "vector_topk": q_nearest, "doc_frequency": q_frequency}
