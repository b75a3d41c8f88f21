"""Conversations: listing, order, budgets, search and the eviction of old searches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import stem, title
from ..sources.tables import on_workers, shared_folder, stored, table


def turns(rows: DataFrame) -> DataFrame:
    """Turns with their ordinal in the conversation, from 1."""
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.withColumn("ordinal", F.row_number().over(w))


def threads(rows: DataFrame) -> DataFrame:
    """One row a conversation: its title (from the first user turn), number of turns and last turn."""
    first = F.min(F.when(F.col("role") == "user", F.struct("turn", "text")))
    base = rows.groupBy("conv_id").agg(first.alias("f"), F.count("*").alias("n_turns"), F.max("turn").alias("last_turn"))
    return base.select("conv_id", title(F.col("f.text")).alias("title"), "n_turns", "last_turn")


def within_budget(rows: DataFrame, partition: list[str], order: list[Column], size: Column, budget: int) -> DataFrame:
    """The longest run of rows in the given order whose sizes sum to the budget at most; the first always stays, none with a budget of 0 or less."""
    if budget <= 0:
        return rows.where(F.lit(False))
    w = W.partitionBy(*partition).orderBy(*order)
    held = rows.withColumn("__sum", F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("__n", F.row_number().over(w))
    return held.where((F.col("__sum") <= budget) | (F.col("__n") == 1)).drop("__sum", "__n")


#: Weights of ranked search: saturation of a stem's hits in a turn, and how much a turn's length counts.
SATURATION, LENGTH = 1.2, 0.75
#: How many turns a query shows.
PLACES = 50
WORD = r"(?U)\w{3,}"


def stems(question: Column) -> Column:
    """The stems of a question's words of three letters or more, as often as they come."""
    return F.transform(F.regexp_extract_all(F.lower(question), F.lit(WORD), F.lit(0)), stem)


#: Words in a shard of the index, about; a worker holds one shard as arrays. Longer stems are looked up by so many of their first characters.
SHARD, HEAD = 1_000_000, 16


def by_rank() -> list[Column]:
    """The order of what a query finds: the best first, of equal ones the latest."""
    return [F.round("score", 9).desc(), F.col("turn").desc(), F.col("conv_id")]


def stems_within(words: list[str], stems: list[str]) -> np.ndarray:
    """Rows (word, stem, hits): how often each stem, known by its number, stands within each word; in the order of words."""
    heads: dict[str, list[int]] = {}
    for i, s in enumerate(stems):
        heads.setdefault(s[:HEAD], []).append(i)
    sizes, rows = sorted({len(h) for h in heads}), []
    for i, word in enumerate(words):
        hits: dict[int, int] = {}
        for size in sizes:
            for at in range(len(word) - size + 1):
                for s in heads.get(word[at : at + size], ()):
                    if size < HEAD or word.startswith(stems[s], at):
                        hits[s] = hits.get(s, 0) + 1
        rows += [(i, s, n) for s, n in hits.items()]
    return np.array(rows, np.int64).reshape(-1, 3)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with the sum of its numbers."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(n, first)


def _numbered(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The place of each value among all, nulls first, and the values in that order."""
    held = column.combine_chunks().dictionary_encode("encode")
    order = pc.array_sort_indices(held.dictionary, null_placement="at_start")
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return place[held.indices.to_numpy()], held.dictionary.take(order)


class Shard:
    """Turns of an index as arrays, from its rows (conv_id, turn, words, sign, n, rows): of each stem the turns that hold it, and how often."""

    def __init__(self, rows: pa.Table, stems: list[str]) -> None:
        (conv, self.convs), (turn, self.turns) = (_numbered(rows[c]) for c in ("conv_id", "turn"))
        self.keys, at = np.unique(conv * len(self.turns) + turn, return_inverse=True)
        size = len(self.keys)
        self.held = np.bincount(at, rows["rows"].to_numpy(), size) > 0
        self.length = np.bincount(at, rows["n"].to_numpy(), size)
        lists = rows["words"].combine_chunks()
        words, many = lists.flatten().dictionary_encode(), lists.value_lengths().to_numpy()
        pairs, n = _summed(words.indices.to_numpy().astype(np.int64) * size + np.repeat(at, many), np.repeat(rows["sign"].to_numpy().astype(np.int64), many))
        pairs, n = pairs[n > 0], n[n > 0]
        meets = stems_within(words.dictionary.to_pylist(), stems)
        # Every posting meets the stems within its word: from begin[word] on, so many as its word has.
        begin = np.searchsorted(meets[:, 0], np.arange(len(words.dictionary) + 1))
        word = pairs // max(size, 1)
        many = np.diff(begin)[word]
        posting = np.repeat(np.arange(len(pairs)), many)
        meet = np.repeat(begin[word] - (np.cumsum(many) - many), many) + np.arange(len(posting))
        pairs, self.tf = _summed(meets[meet, 1] * size + pairs[posting] % max(size, 1), n[posting] * meets[meet, 2])
        self.stem, self.at = pairs // max(size, 1), pairs % max(size, 1)
        self.begin = np.searchsorted(self.stem, np.arange(len(stems) + 1))


def stems_of_shard(key: tuple, rows: pa.Table, asked: pa.Table) -> pa.Table:
    """(shard, stem, df): how many turns of a shard hold each of the stems asked for (stem); none for stems that no turn holds."""
    shard = Shard(rows, asked["stem"].to_pylist())
    df = pa.array(np.diff(shard.begin), pa.int64())
    return pa.table({"shard": pa.array([key[0].as_py()] * len(df), pa.int32()), "stem": asked["stem"], "df": df}).filter(pa.array(np.diff(shard.begin) > 0))


def first_places(score: np.ndarray, turn: np.ndarray, conv: np.ndarray, limit: int | None) -> np.ndarray:
    """Places that hold the ``limit`` first by ``by_rank``, and some more where the ninth digit decides; all without a limit."""
    if limit is None or len(score) <= limit:
        return np.arange(len(score))
    near = np.flatnonzero(score >= np.partition(score, -limit)[-limit] - 2e-9)
    near = near[np.lexsort((conv[near], -turn[near], -score[near]))]
    equal = np.r_[True, score[near][1:] != score[near][:-1]]
    place = np.arange(len(near)) - np.flatnonzero(equal)[np.cumsum(equal) - 1]  # among those of one score
    return near[place < limit]


def _found(shard: Shard, stems: list[int], w: list[int], value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The turns of a shard that hold all of these stems, and their scores."""
    part = [(shard.at[a:b], value[a:b]) for a, b in ((shard.begin[s], shard.begin[s + 1]) for s in stems)]
    turns = min((at for at, _ in part), key=len)
    for at, _ in sorted(part, key=lambda p: len(p[0]))[1:]:
        if not len(turns):
            break
        turns = turns[at[np.minimum(np.searchsorted(at, turns), len(at) - 1)] == turns]
    turns = turns[shard.held[turns]]
    score = np.zeros(len(turns))
    for n, (at, of) in zip(w, part):
        score += n * of[np.searchsorted(at, turns)]
    return turns, score


def found_in_shard(rows: pa.Table, asked: pa.Table, mean: float, limit: int | None) -> pa.Table:
    """(bag, found): for each bag asked for (bag, stems, w, idf) the turns of a shard (conv_id, turn, score) that hold all its stems; with a limit those of ``first_places``."""
    flat = {c: asked[c].combine_chunks() for c in ("stems", "w", "idf")}
    named = flat["stems"].flatten().dictionary_encode()
    stems, number, w = named.dictionary.to_pylist(), named.indices.to_numpy(), flat["w"].flatten().to_pylist()
    ends = np.cumsum(flat["stems"].value_lengths().to_numpy()).tolist()
    shard, idf = Shard(rows, stems), np.zeros(len(stems))
    idf[number] = flat["idf"].flatten().to_numpy()
    value = idf[shard.stem] * shard.tf * (SATURATION + 1) / (shard.tf + SATURATION * (1 - LENGTH + LENGTH * shard.length[shard.at] / mean))
    conv, turn = shard.keys // max(len(shard.turns), 1), shard.keys % max(len(shard.turns), 1)
    bags, sizes, at, scores = [], [0], [np.zeros(0, np.int64)], [np.zeros(0)]
    for bag, a, b in zip(asked["bag"].to_pylist(), [0, *ends], ends):
        turns, score = _found(shard, number[a:b].tolist(), w[a:b], value)
        if len(turns):
            place = first_places(score, turn[turns], conv[turns], limit)
            bags.append(bag)
            sizes.append(len(place))
            at.append(turns[place])
            scores.append(score[place])
    every = np.concatenate(at)
    found = pa.StructArray.from_arrays([shard.convs.take(pa.array(conv[every])), shard.turns.take(pa.array(turn[every])), pa.array(np.concatenate(scores))], ["conv_id", "turn", "score"])
    return pa.table({"bag": pa.array(bags, pa.string()), "found": pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), found)})


class TurnIndex:
    """A stored index of conversations' turns, kept in step by deltas.

    Each ``add`` or ``remove`` appends a row (conv_id, turn, words, sign, n, rows) for a turn: its words in order, and its length and a one with the sign; their sums are
    what the index holds. ``check`` compares it with the turns by counts, and rebuilds it when they differ. A search deals turns into shards,
    where words are turned into postings, so that what questions and turns have in common is made, held and ranked within a shard and is never written or shuffled.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _append(self, turns_: DataFrame, sign: int) -> None:
        rows = turns_.select("conv_id", "turn", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
        size, sign_ = F.greatest(F.length("t") - 2, F.lit(0)), F.lit(sign).cast("long")
        words = F.sort_array(F.regexp_extract_all("t", F.lit(WORD), F.lit(0)))
        rows.select("conv_id", "turn", words.alias("words"), sign_.alias("sign"), (size * sign_).alias("n"), sign_.alias("rows")).write.mode("append").parquet(self.path)

    def add(self, turns_: DataFrame) -> TurnIndex:
        self._append(turns_, 1)
        return self

    def remove(self, turns_: DataFrame) -> TurnIndex:
        """Takes out turns as they were added, so what is deleted is not found any more."""
        self._append(turns_, -1)
        return self

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def lengths(self) -> DataFrame:
        return self._rows().groupBy("conv_id", "turn").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows")).where("rows > 0")

    def postings(self) -> DataFrame:
        words = self._rows().select("conv_id", "turn", F.explode("words").alias("word"), "sign")
        return words.groupBy("conv_id", "turn", "word").agg(F.sum("sign").alias("n")).where("n > 0")

    def compact(self) -> TurnIndex:
        """The same index with all deltas summed up, in a new folder."""
        new, none = shared_folder(self.spark, "turn-index"), F.lit(0).cast("long")
        words = F.sort_array(F.flatten(F.collect_list(F.array_repeat("word", F.col("n").cast("int")))))
        turns_ = self.postings().groupBy("conv_id", "turn").agg(words.alias("words")).withColumns({"sign": F.lit(1).cast("long"), "n": none, "rows": none})
        turns_.unionByName(self.lengths().withColumns({"words": F.array().cast("array<string>"), "sign": F.lit(1).cast("long")})).write.parquet(new)
        return TurnIndex(self.spark, new)

    def check(self, turns_: DataFrame) -> TurnIndex:
        """This index, or a new one of all turns if the numbers of turns differ: an index that lacks some finds nothing there, without an error."""
        held = self.lengths().agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        return self if held == turns_.count() else TurnIndex(self.spark, shared_folder(self.spark, "turn-index")).add(turns_)

    def _shards(self) -> tuple[DataFrame, int]:
        """The index's rows in shards of about a million words, dealt by turn; and the number of shards."""
        words = self._rows().agg(F.sum(F.size("words"))).first()[0] or 0
        count = max(2 * self.spark.sparkContext.defaultParallelism, -(-words // SHARD))
        return self._rows().withColumn("shard", F.pmod(F.xxhash64("conv_id", "turn"), F.lit(count)).cast("int")), count

    def search(self, queries: DataFrame, limit: int | None = None) -> DataFrame:
        """(query_id, conv_id, turn, score) where every stem of a query (query_id, question) occurs within a word of the turn; with a limit the first so many by ``by_rank``.

        The score is BM25 of the stems, each as often as the question has it, over the trigrams of a turn. Shards of turns first count the
        stems; then a question goes to the shards that hold its rarest stem, meets the turns there from its rarest stem on, and brings back no more than the limit.
        """
        on_workers(self.spark)
        one = queries.select("query_id", F.explode(stems(F.col("question"))).alias("stem")).groupBy("query_id", "stem").agg(F.count("*").alias("w"))
        bags = one.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("stem", "w"))).alias("stems"))
        bags = stored(bags.withColumn("bag", F.sha2(F.to_json("stems"), 256)), "bags")  # questions of the same stems are one
        asked = bags.dropDuplicates(["bag"]).select("bag", F.size("stems").alias("size"), F.inline("stems"))
        rows, count = self._shards()
        every = asked.select("stem").distinct().select("stem", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("shard"))
        counts = rows.groupBy("shard").cogroup(every.groupBy("shard")).applyInArrow(stems_of_shard, "shard int, stem string, df long")
        counts = stored(counts, "counts")
        docs, mean = self.lengths().agg(F.sum("rows"), F.sum("n") / F.sum("rows")).first()
        idf = F.log((F.lit(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        often = counts.groupBy("stem").agg(F.sum("df").alias("df")).select("stem", "df", F.when(idf > 0, idf).otherwise(F.lit(1e-6)).alias("idf"))
        # Of the stems of a bag the rarest comes first; a bag with a stem that no turn has finds nothing.
        w = W.partitionBy("bag")
        ranked = asked.join(often, "stem").withColumns({"known": F.count("*").over(w), "place": F.row_number().over(w.orderBy("df", "stem"))})
        ranked = stored(ranked.where("known = size").select("bag", "stem", "w", "idf", "place"), "ranked")
        whole = ranked.groupBy("bag").agg(F.sort_array(F.collect_list(F.struct("place", "stem", "w", "idf"))).alias("s"))
        there = ranked.where("place = 1").select("bag", "stem").join(counts.select("stem", "shard"), "stem").select("bag", "shard")
        there = there.join(whole, "bag").select("shard", "bag", F.col("s.stem").alias("stems"), "s.w", "s.idf")
        kind = ", ".join(f"{c}: {rows.schema[c].dataType.simpleString()}" for c in ("conv_id", "turn"))
        mean = float(mean or 1)

        def found(here: pa.Table, asked: pa.Table) -> pa.Table:
            return found_in_shard(here, asked, mean, limit)

        out = rows.groupBy("shard").cogroup(there.groupBy("shard")).applyInArrow(found, f"bag string, found array<struct<{kind}, score: double>>")
        out = out.repartition("bag").select("bag", F.inline("found"))
        if limit is not None:
            out = out.withColumn("place", F.row_number().over(W.partitionBy("bag").orderBy(*by_rank()))).where(F.col("place") <= limit)
        return out.join(bags.select("bag", "query_id"), "bag").select("query_id", "conv_id", "turn", "score")


def found_turns(matches: DataFrame, heads: DataFrame, limit: int = PLACES) -> DataFrame:
    """Matches with the title of their conversation (conv_id, title; its id for one that has none) and their place: the best first, of equal ones the latest, ``limit`` a query at most."""
    place = F.row_number().over(W.partitionBy("query_id").orderBy(*by_rank()))
    rows = matches.withColumn("place", place).where(F.col("place") <= limit)
    return rows.join(heads.select("conv_id", "title"), "conv_id", "left").withColumn("title", F.coalesce("title", F.col("conv_id").cast("string")))


def latest_searches(rows: DataFrame, keep: int = 200) -> DataFrame:
    """(query, hits, last_run) of the latest run of each query, the ``keep`` most recent of them."""
    last = rows.groupBy("query").agg(F.max_by("hits", F.struct("last_run", "hits")).alias("hits"), F.max("last_run").alias("last_run"))
    return last.orderBy(F.col("last_run").desc(), "query").limit(keep)


def q_turns(spark: SparkSession, d: str) -> DataFrame:
    return turns(table(spark, d, "conversations")).select("conv_id", "turn", "role", "ordinal")


def q_threads(spark: SparkSession, d: str) -> DataFrame:
    return threads(table(spark, d, "conversations")).select("conv_id", "n_turns", "last_turn")


def q_history(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").withColumn("size", F.least(F.length("text"), F.lit(1000)))
    return within_budget(rows, ["conv_id"], [F.col("turn").desc(), F.col("role"), F.col("text")], F.col("size"), 2500).select("conv_id", "turn", "role", "size")


def q_context(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").withColumn("size", F.length("text"))
    return within_budget(rows, ["conv_id"], [F.col("turn"), F.col("role"), F.col("text")], F.col("size"), 1500).select("conv_id", "turn", "role", "size")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """Whole benchmark items, each line of the turns of conversations whose number is divisible by 50, and each word of their user's turns."""
    conv = table(spark, d, "conversations")
    items = table(spark, d, "benchmark").select(F.format_string("item %d", "item_id").alias("query_id"), F.col("text").alias("question"))
    some = conv.where("conv_id % 50 = 0")
    lines = some.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("i", "question")).select(F.format_string("line %d %d %d", "conv_id", "turn", "i").alias("query_id"), "question")
    words = some.where("role = 'user'").select(F.explode(F.split(F.lower("text"), " ")).alias("question")).distinct().select(F.concat(F.lit("word "), "question").alias("query_id"), "question")
    return items.unionByName(lines).unionByName(words)


def q_match(spark: SparkSession, d: str) -> DataFrame:
    """An index that took all turns in two batches and lost those of some conversations; every fifth conversation has no title left."""
    conv = table(spark, d, "conversations")
    index = TurnIndex(spark, shared_folder(spark, "turn-index")).add(conv.where("conv_id % 2 = 0")).add(conv.where("conv_id % 2 = 1")).remove(conv.where("conv_id % 7 = 3"))
    rows = found_turns(index.search(_questions(spark, d), PLACES), threads(conv).where("conv_id % 5 <> 0"))
    return rows.withColumn("score", F.round("score", 6))


def q_searches(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("query"), F.col("event_id").alias("last_run"), F.floor("value").cast("bigint").alias("hits"))
    return latest_searches(e)


_STEM = "substr(w, 1, length(w) - CASE WHEN length(w) >= 8 THEN 3 WHEN length(w) >= 6 THEN 2 WHEN length(w) >= 4 THEN 1 ELSE 0 END)"
SQL = {
    "turn_ordinal": "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS ordinal FROM conversations",
    "list_threads": "SELECT conv_id, count(*) AS n_turns, max(turn) AS last_turn FROM conversations GROUP BY 1",
    "history_budget": """SELECT conv_id, turn, role, least(length(text), 1000) AS size FROM conversations
      QUALIFY sum(least(length(text), 1000)) OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text ROWS UNBOUNDED PRECEDING) <= 2500 OR row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) = 1""",
    "context_budget": """SELECT conv_id, turn, role, length(text) AS size FROM conversations
      QUALIFY sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) <= 1500 OR row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) = 1""",
    "search_turns": f"""
      WITH q AS (SELECT 'item ' || item_id AS query_id, text AS question FROM benchmark UNION ALL
        SELECT 'line ' || conv_id || ' ' || turn || ' ' || i, l FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM conversations WHERE conv_id % 50 = 0) UNION ALL
        SELECT DISTINCT 'word ' || w, w FROM (SELECT unnest(string_split(lower(text), ' ')) AS w FROM conversations WHERE conv_id % 50 = 0 AND role = 'user')),
      s AS (SELECT query_id, {_STEM} AS s, count(*) AS w FROM (SELECT query_id, unnest(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}\\p{{M}}_]{{3,}}')) AS w FROM q) GROUP BY ALL),
      c AS (SELECT conv_id, turn, lower(text) AS t, greatest(length(text) - 2, 0) AS len, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}_]{{3,}}') AS ws FROM conversations WHERE conv_id % 7 <> 3), z AS (SELECT count(*) AS docs, avg(len) AS mean FROM c),
      k AS MATERIALIZED (SELECT s, conv_id, turn, len, list_filter(ws, lambda x: contains(x, s)) AS ws FROM (SELECT DISTINCT s FROM s) JOIN c ON contains(t, s)),
      v AS (SELECT s, conv_id, turn, len, list_sum(list_transform(ws, lambda x: len(list_filter(range(1, length(x) - length(s) + 2), lambda i: x[i : i + length(s) - 1] = s)))) AS tf, count(*) OVER (PARTITION BY s) AS df FROM k),
      e AS (SELECT query_id, conv_id, turn, w, count(*) OVER (PARTITION BY query_id, conv_id, turn) AS have, tf, df, len FROM s JOIN v USING (s)), n AS (SELECT query_id, count(*) AS n FROM s GROUP BY 1),
      m AS (SELECT query_id, conv_id, turn, sum(w * CASE WHEN ln((docs - df + 0.5) / (df + 0.5)) > 0 THEN ln((docs - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM e JOIN n USING (query_id), z WHERE have = n GROUP BY ALL),
      p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, turn DESC, conv_id) AS place FROM m QUALIFY place <= 50),
      h AS (SELECT conv_id, arg_min(text, (turn, text)) FILTER (WHERE role = 'user') AS q FROM conversations WHERE conv_id % 5 <> 0 GROUP BY 1),
      f AS (SELECT conv_id, trim(regexp_replace(coalesce(q, ''), '\\s+', ' ', 'g'), ' ') AS f FROM h), g AS (SELECT *, substr(f, 1, 60) AS g, 60 - instr(reverse(substr(f, 1, 60)), ' ') AS z FROM f)
      SELECT query_id, p.conv_id, turn, place, round(score, 6) AS score, CASE WHEN g.conv_id IS NULL THEN CAST(p.conv_id AS VARCHAR) WHEN f = '' THEN 'Untitled' WHEN length(f) <= 60 THEN f
        ELSE regexp_replace(CASE WHEN contains(g.g, ' ') AND z >= 30 THEN substr(g.g, 1, CAST(z AS BIGINT)) ELSE g.g END, '[ ,.;:!?-]+$', '') || '…' END AS title FROM p LEFT JOIN g USING (conv_id)""",
    "search_history_evict": """
      SELECT event_type || ':' || user_id AS query, CAST(floor(arg_max(value, event_id)) AS BIGINT) AS hits, max(event_id) AS last_run FROM events GROUP BY 1 ORDER BY last_run DESC, query LIMIT 200""",
}
QUERIES = {"turn_ordinal": q_turns, "list_threads": q_threads, "history_budget": q_history, "context_budget": q_context, "search_turns": q_match, "search_history_evict": q_searches}
