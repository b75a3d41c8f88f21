"""Conversations as tables: recording and renaming, whole deletion, histories in a prompt's form, and notes on sources that were silent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import title
from ..sources.tables import table
from .evidence import without
from .registry import within_budget

TITLE, ANSWER = 60, 1000  # characters
CUT = "\n[…фрагмент обрезан по бюджету контекста]"  # fixed value: what stands where a text was cut


def clip(text: Column, cap: int, mark: str = CUT) -> Column:
    """A text of at most ``cap`` characters, and a mark where it was cut; no cap for 0 or less."""
    return F.when(F.length(text) > cap, F.concat(F.substring(text, 1, cap), F.lit(mark))).otherwise(text) if cap > 0 else text


def record(threads: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Threads, the new turns with their ordinals, and the trail of fragments shown in them.

    Threads are (thread_id, title, renamed, created_at, updated_at, turns), new turns (thread_id, seq, question, answer, asked_at, chunks).
    A thread's title comes from its first question and stays; ordinals go on where the thread ends; of fragments of a turn each counts once, in order, and empty ones not.
    """
    w = W.partitionBy("thread_id").orderBy("seq")
    before = threads.select("thread_id", F.col("turns").alias("__n"))
    turns = new.join(before, "thread_id", "left").withColumn("ordinal", F.coalesce("__n", F.lit(0)) + F.row_number().over(w)).drop("__n")
    made = turns.groupBy("thread_id").agg(F.min_by("question", "seq").alias("question"), F.min("asked_at").alias("first_at"), F.max("asked_at").alias("last_at"), F.max("ordinal").alias("last"))
    both = threads.join(made, "thread_id", "full_outer")
    known = F.col("turns").isNotNull()
    after = both.select(
        "thread_id", F.when(known, F.col("title")).otherwise(title(F.col("question"))).alias("title"), F.coalesce("renamed", F.lit(False)).alias("renamed"), F.coalesce("created_at", "first_at").alias("created_at"),
        F.coalesce("last_at", "updated_at").alias("updated_at"), F.coalesce("last", "turns").alias("turns"),
    )
    shown = F.array_distinct(F.filter(F.coalesce("chunks", F.array().cast("array<string>")), lambda c: c.isNotNull() & (c != "")))
    trail = turns.select("thread_id", "ordinal", F.posexplode(shown).alias("position", "chunk"))
    return after, turns.select("thread_id", "ordinal", "asked_at", "question", "answer"), trail


def rename(threads: DataFrame, names: DataFrame) -> DataFrame:
    """Threads with new titles (thread_id, name): white space runs to one, 60 characters at most; blank names and unknown threads change nothing."""
    clean = F.trim(F.regexp_replace("name", r"\s+", " "))
    some = names.select("thread_id", F.substring(clean, 1, TITLE).alias("__new")).where("__new <> ''")
    held = threads.join(some, "thread_id", "left")
    return held.withColumns({"title": F.coalesce("__new", "title"), "renamed": F.col("renamed") | F.col("__new").isNotNull()}).drop("__new")


def delete(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables of conversations (each with thread_id, links also with linked) less the rows of those that are gone."""
    out = {name: without(t, gone, ["thread_id"]) for name, t in tables.items()}
    if "links" in out:
        out["links"] = without(out["links"], gone.select(F.col("thread_id").alias("linked")), ["linked"])
    return out


def history(turns: DataFrame, cap: int = ANSWER, budget: int = 2500) -> DataFrame:
    """(thread_id, history): the latest turns that fit the budget, in order, each answer cut at the cap."""
    block = F.concat(F.lit("Вопрос: "), F.trim(F.coalesce("question", F.lit(""))), F.lit("\nОтвет: "), clip(F.trim(F.coalesce("answer", F.lit(""))), cap))
    held = within_budget(turns.withColumn("block", block), ["thread_id"], [F.col("ordinal").desc()], F.length("block"), budget)
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "block"))), lambda x: x["block"])
    return held.groupBy("thread_id").agg(F.array_join(blocks, "\n\n").alias("history"))


def fed_context(rows: DataFrame, key: list[str], order: list[Column], budget: int) -> DataFrame:
    """The blocks (key, block) that a model is given: in order, as many as fit the budget; a first one that does not is cut, with a mark."""
    return within_budget(rows, key, order, F.length("block"), budget).withColumn("block", clip(F.col("block"), budget))


def recent(threads: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` threads whose last turn is the latest, then smallest id, in that order."""
    return threads.orderBy(F.col("updated_at").desc(), "thread_id").limit(limit)


def utc(at: Column) -> Column:
    """An instant in ISO form, in UTC and whole seconds."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss+00:00")


def months_back(day: Column, count: int) -> Column:
    """The months before a day as yyyy-MM, the latest first."""
    return F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: F.date_format(F.add_months(F.trunc(day, "month"), -i), "yyyy-MM"))


def source_note(reports: Column, web: Column) -> Column:
    """What to say of sources that were silent: one note for both, one for either, none if all answered. A status is ok, empty, unavailable or failed, with a reason after a colon."""
    reason = lambda s: F.coalesce(F.nullif(F.trim(F.regexp_extract(s, "^[^:]*:(.*)$", 1)), F.lit("")), F.lit("no reason given"))
    no_reports = F.startswith(reports, F.lit("failed")) | F.startswith(reports, F.lit("empty"))
    no_web = F.startswith(web, F.lit("failed")) | F.startswith(web, F.lit("unavailable"))
    why = F.when(F.startswith(reports, F.lit("empty")), "no index is built").otherwise(reason(reports))
    return (
        F.when(no_reports & no_web, F.concat(F.lit("no source answered: reports ("), why, F.lit("), web ("), reason(web), F.lit(")")))
        .when(no_reports, F.concat(F.lit("reports were not searched ("), why, F.lit(")")))
        .when(no_web, F.concat(F.lit("the web was not searched ("), reason(web), F.lit(")")))
        .otherwise("")
    )


# ---- Turns of the given conversations: a user's text and the assistant's after it -------------


def _turns(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    one = rows.groupBy("conv_id", "turn").agg(F.min(F.when(F.col("role") == "user", F.col("text"))).alias("question"), F.min(F.when(F.col("role") == "assistant", F.col("text"))).alias("answer"))
    asked = one.where("question IS NOT NULL").select("conv_id", "turn", "question")
    said = one.where("answer IS NOT NULL").select("conv_id", (F.col("turn") - 1).alias("turn"), "answer")
    rows = asked.join(said, ["conv_id", "turn"])
    chunks = F.transform(F.split("answer", "\n"), lambda x: F.when(x != "", F.md5(x.cast("binary"))).otherwise(""))
    return rows.select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("seq"), "question", "answer", F.col("turn").alias("asked_at"), chunks.alias("chunks"))


def _recorded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Threads hold what was said before turn 3; the rest is recorded."""
    rows = _turns(spark, d)
    old = rows.where("seq < 3").groupBy("thread_id").agg(F.lit("old").alias("title"), F.lit(False).alias("renamed"), F.min("asked_at").alias("created_at"), F.max("asked_at").alias("updated_at"), F.count("*").alias("turns"))
    return record(old, rows.where("seq >= 3"))


def q_times(spark: SparkSession, d: str) -> DataFrame:
    """Events' instants in ISO form, and the three months before each."""
    e = table(spark, d, "events")
    return e.select("event_id", utc(F.col("ts").cast("timestamp")).alias("at"), F.array_join(months_back(F.to_date("ts"), 3), " ").alias("months"))


def q_recorded(spark: SparkSession, d: str) -> DataFrame:
    """Threads by what happened last, with those of an even number named anew."""
    threads, _, _ = _recorded(spark, d)
    names = threads.where("thread_id % 2 = 0").select("thread_id", F.when(F.col("thread_id") % 4 == 0, F.concat(F.lit(" Talk \n number  "), F.col("thread_id").cast("string"))).otherwise(" \t ").alias("name"))
    return rename(threads, names).withColumn("title", F.md5(F.col("title").cast("binary"))).select("thread_id", "title", "renamed", "created_at", "updated_at", "turns")


def q_trail(spark: SparkSession, d: str) -> DataFrame:
    return _recorded(spark, d)[2]


def q_deleted(spark: SparkSession, d: str) -> DataFrame:
    """Rows left in each table once threads of a number divisible by three are gone."""
    threads, turns, trail = _recorded(spark, d)
    links = threads.select("thread_id", (F.col("thread_id") + 1).alias("linked"))
    left = delete({"threads": threads, "turns": turns, "trail": trail, "links": links}, threads.where("thread_id % 3 = 0"))
    return left["threads"].select(F.lit("threads").alias("name"), "thread_id").unionAll(left["turns"].select(F.lit("turns"), "thread_id")).unionAll(left["trail"].select(F.lit("trail"), "thread_id")).unionAll(left["links"].select(F.lit("links"), "thread_id")).groupBy("name", "thread_id").agg(F.count("*").alias("n"))


def q_history(spark: SparkSession, d: str) -> DataFrame:
    rows = _turns(spark, d).withColumnRenamed("seq", "ordinal")
    return history(rows, 200, 700).withColumn("md5", F.md5(F.col("history").cast("binary"))).select("thread_id", F.length("history").alias("size"), "md5")


def q_titles(spark: SparkSession, d: str) -> DataFrame:
    from .registry import threads

    return threads(table(spark, d, "conversations"))


def q_fed(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").withColumnRenamed("text", "block")
    out = fed_context(rows, ["conv_id"], [F.col("turn"), F.col("role"), F.col("block")], 300)
    return out.select("conv_id", "turn", "role", F.md5(F.col("block").cast("binary")).alias("md5"))


def q_recent(spark: SparkSession, d: str) -> DataFrame:
    """The 50 busiest users by their last event, and the three months before it."""
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("thread_id")).agg(F.max("ts").alias("updated_at"))
    return recent(e, 50).select("thread_id", utc(F.col("updated_at").cast("timestamp")).alias("updated_at"), F.array_join(months_back(F.col("updated_at"), 3), ",").alias("months"))


def q_notes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    reports = F.when(F.col("event_type") == "error", F.concat(F.lit("failed: code "), F.col("user_id").cast("string"))).when(F.col("event_type") == "signup", "empty").otherwise("ok")
    web = F.when(F.col("event_id") % 3 == 0, "unavailable").when(F.col("event_id") % 3 == 1, "failed: timeout").otherwise("ok")
    return e.select("event_id", source_note(reports, web).alias("note"))


_TURNS = """o AS (SELECT conv_id, turn, min(text) FILTER (WHERE role = 'user') AS question, min(text) FILTER (WHERE role = 'assistant') AS answer FROM conversations GROUP BY 1, 2),
  t AS (SELECT q.conv_id AS thread_id, q.turn AS seq, q.question, a.answer FROM o q JOIN o a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.question IS NOT NULL AND a.answer IS NOT NULL),
  n AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY seq) AS ordinal FROM t)"""
_FLAT = "trim(regexp_replace(coalesce({q}, ''), '\\s+', ' ', 'g'), ' ')"


def _title(q: str) -> str:
    f = _FLAT.format(q=q)
    h = f"substr({f}, 1, 60)"
    at = f"60 - instr(reverse({h}), ' ')"
    return f"CASE WHEN {f} = '' THEN 'Untitled' WHEN length({f}) <= 60 THEN {f} ELSE regexp_replace(CASE WHEN contains({h}, ' ') AND {at} >= 30 THEN substr({h}, 1, CAST({at} AS BIGINT)) ELSE {h} END, '[ ,.;:!?-]+$', '') || '…' END"


_TRAIL = """c AS (SELECT thread_id, ordinal, md5(x) AS chunk, min(i) AS i FROM (SELECT thread_id, ordinal, unnest(string_split(answer, chr(10))) AS x, unnest(range(len(string_split(answer, chr(10))))) AS i FROM n WHERE seq >= 3) WHERE x <> '' GROUP BY 1, 2, 3),
  k AS (SELECT thread_id, ordinal, CAST(row_number() OVER (PARTITION BY thread_id, ordinal ORDER BY i) - 1 AS INTEGER) AS position, chunk FROM c)"""
SQL = {
    "event_times": """
      SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS at, strftime(ts - INTERVAL 1 MONTH, '%Y-%m') || ' ' || strftime(ts - INTERVAL 2 MONTH, '%Y-%m') || ' ' || strftime(ts - INTERVAL 3 MONTH, '%Y-%m') AS months FROM events""",
    "recorded_threads": f"""
      WITH {_TURNS}, g AS (SELECT thread_id, min(seq) FILTER (WHERE seq < 3) AS c0, arg_min(question, seq) FILTER (WHERE seq >= 3) AS q, min(seq) AS created_at, max(seq) AS updated_at, count(*) AS turns FROM n GROUP BY 1)
      SELECT thread_id, md5(CASE WHEN thread_id % 4 = 0 THEN 'Talk number ' || thread_id WHEN c0 IS NOT NULL THEN 'old' ELSE {_title("q")} END) AS title, thread_id % 4 = 0 AS renamed, created_at, updated_at, turns FROM g""",
    "recorded_trail": f"WITH {_TURNS}, {_TRAIL} SELECT thread_id, ordinal, position, chunk FROM k",
    "deleted_threads": f"""
      WITH {_TURNS}, {_TRAIL}, a AS (SELECT 'threads' AS name, thread_id FROM n GROUP BY 2 UNION ALL SELECT 'turns', thread_id FROM n WHERE seq >= 3 UNION ALL SELECT 'trail', thread_id FROM k
        UNION ALL SELECT 'links', thread_id FROM (SELECT DISTINCT thread_id FROM n) WHERE (thread_id + 1) % 3 <> 0 OR thread_id + 1 NOT IN (SELECT thread_id FROM n))
      SELECT name, thread_id, count(*) AS n FROM a WHERE thread_id % 3 <> 0 GROUP BY 1, 2""",
    "prompt_history": f"""
      WITH {_TURNS}, b AS (SELECT thread_id, seq, 'Вопрос: ' || trim(question, ' ') || chr(10) || 'Ответ: ' || CASE WHEN length(trim(answer, ' ')) > 200 THEN substr(trim(answer, ' '), 1, 200) || chr(10) || '[…фрагмент обрезан по бюджету контекста]' ELSE trim(answer, ' ') END AS b FROM n),
      w AS (SELECT *, sum(length(b)) OVER (PARTITION BY thread_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS s, row_number() OVER (PARTITION BY thread_id ORDER BY seq DESC) AS r FROM b),
      h AS (SELECT thread_id, string_agg(b, chr(10) || chr(10) ORDER BY seq) AS h FROM w WHERE s <= 700 OR r = 1 GROUP BY 1) SELECT thread_id, length(h) AS size, md5(h) AS md5 FROM h""",
    "thread_titles": f"""
      WITH g AS (SELECT conv_id, arg_min(text, (turn, text)) FILTER (WHERE role = 'user') AS q, count(*) AS n_turns, max(turn) AS last_turn FROM conversations GROUP BY 1)
      SELECT conv_id, {_title("q")} AS title, n_turns, last_turn FROM g""",
    "fed_context": """
      WITH w AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations)
      SELECT conv_id, turn, role, md5(CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || chr(10) || '[…фрагмент обрезан по бюджету контекста]' ELSE text END) AS md5 FROM w WHERE s <= 300 OR n = 1""",
    "recent_threads": """
      WITH u AS (SELECT user_id AS thread_id, max(ts) AS t FROM events GROUP BY 1 ORDER BY t DESC, thread_id LIMIT 50)
      SELECT thread_id, strftime(t, '%Y-%m-%dT%H:%M:%S+00:00') AS updated_at, array_to_string([strftime(date_trunc('month', t) - to_months(CAST(i AS INTEGER)), '%Y-%m') FOR i IN range(1, 4)], ',') AS months FROM u""",
    "source_notes": """
      WITH s AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'code ' || user_id WHEN 'signup' THEN 'no index is built' END AS r, CASE event_id % 3 WHEN 0 THEN 'no reason given' WHEN 1 THEN 'timeout' END AS w FROM events)
      SELECT event_id, CASE WHEN r IS NOT NULL AND w IS NOT NULL THEN 'no source answered: reports (' || r || '), web (' || w || ')' WHEN r IS NOT NULL THEN 'reports were not searched (' || r || ')'
        WHEN w IS NOT NULL THEN 'the web was not searched (' || w || ')' ELSE '' END AS note FROM s""",
}
QUERIES = {
    "event_times": q_times,
    "recorded_threads": q_recorded, "recorded_trail": q_trail, "deleted_threads": q_deleted, "prompt_history": q_history, "thread_titles": q_titles, "source_notes": q_notes, "fed_context": q_fed, "recent_threads": q_recent}
