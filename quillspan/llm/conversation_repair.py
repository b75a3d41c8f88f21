"""Repair of conversations' structure at the least cost, by interval parsing.

A legal conversation is an optional system turn, then pairs of a user's and an assistant's turn. Its grammar in Chomsky normal form has a
nonterminal for each pair of places in that pattern, (p, q): what leads from p to q, with the rules (p, q) -> (p, r) (r, q). Cells of a span
hold the least (cost, audit) of each nonterminal. Cells of single rows hold their edits, closed under insertions on both sides;
those of longer spans are combined bottom-up, spans of 1, 2, 4 ... rows. Since every derivation of (p, q) passes some
place r at every row, all ways to split a span give the same cells, so one of them is enough. Of audits of the same cost and span none
begins another, so the least audit of a span is made of the least audits of its parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_type, on_workers, stored, table

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Places: 0 at the start, 1 after the system's turn, 2 after a user's, 3 after an assistant's; what initials lead where, and where one may end.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
PLACES, ENDS = range(4), (0, 3)
ROLE = {"u": "user", "a": "assistant"}
SPAN, CHARS, FAN = 4096, 16_000_000, 64  # rows and characters of a conversation that one task holds; spans that are combined at once
FAULTS = ("", "blank", "duplicate", "truncated")

Cells = dict[tuple[int, int], tuple[int, str]]
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _less(cells: Cells, key: tuple[int, int], value: tuple[int, str]) -> None:
    if key not in cells or value < cells[key]:
        cells[key] = value


@lru_cache(None)
def inserted() -> Cells:
    """Insertions alone: the fewest users and assistants that lead from one place to another."""
    cells: Cells = {(p, p): (0, "") for p in PLACES}
    for _ in PLACES:
        for (p, r), (cost, audit) in list(cells.items()):
            for c in ROLE:
                if (r, c) in NEXT:
                    _less(cells, (p, NEXT[r, c]), (cost + INSERT, audit + "I"))
    return cells


def combined(left: Cells, right: Cells) -> Cells:
    """Cells of a span from those of its two parts."""
    cells: Cells = {}
    for (p, r), (a, x) in left.items():
        for q in PLACES:
            if (r, q) in right:
                b, y = right[r, q]
                _less(cells, (p, q), (a + b, x + y))
    return cells


@lru_cache(None)
def row_cells(initial: str, fault: str) -> Cells:
    """Cells of one row, with insertions on both sides."""
    edits: Cells = {(p, p): (DELETE, "D") for p in PLACES}
    if fault in ("", "truncated"):
        extra = TRUNCATED * (fault == "truncated")
        for (p, c), q in NEXT.items():
            if c == initial:
                _less(edits, (p, q), (KEEP + extra, "K"))
            elif c in ROLE:
                _less(edits, (p, q), (REROLE + extra, "R"))
    return combined(combined(inserted(), edits), inserted())


@lru_cache(1 << 16)
def _short(kinds: tuple[tuple[str, str], ...]) -> Cells:
    if len(kinds) == 1:
        return row_cells(*kinds[0])
    half = 1 << (len(kinds) - 1).bit_length() - 1
    return combined(_short(kinds[:half]), _short(kinds[half:]))


def span_cells(spans: Iterable[Cells]) -> Cells:
    """Cells of spans in a row, combined in pairs until one is left."""
    level = list(spans)
    while len(level) > 1:
        level = [combined(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else {(0, 0): (0, "")}


def cells_of(kinds: list[tuple[str, str]]) -> Cells:
    """Cells of rows (initial of the role, fault); spans of eight rows are remembered, as short conversations look alike."""
    return span_cells(_short(tuple(kinds[i : i + 8])) for i in range(0, len(kinds), 8))


def best(cells: Cells) -> tuple[int, str]:
    """The least (cost, audit) of a whole conversation."""
    return min(cells[0, q] for q in ENDS if (0, q) in cells)


class Repair:
    """Applies an audit to rows as they come: ``take`` gives the turns (role, text) that a row and the insertions before it leave."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.place, self.digest, self.n = audit, 0, 0, hashlib.sha256(), 0

    def _turn(self, role: str, text: str) -> tuple[str, str]:
        self.place = NEXT[self.place, role[:1]]
        self.digest.update(("\n" * (self.n > 0) + f"{role}:{text}").encode())
        self.n += 1
        return role, text

    def _due(self) -> str:
        return ROLE["a" if self.place == 2 else "u"]

    def inserts(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._turn(self._due(), "")

    def take(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserts()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit != "D":
            yield self._turn(role if edit == "K" else self._due(), text)


def fault_of(text: str) -> str:
    """blank, truncated or none, of a text alone."""
    end = text.rstrip(SPACE)[-1:]
    return "blank" if not end else "" if end in ".!?" else "truncated"


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of turns after damage, which a checksum of ``conv_id:turn`` decides; copies 0: the row is dropped. Nulls but those of the numbers are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 0, "").when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(kind == 4, "user").otherwise(space("role"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.cast("long").alias("copies"))


def _order() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def _report(rows: list[tuple]) -> tuple[list[int], str, list[tuple[str, str]]]:
    """Numbers (gaps, faults, illegal, cost) of a conversation's rows (turn, role, text) in order, its audit, and its repaired turns."""
    seen, kinds = set(), []
    for _, role, text in rows:
        fault = fault_of(text)
        if fault != "blank" and (role, text) in seen:
            fault = "duplicate"
        seen.add((role, text))
        kinds.append((role[:1], fault))
    turns = {t for t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
    cost, audit = best(cells_of(kinds))
    return [gaps, *(sum(k[1] == f for k in kinds) for f in FAULTS[1:]), illegal, cost], audit, [(role, text) for _, role, text in rows]


def _rows(columns: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = [id_type, pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
    names = ["conv_id", "at", "role", "text", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*columns), types)], names)


def _whole(id_type: pa.DataType, texts: bool):
    """Reports of conversations, whose rows come one after the other; with ``texts`` their repaired turns too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, out, size = object(), [], 0
        current, rows = none, []

        def close() -> None:
            nonlocal size
            numbers, audit, turns = _report(rows)
            repair, made = Repair(audit), []
            for role, text in turns:
                made += repair.take(role, text)
            made += repair.inserts()
            if texts:
                out.extend((current, n, role, text, *[None] * 8) for n, (role, text) in enumerate(made))
            out.append((current, None, None, None, *numbers, audit, repair.digest.hexdigest()))
            size += sum(len(t) for _, t in made) * texts + 200

        for batch in batches:
            for conv, turn, role, text, copies in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != current or current is none:
                    if current is not none:
                        close()
                    current, rows = conv, []
                rows += [(turn, role, text)] * copies
                if size > 1 << 20:
                    yield _rows(out, id_type)
                    out, size = [], 0
        if current is not none:
            close()
        if out:
            yield _rows(out, id_type)

    return run


# ---- Conversations that no task should hold whole -----------------------------------------------


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their span: the task's number and the place in it, in steps of SPAN."""
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        places = range(at, at + len(batch))
        at += len(batch)
        extra = [pa.array([(part << 32) + p // SPAN for p in places], pa.int64()), pa.array([p % SPAN for p in places], pa.int32())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "span", "i"])


def _pack(cells: Cells) -> list[dict]:
    return [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in cells.items()]


def _unpack(cells) -> Cells:
    return {(c["p"], c["q"]): (c["cost"], c["audit"]) for c in cells}


CELLS = "span long, head string, tail string, blank long, duplicate long, truncated long, illegal long, cells array<struct<p:int,q:int,cost:long,audit:string>>"


def _span(rows: pd.DataFrame) -> pd.DataFrame:
    """Cells of one span: rows (i, initial, fault, times, first); rows that no ``first`` names, and further copies, are duplicates."""
    rows = rows.sort_values("i")
    first = set(rows.loc[rows["first"], "i"])
    kinds = []
    for i, initial, fault, times in rows.loc[~rows["first"], ["i", "initial", "fault", "times"]].itertuples(index=False):
        kinds.append((initial, fault if fault == "blank" or i in first else "duplicate"))
        kinds += [(initial, fault if fault == "blank" else "duplicate")] * (int(times) - 1)
    row = rows.iloc[0]
    count = lambda f: sum(k[1] == f for k in kinds)
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
    return pd.DataFrame([{"conv_id": row.conv_id, "span": row.span, "head": kinds[0][0], "tail": kinds[-1][0], **{f: count(f) for f in FAULTS[1:]}, "illegal": illegal, "cells": _pack(cells_of(kinds))}])


def _joined(spans: pd.DataFrame) -> pd.DataFrame:
    """One span of up to FAN consecutive ones."""
    spans = spans.sort_values("span")
    bounds = sum(a + b not in ("su", "ua", "au") for a, b in zip(spans["tail"][:-1], spans["head"][1:]))
    sums = {f: int(spans[f].sum()) for f in (*FAULTS[1:], "illegal")}
    sums["illegal"] += bounds
    cells = span_cells(_unpack(c) for c in spans["cells"])
    return pd.DataFrame([{"conv_id": spans["conv_id"].iloc[0], "span": spans["span"].iloc[0] // FAN, "head": spans["head"].iloc[0], "tail": spans["tail"].iloc[-1], **sums, "cells": _pack(cells)}])


def _long_conversations(rows: DataFrame, id_type: pa.DataType, texts: bool, out: str) -> DataFrame:
    """What ``_whole`` gives, of conversations of any length: spans of SPAN rows are parsed apart from each other and combined FAN at a
    time. Only the digest, which is a chain, reads the rows of a conversation in one task, row by row."""
    same = ["conv_id", "turn", "role", "text"]
    equal = rows.groupBy(*same).agg(F.sum("copies").alias("times"))
    kind = dict(equal.dtypes)
    placed = equal.where("times > 0").repartitionByRange(*_order()).sortWithinPartitions(*_order())
    placed = stored(placed.mapInArrow(_placed, f"{', '.join(f'`{c}` {t}' for c, t in kind.items())}, span long, i int"), "long-rows")
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(trimmed == "", "blank").when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "").otherwise("truncated")
    light = placed.select("conv_id", "span", "i", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "times")
    # Of each text the first place is kept; it goes back to its span alone.
    first = placed.groupBy("conv_id", F.sha2(F.concat("role", F.lit("\n"), "text"), 256).alias("d"), "role").agg(F.min(F.struct("span", "i")).alias("f"))
    first = first.select("conv_id", "f.span", "f.i", F.lit("").alias("initial"), F.lit("").alias("fault"), F.lit(0).cast("long").alias("times"), F.lit(True).alias("first"))
    both = light.withColumn("first", F.lit(False)).unionByName(first)
    schema = f"conv_id {kind['conv_id']}, {CELLS}"
    spans = stored(both.groupBy("conv_id", "span").applyInPandas(_span, schema), "spans")
    number = F.row_number().over(_by_conversation("span")) - 1
    spans = spans.join(stored(spans.select("conv_id", "span").withColumn("n", number.cast("long")), "numbers").select(F.col("conv_id").alias("c"), F.col("span").alias("s"), "n"), F.expr("conv_id <=> c AND span = s"))
    spans = spans.drop("c", "s", "span").withColumnRenamed("n", "span").select(*[c.split()[0] for c in schema.split(", ")][:9])
    while spans.agg(F.max("span")).first()[0]:
        spans = stored(spans.groupBy("conv_id", F.floor(F.col("span") / FAN).alias("up")).applyInPandas(_joined, schema), "spans")
    turns = rows.where("copies > 0").groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count_distinct("turn").alias("n"))
    gaps = turns.select(F.col("conv_id").alias("c"), F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("n"), F.lit(0)).cast("long").alias("gaps"))
    heads = rows.select("conv_id").distinct().join(spans.drop("span", "head", "tail").withColumnRenamed("conv_id", "c"), F.expr("conv_id <=> c"), "left").drop("c")
    heads = heads.join(gaps, F.expr("conv_id <=> c"), "left").drop("c")
    heads = heads.select("conv_id", F.lit(-1).cast("long").alias("span"), F.lit(0).alias("i"), F.struct("gaps", *FAULTS[1:], "illegal", "cells").alias("head"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("times"))
    body = placed.select("conv_id", "span", "i", F.lit(None).cast(heads.schema["head"].dataType).alias("head"), "role", "text", "times")
    lined = heads.unionByName(body).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "span", "i")
    return lined.mapInArrow(_chained(id_type, texts), out)


def _by_conversation(order: str):
    from pyspark.sql import Window

    return Window.partitionBy("conv_id").orderBy(order)


def _chained(id_type: pa.DataType, texts: bool):
    """Digests of conversations whose report comes first and whose rows follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair, numbers, out, size, current = None, [], [], 0, None

        def give(turns: Iterable[tuple[str, str]]) -> None:
            nonlocal size
            for n, (role, text) in enumerate(turns, repair.n):
                size += len(text) + 100
                if texts:
                    out.append((current, n, role, text, *[None] * 8))

        def close() -> None:
            give(repair.inserts())
            out.append((current, None, None, None, *numbers, repair.audit, repair.digest.hexdigest()))

        for batch in batches:
            for conv, _, _, head, role, text, times in zip(*(c.to_pylist() for c in batch.columns)):
                if head is not None:
                    if repair is not None:
                        close()
                    cost, audit = best(_unpack(head["cells"])) if head["cells"] else (0, "")
                    current, repair = conv, Repair(audit)
                    numbers = [head["gaps"] or 0, *(head[f] or 0 for f in (*FAULTS[1:], "illegal")), cost]
                for _ in range(times):
                    give(repair.take(role, text))
                if size > 1 << 20:
                    yield _rows(out, id_type)
                    out, size = [], 0
        if repair is not None:
            close()
        if out:
            yield _rows(out, id_type)

    return run


def repairs(turns: DataFrame, texts: bool = True, span: int = SPAN) -> DataFrame:
    """Reports of conversations (rows as ``damaged`` gives them) and, with ``texts``, their repaired turns.

    A report has a null ``at`` and the columns of REPORT; a repaired turn has its place ``at``, role and text. Rows of a conversation are taken
    by turn (nulls first), then role and text. Nulls of conv_id are one conversation; an empty role has no initial and cannot be
    kept; repeated rows are duplicates; a conversation without rows after damage has zeros, an empty audit and the digest of no text; an empty
    table gives an empty result, and other columns are left out. Conversations above ``span`` rows or 16,000,000 characters are parsed in spans.
    """
    on_workers(turns.sparkSession)
    id_type, kind = arrow_type(turns, "conv_id"), dict(turns.dtypes)["conv_id"]
    out = f"conv_id {kind}, at long, role string, text string, {REPORT}"
    sizes = turns.groupBy("conv_id").agg(F.sum(F.greatest("copies", F.lit(1))).alias("n"), F.sum(F.col("copies") * F.length("text")).alias("chars"))
    large = stored(sizes.where((F.col("n") > span) | (F.col("chars") > CHARS)).select(F.col("conv_id").alias("large")), "large")
    ordinary, some = turns, not large.isEmpty()
    if some:
        ordinary = turns.join(large, F.expr("conv_id <=> large"), "left_anti")
    made = ordinary.repartition("conv_id").sortWithinPartitions(*_order()).select("conv_id", "turn", "role", "text", "copies").mapInArrow(_whole(id_type, texts), out)
    if some:
        made = made.unionByName(_long_conversations(turns.join(large, F.expr("conv_id <=> large"), "left_semi"), id_type, texts, out))
    return made


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs(damaged(table(spark, sf_dir, "conversations")), texts=False).drop("at", "role", "text")


#: The same repairs by a walk along the rows: of each place in the pattern the least (cost, audit) that leads there.
OP11_SQL = r"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
c AS (SELECT DISTINCT k, [CAST(ord(x) AS BIGINT) FOR x IN string_split(k, '')] AS b FROM o),
h AS (SELECT k, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda a, x: CAST(list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS BIGINT)), 4294967295) % 20 AS kind FROM c),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM o JOIN h USING (k)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault, role[1] AS c, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n),
g(p, q, n, made) AS (VALUES (0, 0, 0, []), (0, 2, 1, ['user:']), (0, 3, 2, ['user:', 'assistant:']), (1, 1, 0, []), (1, 2, 1, ['user:']), (1, 3, 2, ['user:', 'assistant:']), (2, 2, 0, []), (2, 3, 1, ['assistant:']), (3, 3, 0, []), (3, 2, 1, ['user:'])),
e(p, c, q, name) AS (VALUES (0, 's', 1, ''), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'), (2, 'a', 3, 'assistant'), (3, 'u', 2, 'user')),
s AS (SELECT conv_id, i, p, p AS q, 4 AS cost, 'D' AS audit, CAST([] AS VARCHAR[]) AS made FROM f, range(4) t(p)
  UNION ALL SELECT conv_id, i, p, q, CASE WHEN fault = '' THEN 0 ELSE 3 END, 'K', [role || ':' || text] FROM f JOIN e USING (c) WHERE fault IN ('', 'truncated')
  UNION ALL SELECT conv_id, i, p, q, CASE WHEN fault = '' THEN 3 ELSE 6 END, 'R', [name || ':' || text] FROM f, e WHERE name <> '' AND fault IN ('', 'truncated')),
w AS (SELECT v.conv_id, CAST(0 AS BIGINT) AS i, q AS place, {'cost': CAST(3 * n AS BIGINT), 'audit': repeat('I', n), 'made': CAST(made AS VARCHAR[])} AS m FROM (SELECT DISTINCT conv_id FROM conversations) v, g WHERE p = 0
  UNION ALL SELECT conv_id, i, place, min(m) FROM (
    SELECT w.conv_id, s.i, g.q AS place, {'cost': w.m.cost + s.cost + 3 * g.n, 'audit': w.m.audit || s.audit || repeat('I', g.n), 'made': list_concat(list_concat(w.m.made, s.made), CAST(g.made AS VARCHAR[]))} AS m
    FROM w JOIN s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.i = w.i + 1 AND s.p = w.place JOIN g ON g.p = s.q) GROUP BY conv_id, i, place),
b AS (SELECT conv_id, min(m) AS m FROM (SELECT *, max(i) OVER (PARTITION BY conv_id) AS z FROM w) WHERE i = z AND place IN (0, 3) GROUP BY conv_id),
t AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE i > 1 AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, m.cost AS cost, m.audit AS audit,
  sha256(array_to_string(m.made, chr(10))) AS repaired_sha256 FROM b LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM b.conv_id
"""

QUERIES = {"op11_conversation_repair": op11_conversation_repair}
SQL = {"op11_conversation_repair": OP11_SQL}
