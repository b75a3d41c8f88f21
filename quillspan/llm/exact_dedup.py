"""Exact deduplication with two Bloom filter passes.

Pass one keeps, per filter segment, the bits set once and the bits set again; pass two tests
every row against the bits set again. Rows whose text cannot repeat leave the job without a
shuffle; only possibly repeated ones (id, digest, length: no text) are grouped. A filter too large
to broadcast stays in its shards, to which the digests go.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import less, maybe_in, stored, table, whole_rows

SEGMENT_BITS = 1 << 15  # of one segment: 4 KiB
BITS_PER_ROW = 16
BROADCAST_SEGMENTS = 1 << 13  # of 32 MiB; a larger filter stays in shards, and digests go to them
PROBES = 3
_SPACE = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]


def normalised(text: Column) -> Column:
    """The text without white space of ASCII; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in _SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _segments(rows: int) -> int:
    n = 1
    while n * SEGMENT_BITS < rows * BITS_PER_ROW and n < 1 << 30:
        n *= 2
    return n


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seg, h) rows to one row per segment met in this task: bits set once, bits set again."""
    segs, hashes = [], []

    def flush() -> Iterator[pa.RecordBatch]:
        seg, h = np.concatenate(segs), np.concatenate(hashes).view(np.uint64)
        order = np.argsort(seg, kind="stable")
        seg, h = seg[order], h[order]
        starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
        out = []
        for a, b in zip(starts, [*starts[1:], len(seg)]):
            # A text is again there if all its probes were set before: equal probes within the task.
            keys, n = np.unique(h[a:b] & np.uint64((1 << 48) - 1), return_counts=True)
            bits = lambda k: np.unique(np.concatenate([(k >> np.uint64(16 * i)) & np.uint64(SEGMENT_BITS - 1) for i in range(PROBES)])).astype(np.uint16) if len(k) else np.empty(0, np.uint16)
            out.append((int(seg[a]), bits(keys).tobytes(), bits(keys[n > 1]).tobytes()))
        cols = list(zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["seg", "once", "again"])

    rows = 0
    for b in batches:
        if b.num_rows:
            segs.append(b.column(0).to_numpy())
            hashes.append(b.column(1).to_numpy())
            rows += b.num_rows
        if rows >= 2_000_000:
            yield from flush()
            segs, hashes, rows = [], [], 0
    if rows:
        yield from flush()


def _merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All bits of one segment: a bit is set again if two tasks, or one task twice, set it."""
    once, again = np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
    for batch in batches:
        for o, g in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            at = np.frombuffer(o, np.uint16)
            again[at[once[at]]] = True
            once[at] = True
            again[np.frombuffer(g, np.uint16)] = True
    if again.any():
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(again).tobytes()], pa.binary())], ["seg", "bits"])


def repeated_filter(hashes: DataFrame, segments: int) -> DataFrame:
    """Second-seen filter as (seg, bits) of at most ``segments`` rows of 4 KiB, from a column h.

    A task sends two bytes a probe, so what moves is about six bytes a row; a segment's merge
    holds 64 KiB whatever the number of rows. The filter may name texts that do not repeat,
    never the other way round.
    """
    return (
        hashes.select(F.expr(_seg(segments)).alias("seg"), "h")
        .mapInArrow(_fill, "seg int, once binary, again binary")
        .groupBy("seg")
        .applyInArrow(_merge, "seg int, bits binary")
    )


def _seg(segments: int) -> str:
    return f"cast(xxhash64(h) & {segments - 1} as int)"


def _tested(rows: DataFrame, segments: int, again: DataFrame) -> DataFrame:
    """``rows`` (with h, the hash of a digest) and ``maybe``: false where the text surely occurs once."""
    at = lambda i: f"cast(shiftrightunsigned(h, {16 * i}) & {SEGMENT_BITS - 1} as int)"
    byte = lambda i: f"cast(conv(hex(substring(bits, ({at(i)} div 8) + 1, 1)), 16, 10) as int)"
    bit = " AND ".join(f"(shiftright({byte(i)}, 7 - ({at(i)} % 8)) & 1) = 1" for i in range(PROBES))
    held = rows.withColumn("seg", F.expr(_seg(segments))).join(F.broadcast(again) if segments <= BROADCAST_SEGMENTS else again, "seg", "left")
    return held.select(*rows.columns, F.expr(f"coalesce({bit}, false)").alias("maybe"))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def _groups(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of documents (doc_id, text): rows that cannot repeat (doc_id, sha), those that may (doc_id, sha, len, t, u),
    and of each of their digests the row that stays (sha, doc_id, t, u, copies, group_size).

    Digests are counted from the texts once and stored; t is a hash of the text as it is, u a row's number, copies how often
    the row that stays occurs with this id and text.
    """
    rows = docs.select("doc_id", _digest(F.col("text")).alias("sha"), F.coalesce(F.length("text"), F.lit(0)).alias("len"), F.xxhash64("text").alias("t"))
    rows = stored(rows.withColumn("h", F.xxhash64("sha")).withColumn("u", F.monotonically_increasing_id()), "digests")
    segments = _segments(rows.count())
    tested = _tested(rows, segments, stored(repeated_filter(rows.select("h"), segments), "bloom"))
    some = stored(tested.where("maybe").drop("h", "maybe"), "repeats")
    # Repeated rows become one, then the longest of a digest stays; partial minima keep a hot text to a row a task.
    each = some.groupBy("sha", "doc_id", "t").agg(F.max("len").alias("len"), F.min("u").alias("u"), F.count("*").alias("copies"))
    best = F.min(F.struct((-F.col("len")).alias("l"), F.col("doc_id").isNull().alias("n"), "doc_id", "u", "t", "copies")).alias("b")
    groups = each.groupBy("sha").agg(best, F.sum("copies").alias("group_size"))
    groups = stored(groups.select("sha", "b.doc_id", "b.t", "b.u", "b.copies", "group_size"), "groups")
    return tested.where("NOT maybe").select("doc_id", "sha"), some, groups


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical without ASCII white space; null counts as empty. Of equal texts
    that of most code points stays, then that of the smallest id (null ids last); fully repeated
    rows (same id, same length) stay once: the others are not kept. Any other columns are ignored. An empty
    table gives an empty result.
    """
    single, some, groups = _groups(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    single = single.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    groups = groups.select("sha", F.col("doc_id").alias("keep_id"), F.col("u").alias("u0"), "group_size")
    grouped = some.join(groups, "sha").select("doc_id", "keep_id", "group_size", (F.col("u") == F.col("u0")).alias("kept"), "sha")
    return single.unionByName(grouped).withColumn("text_sha256", F.lower(F.hex("sha"))).drop("sha")


def drop_exact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group of ``exact_groups``.

    Rows are known by id and text. A row stays where it is if its digest cannot repeat; if it may, its digest alone was
    grouped, and the row goes unless it is the one that stays. Of rows equal in id and text one stays, whatever their other columns.
    """
    docs = whole_rows(docs)
    _, some, groups = _groups(docs.select("doc_id", "text"))
    copies = some.groupBy("doc_id", "t").agg(F.count("*").alias("rows"))
    keep = groups.select(F.col("doc_id").alias("__id"), F.col("t").alias("__t"), "copies")
    marks = copies.join(keep, F.expr("doc_id <=> __id AND t = __t"), "left").select("doc_id", "t", "rows", F.col("copies").isNotNull().alias("stays"))
    marks = stored(marks.where("NOT stays OR rows > 1"), "marks")
    rest = less(docs, [F.col("doc_id"), F.xxhash64("text")], marks.select("doc_id", "t"))
    once = marks.where("stays").select(F.col("doc_id").alias("__id"), F.col("t").alias("__h"))
    if once.isEmpty():
        return rest.select("row.*")
    held = docs.withColumn("__t", F.xxhash64("text"))
    again = maybe_in(held, "__t", once.select("__h")).join(once, F.expr("doc_id <=> __id AND __t = __h"), "left_semi")
    return rest.unionByName(again.dropDuplicates(["doc_id", "__t"]).drop("__t")).select("row.*")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH n AS (
  SELECT doc_id, coalesce(length(text), 0) AS len,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS rn,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY len DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM r
"""

QUERIES = {"op7_exact_dedup": op7_exact_dedup}
SQL = {"op7_exact_dedup": OP7_SQL}
