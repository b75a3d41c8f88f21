"""Line deduplication by a deletion-neighbourhood join.

Two lines within one edit share a variant with one character deleted, or one is such a variant of the
other. One edit leaves a half of the line as it was, so a line emits hashed variants only where it
shares a half with a different line of fitting length, and only of deletions in its other half. Equal
keys are joined, the edit distance is verified, and the earliest line stays. A line that goes names the
earliest line near it, and the line at which the chain of such lines ends: that one stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import ends
from .shared import marked, maybe_in, stored, table

BROADCAST_ROWS = 200_000  # of codes or keys (about 10 MB); beyond it the same join is shuffled
BROADCAST_BYTES = 32 << 20  # of line numbers to drop; beyond it the documents that may have some are shuffled
U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def _lines(docs: DataFrame, shortest: int) -> DataFrame:
    """doc_id, line_no and line (without spaces, tabs or carriage returns at its ends) of all lines of ``shortest`` characters or more."""
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.select("doc_id", "line_no", F.trim(F.col("line"), F.lit(" \t\r")).alias("line")).where(F.length("line") >= shortest)


#: Places of a variant row that deletes nothing, or that deletes a character to reach a shorter line.
WHOLE, SHORTER = -1, -2
#: Of length n and of length n - 1: the first and the last half, and the number of the line's half that it leaves out.
HALVES = """
  flatten(transform(array(n, n - 1), m -> array(
    xxhash64(m, 'L', substring(line, 1, m div 2)), xxhash64(m, 'R', substring(line, n - (m - m div 2) + 1, m - m div 2)))))"""


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, place) of variants with one character deleted in the halves that ``mask`` names.

    Bits 0 and 1: a line of the same length, or longer by one, has the same first or last half. Bits 2
    and 3: a line shorter by one has it.
    """
    for b in batches:
        keys, places, owners, held = [], [], [], 0

        def out() -> pa.RecordBatch:
            take = pa.array(np.concatenate(owners))
            return pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(places))], ["doc_id", "line_no", "key", "place"])

        for i, (x, m) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
            c = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U) + U(1)
            n = len(c)
            power = np.cumprod(np.r_[U(1), np.full(n, U(_BASE))])
            left = np.r_[U(0), np.cumsum(c * power[:n])]  # of the first i characters
            down = np.r_[U(0), np.cumsum(c[1:] * power[: n - 1])]  # the same characters one place earlier
            gone = left[:n] + (down[n - 1] - down[:n]) + U((n - 1) * (0xD6E8FEB8 << 16) & (1 << 64) - 1)
            at = np.arange(n, dtype=np.int32)
            same = at[(n // 2 if not m & 2 else 0) : (n if m & 1 else n // 2)] if m & 3 else at[:0]
            cut = at[((n - 1) // 2 if not m & 8 else 0) : (n if m & 4 else (n - 1) // 2 + 1)] if m & 12 else at[:0]
            whole = left[n:] + U(n * (0xD6E8FEB8 << 16) & (1 << 64) - 1) if m & 3 else left[:0]
            keys += [whole, gone[same], gone[cut]]
            places += [np.full(len(whole), WHOLE, np.int32), same, np.full(len(cut), SHORTER, np.int32)]
            owners += [np.full(len(whole) + len(same) + len(cut), i)]
            held += len(owners[-1])
            if held > 500_000:
                yield out()
                keys, places, owners, held = [], [], [], 0
        if owners:
            yield out()


def _near(lines: DataFrame, hashes: DataFrame, distinct: DataFrame) -> DataFrame:
    """(doc_id, line_no, keep_doc_id, keep_line_no): distinct lines with an earlier one at one edit."""
    # Only hashes go through the shuffle. Equal lines have one code, and sharing halves among themselves counts for nothing.
    keyed = hashes.select(F.col("h1").alias("code"), F.posexplode("halves").alias("which", "half"))
    shared = stored(keyed.groupBy("half").agg(F.min("code").alias("lo"), F.max("code").alias("hi")).where("lo <> hi").select("half"), "shared")
    few = shared.count() <= BROADCAST_ROWS
    hits = keyed.join(F.broadcast(shared), "half", "left_semi") if few else maybe_in(keyed, "half", shared).join(shared, "half", "left_semi")
    mask = F.bit_or(F.expr("shiftleft(1, which)")).alias("mask")
    codes = stored(hits.groupBy("code").agg(mask).withColumnRenamed("code", "h1"), "codes")
    codes = F.broadcast(codes) if codes.count() <= BROADCAST_ROWS else codes
    some = stored(distinct.join(codes, "h1").groupBy("doc_id", "line_no").agg(F.bit_or("mask").alias("mask")), "eligible")
    some = F.broadcast(some) if some.count() <= BROADCAST_ROWS else some
    texts = stored(lines.join(some, ["doc_id", "line_no"]), "texts").dropDuplicates(["doc_id", "line_no"])
    variants = texts.select("doc_id", "line_no", "line", "mask").mapInArrow(_variants, f"doc_id {dict(lines.dtypes)['doc_id']}, line_no int, key bigint, place int")
    variants = stored(variants, "variants")
    at = F.struct("doc_id", "line_no")
    # One character differs: equal variants of one place. The earliest line of a key is near all its others.
    same = variants.where("place >= 0")
    first = same.groupBy("key", "place").agg(F.min(at).alias("e"), F.max(at).alias("l")).where("e <> l").select("key", "place", "e")
    swapped = same.join(first, ["key", "place"]).select(at.alias("x"), F.col("e").alias("y"))
    # One character more: a variant of the longer line is the shorter line.
    cut, whole = variants.where(f"place = {SHORTER}"), variants.where(f"place = {WHOLE}")
    longer = cut.select("key", at.alias("x")).join(whole.select("key", at.alias("y")), "key").select("x", "y")
    pairs = swapped.unionByName(longer).where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    left = texts.select(at.alias("x"), F.col("line").alias("line_x"))
    right = texts.select(at.alias("y"), F.col("line").alias("line_y"))
    near = pairs.join(left, "x").join(right, "y").where(F.levenshtein("line_x", "line_y", 1).between(0, 1))
    return near.groupBy("x").agg(F.min("y").alias("y")).select("x.doc_id", "x.line_no", F.col("y.doc_id").alias("keep_doc_id"), F.col("y.line_no").alias("keep_line_no"))


def dropped_lines(docs: DataFrame, shortest: int = 1, edited: int = 1) -> DataFrame:
    """(doc_id, line_no, keep_doc_id, keep_line_no, end_doc_id, end_line_no) of every line that goes.

    A line goes if an equal line, or one within a single inserted, deleted or changed character,
    stands earlier (by document id, then line number); keep names the earliest such line. That line may itself go for a still
    earlier one: end names the line at which this chain ends, which stays. Equality is of lines without white space at
    their ends, told by 128 bits of hash. Lines of fewer than ``edited`` characters, if more than 1 is asked for, go for equal ones only, those of fewer than ``shortest`` never.
    """
    lines = _lines(docs, shortest)
    hashes = lines.withColumn("n", F.length("line")).select("doc_id", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit("2")).alias("h2"), F.when(F.col("n") >= edited, F.expr(HALVES)).alias("halves"))
    hashes = stored(hashes, "hashes")
    distinct = stored(hashes.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("c")).select("h1", "h2", "first.*", "c"), "distinct")
    near = stored(_near(lines, hashes, distinct), "near")
    chain = ends(near.select(F.struct("doc_id", "line_no").alias("a"), F.struct(F.col("keep_doc_id").alias("doc_id"), F.col("keep_line_no").alias("line_no")).alias("b")))
    near = near.join(chain.select("a.doc_id", "a.line_no", F.col("b").alias("end")), ["doc_id", "line_no"])
    special = distinct.join(near, ["doc_id", "line_no"], "left").where("c > 1 OR keep_line_no IS NOT NULL")
    special = special.select("h1", "h2", F.struct("doc_id", "line_no").alias("first"), F.when(F.col("keep_line_no").isNotNull(), F.struct(F.col("keep_doc_id").alias("doc_id"), F.col("keep_line_no").alias("line_no"))).alias("near"), "end")
    special = stored(special, "special")
    hit = hashes.drop("halves").join(special, ["h1", "h2"]).where("near IS NOT NULL OR struct(doc_id, line_no) <> first")
    keep, end = F.coalesce("near", "first"), F.coalesce("end", "first")
    return hit.select("doc_id", "line_no", keep["doc_id"].alias("keep_doc_id"), keep["line_no"].alias("keep_line_no"), end["doc_id"].alias("end_doc_id"), end["line_no"].alias("end_line_no"))


def clean_lines(docs: DataFrame, shortest: int = 1, edited: int = 1) -> DataFrame:
    """``docs`` with ``text`` less its dropped lines, and n_lines, n_dropped and dropped (line numbers from 0).

    Lines of fewer than ``shortest`` characters, and empty ones, always stay; ``edited`` is as in ``dropped_lines``. A null text stays null with no lines, a null id leaves its
    row as it is, and an empty text is one empty line. Rows of one id are versions of one document: lines at one place do not
    drop each other. Extra columns stay, but for names that this adds.

    Line numbers go to the documents where they stand if they fit into BROADCAST_BYTES; else the documents that a
    filter lets through, those with dropped lines and few others, are shuffled, and all others stay where they are.
    """
    drops = stored(dropped_lines(docs, max(1, shortest), edited).groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("dropped")), "drops")
    size = drops.agg(F.coalesce(F.sum(64 + 4 * F.size("dropped")), F.lit(0)).alias("bytes")).first().bytes
    rest = docs.drop("n_lines", "n_dropped", "dropped")
    if size <= BROADCAST_BYTES:
        rest = rest.join(F.broadcast(drops), "doc_id", "left")
    else:
        held = marked(rest, F.xxhash64("doc_id"), drops.select(F.xxhash64("doc_id").alias("v")))
        some = held.where("__maybe").join(drops, "doc_id", "left")
        rest = some.unionByName(held.where("NOT __maybe"), allowMissingColumns=True)
    rest = rest.withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
    kept = F.expr("array_join(filter(split(text, '\\n'), (x, i) -> NOT array_contains(dropped, i)), '\\n')")
    return rest.select(
        *[F.when(F.size("dropped") > 0, kept).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped", "dropped")],
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"),
        F.size("dropped").alias("n_dropped"),
        "dropped",
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many go and which, and the digest of what is left (null text: of the empty one)."""
    rows = clean_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", "dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


QUERIES = {"op10_line_dedup": op10_line_dedup}
SQL: dict[str, str] = {}
