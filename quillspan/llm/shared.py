"""Helpers that several of the training-data operators use."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes (not letters or digits) that end a word; A-Z are words here and are lower-cased apart.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session, as in tests, may leave the setting out: a temporary folder is set then.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        base = spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quillspan-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, **options: object) -> DataFrame:
    """``df`` as a written table: cuts the lineage, survives lost executors, has known sizes."""
    path = scratch(df.sparkSession, what)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Environment of Python workers: freed arrays go back to the system, so a worker that waits between stages holds little.
WORKER_ENV = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": "2097152", "MALLOC_TRIM_THRESHOLD_": "2097152"}
BATCH_BYTES = 2 << 20  # of the Arrow batches that tasks take, where the session has Spark's own 64 MiB


def on_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, and keeps their memory small."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))
    for name, value in WORKER_ENV.items():
        env.setdefault(name, value)
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if (spark.conf.get(limit, None) or "").lower() in ("67108864b", "67108864", "64m", "64mb"):
        spark.conf.set(limit, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array, in their own case; null has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold that a row belongs to. A null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    """The Arrow type in which tasks get a column, whatever its type is."""
    return to_arrow_type(df.schema[column].dataType)


#: Of a Bloom filter: bits of a segment (Spark's bitmaps), bits a value, and segments at most, so that 32 MiB are ever broadcast.
SEGMENT_BITS, BITS_PER_VALUE, MAX_SEGMENTS = 1 << 15, 16, 1 << 13


def marked(rows: DataFrame, key: Column, values: DataFrame) -> DataFrame:
    """``rows`` with ``__maybe``: false where the 64-bit ``key`` is surely not among the one column of ``values``.

    A Bloom filter of two bits a value, all in one segment, goes to every executor. Its size is bounded: above
    four times as many values as it has room for (67 million), where it would tell few rows apart, all are marked.
    """
    (name,) = values.columns
    n, segments = values.count(), 1
    while segments < MAX_SEGMENTS and segments * SEGMENT_BITS < n * BITS_PER_VALUE:
        segments *= 2
    if n * BITS_PER_VALUE > 4 * MAX_SEGMENTS * SEGMENT_BITS:
        return rows.withColumn("__maybe", F.lit(True))
    seg = f"cast(shiftrightunsigned({{}}, 40) & {segments - 1} as int)"
    bit = [f"({{}} & {SEGMENT_BITS - 1})", f"(shiftrightunsigned({{}}, 20) & {SEGMENT_BITS - 1})"]
    bits = values.select(F.expr(seg.format(f"`{name}`")).alias("__seg"), F.explode(F.expr(f"array({', '.join(b.format(f'`{name}`') for b in bit)})")).alias("b"))
    bitmap = stored(bits.groupBy("__seg").agg(F.bitmap_construct_agg("b").alias("__bits")), "members")
    test = " AND ".join(f"(shiftright(cast(conv(hex(substring(__bits, cast({b.format('__key')} div 8 as int) + 1, 1)), 16, 10) as int), cast({b.format('__key')} % 8 as int)) & 1) = 1" for b in bit)
    tested = rows.withColumn("__key", key).withColumn("__seg", F.expr(seg.format("__key"))).join(F.broadcast(bitmap), "__seg", "left")
    return tested.select(*[tested[c] for c in rows.columns], F.expr(f"coalesce({test}, false)").alias("__maybe"))


def whole_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): rows with all their columns as one, so that no name of theirs meets one that a step adds; ``row.*`` gives them back."""
    return docs.select("doc_id", "text", F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row"))


def maybe_in(rows: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """The rows whose ``column`` is among the one column of ``values``, and perhaps a few others."""
    (name,) = values.columns
    return marked(rows, F.xxhash64(column), values.select(F.xxhash64(name).alias("v"))).where("__maybe").drop("__maybe")


def less(rows: DataFrame, keys: list[Column], gone: DataFrame) -> DataFrame:
    """``rows`` less those whose ``keys`` stand in the columns of ``gone``, which are as many; nulls are equal.

    Rows that a filter of ``gone`` tells apart stay where they are. Of the others the keys alone are joined; then only the rows
    that the filter was wrong about, about one in seventy, are moved, so dropped rows never are.
    """
    names, gone = [f"__k{i}" for i in range(len(keys))], gone.toDF(*[f"__g{i}" for i in range(len(keys))])
    hashed = lambda df: df.select(F.xxhash64(*df.columns).alias("v"))
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(g)) for n, g in zip(names, gone.columns)])
    held = rows.select("*", *[k.alias(n) for k, n in zip(keys, names)])
    held = marked(held, F.xxhash64(*names), hashed(gone))
    wrong = stored(held.where("__maybe").select(*names).join(gone, same, "left_anti").distinct(), "wrong").toDF(*gone.columns)
    some = marked(held.where("__maybe").drop("__maybe"), F.xxhash64(*names), hashed(wrong)).where("__maybe").join(wrong, same, "left_semi")
    return held.where("NOT __maybe").unionByName(some).drop(*names, "__maybe")
