"""Token ids as Parquet list columns, and selective reads of them.

A file set holds one row per document in ascending id order: ``doc_id``, ``n_tokens``, ``shard``,
``place`` and ``ids array<int>``. Ids are dictionary-coded where a page's vocabulary is
small enough and delta-coded beyond it; row groups and pages are small, and Parquet's
column and page indexes let a reader fetch a range of documents, or the numbers alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import arrow_type, scratch, table
from .tokens import encoder, vocabulary

END = 2
ROW_GROUP, PAGE, PAGE_ROWS = 16 << 20, 64 << 10, 500
SCHEMA = "doc_id {0}, place bigint, n_tokens bigint, ids array<int>"


def _encode(path: str, end: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail, place = encoder(path), np.array([end], "<u4").tobytes(), 0

        def out(ids: list, raw: list[bytes]) -> pa.RecordBatch:
            nonlocal place
            n = np.array([len(r) // 4 for r in raw], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4")))
            place += len(raw)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, id_type), pa.array(np.arange(place - len(raw), place)), pa.array(n), lists], ["doc_id", "place", "n_tokens", "ids"]
            )

        for batch in batches:
            ids, raw, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(doc_id)
                raw.append(enc.encode(text.as_py()) + tail)
                size += len(raw[-1])
                if size > 2 << 20:
                    yield out(ids, raw)
                    ids, raw, size = [], [], 0
            if ids:
                yield out(ids, raw)

    return run


def write_tokens(docs: DataFrame, path: str, vocab: str, end: int = END, per_file: int = 200_000) -> None:
    """Encodes ``doc_id`` and ``text`` (null: empty) of ``docs`` and writes them below ``path``.

    Rows are dealt by ranges of id, so file order is id order; null ids come first, and rows
    with one id follow each other by a digest of their text. Repeated rows stay. An
    empty table gives an empty file set.
    """
    id_type = dict(docs.dtypes)["doc_id"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = docs.select("doc_id", "text").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    tokens = rows.mapInArrow(_encode(vocab, end, arrow_type(docs, "doc_id")), SCHEMA.format(id_type)).withColumn("shard", F.spark_partition_id())
    (
        tokens.write.option("parquet.block.size", ROW_GROUP)
        .option("parquet.page.size", PAGE)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.enable.dictionary", "true")
        .option("parquet.dictionary.page.size", 256 << 10)
        .option("parquet.writer.version", "v2")
        .option("parquet.compression", "zstd")
        .option("maxRecordsPerFile", per_file)
        .parquet(path)
    )


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and n_tokens of every document; the id column is not read.

    Totals per shard are a row a shard; running sums then stay within one.
    """
    rows = spark.read.parquet(path).select("doc_id", "shard", "place", "n_tokens")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("t")).select("shard", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    within = W.partitionBy("shard").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    return rows.join(F.broadcast(shards), "shard").select(
        "doc_id", (F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("start"), "n_tokens", "shard", "place"
    )


def read_tokens(spark: SparkSession, path: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Documents of ids from ``lo`` to ``hi``; the range reaches the scan and skips row groups and pages."""
    rows = spark.read.parquet(path)
    if lo is not None:
        rows = rows.where(F.col("doc_id") >= lo)
    return rows if hi is None else rows.where(F.col("doc_id") <= hi)


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(2)
        flat, at = lists.values.to_numpy().astype("<u4", copy=False), lists.offsets.to_numpy()
        crc = [zlib.crc32(flat[x:y].tobytes()) for x, y in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(crc, pa.int64())], ["shard", "place", "ids_crc32"])


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """shard, place and the unsigned crc32 of each document's ids, read from the files."""
    return spark.read.parquet(path).select("shard", "place", "ids").mapInArrow(_crc, "shard int, place bigint, ids_crc32 bigint")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, vocabulary())
    return read_numbers(spark, path).join(checksums(spark, path), ["shard", "place"]).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op3_token_files": op3_token_files}
SQL: dict[str, str] = {}
