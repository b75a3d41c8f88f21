"""Harmonic packing of token sequences.

A document's last part of r tokens belongs to class k = capacity // r: a bin of that class
takes exactly k parts, whose places need no search. Each task fills its own bins, so nothing
is shuffled. What is left free in a full bin is closed with tokens cut from the
next document, and the few bins open at the end of a task are cut anew into
sequences of 2048 and of powers of two, so no token of padding is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_type, table
from .tokens import WORDS, encoder, vocabulary

CAPACITY, END, CLASSES = 2048, 1, 64
SCHEMA = "doc_id {0}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


class Packer:
    """The bins of one task. A piece is (doc_id, start, doc_tokens, ids as bytes); memory is that of the open bins.

    Parts of class ``classes`` and beyond share one class, filled until a cut closes the bin.
    """

    def __init__(self, task: int, capacity: int = CAPACITY, classes: int = CLASSES):
        self.capacity, self.classes = capacity, classes
        self.next = task << 32
        self.bins: dict[int, list] = {}
        self.short: list[list] = []  # full bins that wait for tokens
        self.out: list[tuple] = []

    def _close(self, bin_: list) -> None:
        offset = 0
        for doc_id, start, total, ids in bin_:
            self.out.append((doc_id, start, len(ids) // 4, total, self.next, offset, ids))
            offset += len(ids) // 4
        self.next += 1

    def add(self, doc_id, ids: bytes) -> None:
        total, at, size = len(ids) // 4, 0, self.capacity
        piece = lambda n: (doc_id, at, total, ids[4 * at : 4 * (at + n)])
        while self.short and at < total:
            bin_ = self.short[-1]
            free = size - sum(len(p[3]) for p in bin_) // 4
            n = min(free, total - at)
            bin_.append(piece(n))
            at += n
            if n == free:
                self._close(self.short.pop())
        while total - at >= size:
            self._close([piece(size)])
            at += size
        if (rest := total - at) == 0:
            return
        k = min(size // rest, self.classes)
        bin_ = self.bins.setdefault(k, [])
        used = sum(len(p[3]) for p in bin_) // 4
        n = min(rest, size - used)
        bin_.append(piece(n))
        at += n
        used += n
        if used == size:
            self._close(self.bins.pop(k))
        elif k < self.classes and len(bin_) == k:
            self.short.append(self.bins.pop(k))
        if at < total:  # the last class cuts at the bin's end
            self.bins[k] = [piece(total - at)]

    def end(self) -> None:
        """Cuts what is still open into sequences of the capacity, then of powers of two."""
        open_ = [p for b in [*self.short, *(self.bins[k] for k in sorted(self.bins))] for p in b]
        left = sum(len(p[3]) for p in open_) // 4
        sizes = [self.capacity] * (left // self.capacity)
        sizes += [1 << i for i in range(left.bit_length(), -1, -1) if (left % self.capacity) >> i & 1]
        for want in sizes:
            bin_ = []
            while want:
                doc_id, start, total, ids = open_.pop(0)
                n = min(want, len(ids) // 4)
                bin_.append((doc_id, start, total, ids[: 4 * n]))
                if 4 * n < len(ids):
                    open_.insert(0, (doc_id, start + n, total, ids[4 * n :]))
                want -= n
            self._close(bin_)
        self.short, self.bins = [], {}


def _pack(path: str, end: int, id_type: pa.DataType, capacity: int, classes: int, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, tail = encoder(path, keep), np.array([end], "<u4").tobytes()
        packer = Packer(TaskContext.get().partitionId(), capacity, classes)
        types = [id_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

        def flush() -> pa.RecordBatch:
            cols, packer.out = zip(*packer.out), []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = enc.encode(text.as_py()) + tail
                packer.add(doc_id.as_py(), ids)
                size += len(ids)
                if size > 1 << 20 and packer.out:
                    yield flush()
                    size = 0
        packer.end()
        if packer.out:
            yield flush()

    return run


def pack(docs: DataFrame, vocab: str, end: int = END, capacity: int = CAPACITY, classes: int = CLASSES, keep: int = WORDS) -> DataFrame:
    """Pieces of packed sequences of ``docs`` (doc_id, text; null text: empty).

    doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian unsigned 32-bit).
    Every id of a document, its end id too, lies in exactly one piece; repeated rows are packed
    as often as they occur, a null id stays null, and no sequence needs padding.
    The sequence id is the task's number and the bin's within it. ``keep`` bounds the words that a worker remembers.
    """
    id_type = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_pack(vocab, end, arrow_type(docs, "doc_id"), capacity, classes, keep), SCHEMA.format(id_type))


def pieces(docs: DataFrame, keep: int = WORDS) -> DataFrame:
    """Packed pieces with the checksum of their ids in place of the ids; rows as ``pack`` takes them, other columns left out."""
    return pack(docs, vocabulary(), keep=keep).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(table(spark, sf_dir, "documents"))


QUERIES = {"op4_packing": op4_packing}
SQL: dict[str, str] = {}
