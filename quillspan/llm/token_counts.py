"""Token totals by source, language and tokenizer version, kept by signed deltas.

A batch of changes becomes signed rows: an insert adds a document's count, a delete takes back what
the ledger holds for it, a revision does both. The batch's rows and their sums are written
apart, and one marker file, made in one step, commits them; a batch that is sent again, or
that failed half-way, changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WORD, marked, scratch, table
from .tokens import encoder, vocabulary

KEYS = ["source", "lang", "tokenizer"]
CHANGES = ["op", "doc_id", *KEYS, "n_tokens"]


class Rollup:
    """Totals in a folder that Spark can reach.

    ``ledger/`` has signed rows a document, ``sums/`` signed sums a batch, ``commits/`` a marker a batch that
    holds the name of the attempt whose rows count. Null sources, languages and versions are groups of their own.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint"):
        self.spark, self.path = spark, path.rstrip("/")
        self._known: dict[str, str] = {}
        self.ledger_schema = f"doc_id {id_type}, source string, lang string, tokenizer string, docs bigint, tokens bigint"
        self.sums_schema = "source string, lang string, tokenizer string, docs bigint, tokens bigint"

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def committed(self) -> dict[str, str]:
        """The attempt that counts for each committed batch. A marker never changes, so each is read once."""
        fs, path = self._file("commits")
        if not fs.exists(path):
            return {}
        for status in fs.listStatus(path):
            name = status.getPath().getName()
            if not name.startswith(".") and name not in self._known:
                held = self.spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(fs.open(status.getPath()))
                self._known[name] = bytes(held).decode()
        return dict(self._known)

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{kind}/{a}" for a in self.committed().values()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        """What each document counts for now."""
        rows = self._read("ledger", self.ledger_schema).groupBy("doc_id", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return rows.where("docs <> 0 OR tokens <> 0")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies ``changes`` (op, doc_id, source, lang, tokenizer, n_tokens) once; False if the batch is known.

        op is insert, delete or revise; any other raises an error. Deletes and revisions name a document and
        a tokenizer version; what the ledger holds for the pair is taken back, under the source and language it was counted
        for, and a revision adds the new row. Without such a row a delete does nothing and a revision inserts. Each pair
        should occur once in a batch: repeated inserts add up, a repeated delete or revision takes back once.
        A null count is 0.
        """
        if "/" in batch or not batch.strip(".") or batch.startswith("."):
            raise ValueError("a batch name has no / and does not begin with a point")
        if batch in self.committed():
            return False
        attempt = f"{batch}-{uuid.uuid4().hex}"
        op = F.when(F.col("op").isin("insert", "delete", "revise"), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null")))))
        rows = changes.select(op.alias("op"), *CHANGES[1:])
        plus = rows.where("op <> 'delete'").select("doc_id", *KEYS, F.lit(1).cast("bigint").alias("docs"), F.coalesce(F.col("n_tokens"), F.lit(0)).cast("bigint").alias("tokens"))
        signed = plus
        if self.committed():
            back = rows.where("op <> 'insert'").select(F.col("doc_id").alias("i"), F.col("tokenizer").alias("t")).distinct()
            # Of all past rows a filter lets through those of the batch's documents; only they are joined and summed.
            wanted = back.select(F.xxhash64("i", "t").alias("v"))
            past = marked(self._read("ledger", self.ledger_schema), F.xxhash64("doc_id", "tokenizer"), wanted).where("__maybe").drop("__maybe")
            past = past.join(back, past["doc_id"].eqNullSafe(back["i"]) & past["tokenizer"].eqNullSafe(back["t"]), "left_semi")
            old = past.groupBy("doc_id", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")
            signed = plus.unionByName(old.select("doc_id", *KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens")))
        signed.write.parquet(f"{self.path}/ledger/{attempt}")
        written = self.spark.read.schema(self.ledger_schema).parquet(f"{self.path}/ledger/{attempt}")
        written.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{self.path}/sums/{attempt}")
        return self._mark(batch, attempt)

    def _mark(self, batch: str, attempt: str) -> bool:
        """Puts the whole marker in its place by a rename, unless one is there: of writers that race, the first counts."""
        fs, mark = self._file(f"commits/{batch}")
        _, own = self._file(f"commits/.{attempt}")
        out = fs.create(own, False)
        out.write(bytearray(attempt.encode()))
        out.close()
        if not fs.exists(mark):
            fs.rename(own, mark)
        return self.committed().get(batch) == attempt

    def totals(self) -> DataFrame:
        """docs and tokens of every group that is not empty, from the sums of all batches."""
        rows = self._read("sums", self.sums_schema).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return rows.where("docs <> 0 OR tokens <> 0")

    def rollup(self) -> DataFrame:
        """Totals by (source, lang, tokenizer), (source, tokenizer), (lang, tokenizer) and (tokenizer); ``level`` names the set."""
        return self.spark.sql(
            """
          SELECT source, lang, tokenizer, CASE grouping_id(source, lang, tokenizer) WHEN 0 THEN 'source-lang' WHEN 2 THEN 'source' WHEN 4 THEN 'lang' ELSE 'all' END AS level,
                 sum(docs) AS n_docs, sum(tokens) AS n_tokens
          FROM {totals} GROUP BY GROUPING SETS ((source, lang, tokenizer), (source, tokenizer), (lang, tokenizer), (tokenizer))""",
            totals=self.totals(),
        )


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n = np.fromiter((len(enc.encode(x.as_py())) // 4 for x in b.column(3)), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n)], ["doc_id", "source", "lang", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocab: str) -> DataFrame:
    """doc_id, source, lang and n_tokens of every whole text (null: 0) by a public vocabulary. Repeated rows stay, extra columns are left out, and an empty table gives an empty result."""
    id_type = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "source", "lang", "text").mapInArrow(_count(vocab), f"doc_id {id_type}, source string, lang string, n_tokens bigint")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are loaded with word counts, then moved to a subword vocabulary; that batch is sent twice and counts once."""
    docs = table(spark, sf_dir, "documents")
    rollup = Rollup(spark, scratch(spark, "rollup"), dict(docs.dtypes)["doc_id"])
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint")
    loaded = docs.select(F.lit("insert").alias("op"), "doc_id", "source", "lang", F.lit("words/1").alias("tokenizer"), words.alias("n_tokens"))
    rollup.commit("load", loaded)
    gone = docs.select(F.lit("delete").alias("op"), "doc_id", "source", "lang", F.lit("words/1").alias("tokenizer"), F.lit(0).cast("bigint").alias("n_tokens"))
    counted = token_counts(docs, vocabulary()).select(F.lit("insert").alias("op"), "doc_id", "source", "lang", F.lit("word_bpe_49k/1").alias("tokenizer"), "n_tokens")
    moved = gone.unionByName(counted)
    rollup.commit("retokenise", moved)
    rollup.commit("retokenise", moved)
    return rollup.rollup()


QUERIES = {"op9_token_counts": op9_token_counts}
SQL: dict[str, str] = {}
