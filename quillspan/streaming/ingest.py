"""Incremental ingest: new files of documents become chunks in a store, each batch once, whatever is restarted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_id
from ..operators.pages import NAMESPACE, OVERLAP, SIZE, windows
from ..sources.tables import shared_folder, table

DOCUMENTS = "doc_id long, text string"
FILES = 64  # of each delivery at most


def chunked(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id, doc_id, start, stop, text) of the windows over documents (doc_id, text). The id is made of the content, so what comes again has the id that it had."""
    made = windows(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), None, size, overlap)
    start = F.col("start").cast("bigint")
    return made.select(content_id(NAMESPACE, F.col("doc_id"), start, F.col("text")).alias("chunk_id"), "doc_id", start.alias("start"), F.col("stop").cast("bigint").alias("stop"), "text")


class ChunkStore:
    """Chunks by id, in a folder a batch. A batch that is written again replaces its own folder; of an id in several batches the last one counts."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def upsert(self, chunks: DataFrame, batch: int) -> None:
        chunks.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def read(self) -> DataFrame:
        rows = self.spark.read.parquet(self.path)
        rest = [c for c in rows.columns if c not in ("chunk_id", "batch")]
        return rows.groupBy("chunk_id").agg(F.max_by(F.struct(*rest), "batch").alias("r")).select("chunk_id", "r.*")

    def compact(self, upto: int) -> ChunkStore:
        """A store in a new folder that holds everything as one batch, the last that was written."""
        new = ChunkStore(self.spark, shared_folder(self.spark, "chunks"))
        new.upsert(self.read(), upto)
        return new


def ingest(spark: SparkSession, source: str, store: ChunkStore, checkpoint: str, files: int = 100, schema: str = DOCUMENTS) -> None:
    """Takes all files of Parquet documents below ``source`` that the checkpoint does not know, ``files`` a batch, into the store, and ends when there are no more."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    done = stream.writeStream.foreachBatch(lambda docs, batch: store.upsert(chunked(docs), batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    done.awaitTermination()


def q_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Documents in eight parts of up to eight files, so that a task has a 64th of them: five parts are taken in batches of 16 files, then the rest after a restart; some documents come twice."""
    docs, home = table(spark, d, "documents").select("doc_id", "text"), shared_folder(spark, "ingest")
    part, share = F.pmod(F.xxhash64("doc_id"), F.lit(8)), F.pmod(F.xxhash64("doc_id", F.lit("share")), F.lit(8))
    store = ChunkStore(spark, f"{home}/chunks")
    for numbers in (range(5), range(4, 8)):
        docs.where(part.isin(*numbers)).repartition(FILES, part, share).write.mode("append").parquet(f"{home}/documents")
        ingest(spark, f"{home}/documents", store, f"{home}/checkpoint", FILES // 4)
    return store.read().drop("text")


SQL = {
    "stream_ingest": """
      WITH w AS (SELECT doc_id, k * 1000 AS start, least(k * 1000 + 1200, length(text)) AS stop, substr(text, k * 1000 + 1, 1200) AS t
          FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(0, ceil((length(text) - 1200) / 1000)) AS BIGINT) + 1)) AS k FROM documents WHERE text <> '')),
        h AS (SELECT *, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(doc_id || '|' || start || '|' || t)) AS h FROM w)
      SELECT h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8', '9', 'a', 'b'][CAST('0x' || h[17] AS INTEGER) % 4 + 1] || h[18:20] || '-' || h[21:32] AS chunk_id, doc_id, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM h""",
}
QUERIES = {"stream_ingest": q_ingest}
