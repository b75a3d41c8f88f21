"""Histories of conversations as keyed state of a stream: after each turn, the latest turns that fit a budget."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.tables import on_workers, shared_folder, table

BUDGET, CAP = 2500, 1000  # characters of a history, and of a turn in it
TURNS = "conv_id long, turn long, role string, text string"
OUT = "conv_id long, turn long, kept array<long>, spent long"
STATE = "turns array<long>, sizes array<long>"


def within(sizes: list[tuple[int, int]], budget: int) -> list[tuple[int, int]]:
    """The latest of (turn, size) whose sizes sum to the budget at most; the last one always stays, none with a budget of 0 or less."""
    kept, spent = [], 0
    for turn, size in reversed(sizes):
        if budget <= 0 or (kept and spent + size > budget):
            break
        kept.append((turn, size))
        spent += size
    return kept[::-1]


def _fold(budget: int, cap: int, ttl_ms: int | None):
    """State of a conversation: numbers and sizes of the turns that its history holds. Turns older than what is held come too late to enter it."""

    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        new = sorted((int(t), min(len(x or ""), cap)) for part in rows for t, x in zip(part["turn"], part["text"]))
        held, out = list(zip(*state.get)) if state.exists else [], []
        for turn, size in new:
            if held and turn < held[0][0]:
                continue
            held = within(sorted([*held, (turn, size)]), budget)
            out.append((key[0], turn, [t for t, _ in held], sum(n for _, n in held)))
        state.update(([t for t, _ in held], [n for _, n in held]))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "kept", "spent"])

    return run


def histories(stream: DataFrame, budget: int = BUDGET, cap: int = CAP, ttl_ms: int | None = None) -> DataFrame:
    """(conv_id, turn, kept, spent) for each turn of a stream (conv_id, turn, text): the turns that are held after it. State unused for ``ttl_ms`` is forgotten."""
    on_workers(stream.sparkSession)
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return stream.groupBy("conv_id").applyInPandasWithState(_fold(budget, cap, ttl_ms), OUT, STATE, "append", timeout)


def follow(spark: SparkSession, source: str, target: str, checkpoint: str, files: int = 1, budget: int = BUDGET, cap: int = CAP) -> None:
    """Histories of all turns in files below ``source`` that the checkpoint does not know, appended to ``target``, ``files`` a batch in order of time.

    It ends when all is read, so no state is forgotten here: a stream with ``ttl_ms`` never ends, as it waits for what may time out.
    """
    stream = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", files).parquet(source)
    done = histories(stream, budget, cap).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    done.awaitTermination()


def q_history(spark: SparkSession, d: str) -> DataFrame:
    """Turns come in three files, those of one conversation spread over all; the third after a restart."""
    conv, home = table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), shared_folder(spark, "histories")
    for part in (["turn < 2"], ["turn BETWEEN 2 AND 3", "turn > 3"]):
        for where in part:
            conv.where(where).coalesce(1).write.mode("append").parquet(f"{home}/turns")
        follow(spark, f"{home}/turns", f"{home}/out", f"{home}/checkpoint")
    return spark.read.schema(OUT).parquet(f"{home}/out").select("conv_id", "turn", F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept"), "spent")


SQL = {
    "stream_history": """
      WITH c AS (SELECT conv_id, turn, least(length(text), 1000) AS n, sum(least(length(text), 1000)) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM conversations)
      SELECT a.conv_id, a.turn, string_agg(b.turn, ',' ORDER BY b.turn) AS kept, CAST(sum(b.n) AS BIGINT) AS spent FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn <= a.turn AND (a.s - b.s + b.n <= 2500 OR a.turn = b.turn) GROUP BY 1, 2""",
}
QUERIES = {"stream_history": q_history}
