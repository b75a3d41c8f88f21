"""A training corpus from raw documents: five stages, each written as Parquet and read again.

The first four return rows of ``documents`` with its columns; the last one packs what is left. In all of them a null
text counts as empty, rows are known by id and text (so rows that share an id are told apart), other columns stay as they are, and an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspan.llm import decontaminate, exact_dedup, near_dedup, packing, toxicity
from quillspan.llm.shared import on_workers, stored, table


#: Words that a worker remembers in the last stage: its memory also holds what the stages before have left.
KEEP = 100_000


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, does not reject; repeated rows are judged alike."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then that of the smallest id; of rows equal in id and text one stays."""
    on_workers(spark)
    return exact_dedup.drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the smallest id. Documents without words or with a null id stay."""
    on_workers(spark)
    return near_dedup.drop_near(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in benchmark items; those without words stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 2048-token sequences that hold every id of what is left, of repeated rows as often as they come."""
    on_workers(spark)
    return packing.pieces(docs, KEEP)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("exact dedup", exact),
    ("near dedup", near),
    ("decontamination", clean),
    ("packing", packed),
]

#: A trained classifier, random signatures and a tokenizer: tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
