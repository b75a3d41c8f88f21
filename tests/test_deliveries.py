"""A faster way to write numbers, and deliveries cut so that no task gets a large share of them."""

from pyspark.sql import functions as F

from quillspan.functions.text import fixed
from quillspan.streaming import ingest
from tests.oracle import SMALL


def test_fixed_writes_what_the_formatter_writes(spark):
    rows = [(x,) for x in (None, 0.0, -0.0, 0.04, 0.05, 0.45, 1.25, 2.675, 1234567.885, -0.01, -3.25, 1e-9, 999999999999.99, 1e15, float("nan"), float("inf"))]
    for digits in (1, 2):
        held = spark.createDataFrame(rows, "x double").select(fixed(F.col("x"), digits).alias("a"), F.format_string(f"%.{digits}f", "x").alias("b"))
        assert [r for r in held.collect() if r.a != r.b] == []


def test_deliveries_come_in_many_files(spark, monkeypatch):
    seen, plain = [], ingest.ingest

    def counted(spark_, source, *rest):
        seen.append(len(spark_.read.parquet(source).inputFiles()))
        plain(spark_, source, *rest)

    monkeypatch.setattr(ingest, "ingest", counted)
    ingest.q_ingest(spark, SMALL)
    assert seen[0] > 8
