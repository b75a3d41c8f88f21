"""One-step expectations of a series come of one pass, and small series are searched on as many tasks as a shuffle has."""

import numpy as np
from pyspark.sql import functions as F

from quillspan.operators import forecast


def test_expectations_are_those_of_all_beginnings():
    x = np.random.default_rng(4).normal(size=25)
    for phi, theta in ((0.5, 0.3), (-0.9, 0.98), (0.0, 0.0)):
        want = [forecast.innovations(x[:i], np.array([phi]), np.array([theta]))["next"][0] if i else 0.0 for i in range(len(x))]
        assert forecast.expected(x, phi, theta).tolist() == want


def test_small_series_are_spread(spark):
    rows = spark.range(400).select((F.col("id") % 20).alias("k"), F.date_add(F.lit("2025-01-01").cast("date"), (F.col("id") / 20).cast("int")).alias("date"), (50 + F.pmod(F.hash("id"), F.lit(9))).cast("double").alias("close"))
    assert forecast.arima(rows, ["k"], 1).select(F.spark_partition_id().alias("p")).distinct().count() > 1
