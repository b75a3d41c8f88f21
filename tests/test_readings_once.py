"""Items are written once for all readings of a page."""

import random

from pyspark.sql import functions as F

from quillspan.operators import readings
from tests.oracle import SMALL


def test_items_are_written_once(spark):
    plan = readings._readings(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("format_number") == 1 and "format_string(%.1f" in plan


def test_numbers_are_those_of_the_plain_pattern(spark):
    rng, parts = random.Random(7), ["1", "23", "456", ",456", ",", ".", "+", "-", " ", "a", "_", "٣", "é", "x"]
    df = spark.createDataFrame([("".join(rng.choice(parts) for _ in range(rng.randint(1, 12))),) for _ in range(4000)], "s string")
    plain = r"(?U)(?<![\w.])[+-]?\d{1,3}(?:,\d{3})+(?:\.\d+)?(?!\w)|(?U)(?<![\w.])[+-]?\d+(?:\.\d+)?(?!\w)"
    want = F.transform(F.regexp_extract_all("s", F.lit(plain), F.lit(0)), lambda x: F.regexp_replace(x, "[,+]", ""))
    assert df.where(readings.numbers(df.s) != want).count() == 0
