"""Likelihood, fallbacks and back-tests of forecasts, and answers that were wrong before, with the truth made by hand."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.operators import citations, factors, forecast, registers, series


def simulated(n, phi, theta, seed=1):
    rng = np.random.default_rng(seed)
    e, x = rng.normal(size=n + 1), [0.0]
    for t in range(1, n + 1):
        x.append(phi * x[-1] + e[t] + theta * e[t - 1])
    return np.array(x[1:])


@pytest.mark.parametrize(("phi", "theta"), [(0.5, 0.3), (-0.4, 0.7), (0.9, -0.5), (0.0, 0.0)])
def test_likelihood_is_that_of_the_normal_law(phi, theta):
    x = simulated(12, 0.4, 0.2)
    gamma = [(1 + 2 * phi * theta + theta**2) / (1 - phi**2)]
    gamma.append(phi * gamma[0] + theta)
    for _ in range(10):
        gamma.append(phi * gamma[-1])
    cov = np.array([[gamma[abs(i - j)] for j in range(12)] for i in range(12)])
    var = x @ np.linalg.solve(cov, x) / 12
    got = forecast.innovations(x, np.array([phi]), np.array([theta]))
    assert math.isclose(got["var"][0], var) and math.isclose(got["lost"][0], 12 * math.log(var) + np.linalg.slogdet(cov)[1])
    told = np.array(gamma[1:] + [phi * gamma[-1]])[::-1] @ np.linalg.solve(cov, x)
    assert math.isclose(got["next"][0], told, abs_tol=1e-9)


def test_known_coefficients_are_found():
    for phi, theta in ((0.6, 0.25), (-0.5, -0.3)):
        p, t, converged = forecast.likeliest(simulated(40_000, phi, theta))
        assert converged and abs(p - phi) < 0.02 and abs(t - theta) < 0.02


def days(spark, **values):
    rows = [(k, datetime.date(2025, 1, 1) + datetime.timedelta(i), float(x)) for k, v in values.items() for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "k string, date date, close double")


def test_methods_and_reasons(spark):
    rng = random.Random(3)
    walk = [50 + i / 9 + rng.random() for i in range(40)]
    rows = days(spark, walk=walk, below=[x - 60 for x in walk], few=walk[:9], flat=[5] * 30, two=[1, 2])
    got = {(r.k, r.method, r.reason) for r in forecast.by_method(rows, ["k"], 3).collect()}
    assert got == {("walk", "arima", ""), ("below", "arima", ""), ("few", "ses", "only 9 of 10 values"), ("flat", "ses", "all values are equal"), ("two", "ses", "only 2 of 10 values")}
    out = {r.k: r for r in forecast.arima(rows, ["k"], 1).collect()}
    assert set(out) == {"walk", "below"} and out["walk"].in_logs and not out["below"].in_logs and out["walk"].converged
    assert all(r.lower < r.forecast < r.upper and r.sigma > 0 and r.date == datetime.date(2025, 2, 10) for r in out.values()) and out["walk"].lower > 0
    assert {r.method for r in forecast.by_method(rows, ["k"], 1, "ses").collect()} == {"ses"}
    with pytest.raises(ValueError):
        forecast.by_method(rows, ["k"], 1, "factors")
    with pytest.raises(ValueError):
        forecast.arima(rows, ["k"], 0)


def test_back_test_equals_forecasts_of_prefixes(spark):
    rng = random.Random(8)
    value, closes = 80.0, []
    for _ in range(48):
        value *= 1 + rng.gauss(0, 0.02)
        closes.append(round(value, 3))
    first, horizon, step = 20, 4, 3
    (r,) = forecast.coverage(days(spark, w=closes, short=closes[:5]), ["k"], first, horizon, step).collect()
    cuts = range(first, len(closes) - horizon, step)
    made = days(spark, **{f"c{n}": closes[:n] for n in cuts})
    last = {f"c{n}": closes[n + horizon - 1] for n in cuts}
    held = [x.lower <= last[x.k] <= x.upper for x in forecast.forecast(made, ["k"], horizon).where(F.col("date") == F.date_add(F.lit("2025-01-01").cast("date"), F.expr("int(substring(k, 2)) + 3"))).collect()]
    assert (r.k, r.windows, r.inside) == ("w", len(cuts), sum(held)) and len(held) == len(cuts)


def test_median_is_the_upper_middle(spark):
    rows = [("a", ["x"]), ("a", ["x", "y"]), ("b", []), ("b", ["x"]), ("b", ["x", "y", "z"]), ("c", ["x"] * 4)]
    got = {r.g: (r.records, r.untagged, r.median_tags, r.most_tags) for r in registers.tag_summary(spark.createDataFrame(rows, "g string, tags array<string>"), ["g"]).collect()}
    assert got == {"a": (2, 0, 2, 2), "b": (3, 1, 1, 3), "c": (1, 0, 4, 4)}


def test_null_vintage_is_the_latest(spark):
    rows = [("2026-03-31", True, "2026-05-01", 1.0), ("2026-03-31", True, None, 2.0), ("2026-06-30", False, None, 3.0), ("2026-06-30", True, "2026-07-01", 4.0), ("2026-09-30", False, None, 5.0), ("2026-09-30", False, "2026-08-01", 6.0)]
    df = spark.createDataFrame(rows, "quarter_end string, actual boolean, vintage string, production double").select("*", *[F.lit(0.0).alias(c) for c in factors.ROWS.values() if c != "production"])
    assert {r.quarter_end: r.production for r in factors.latest(df).collect()} == {"2026-03-31": 2.0, "2026-06-30": 4.0, "2026-09-30": 5.0}
    one = series.vintages(spark.createDataFrame([(1, True, None, 7.0), (1, True, 3, 8.0)], "k int, actual boolean, vintage int, value double"), "k")
    assert [r.value for r in one.collect()] == [7.0]


def test_unchecked_claims_say_so(spark):
    rows = [("direct",), ("unchecked",), (None,), ("geometry",)]
    made = spark.createDataFrame(rows, "level string").select(citations.claim(F.lit("t"), F.lit("report"), F.lit("S"), F.lit("май 2026"), F.lit(3), F.col("level")).alias("c"))
    bare, told = "t [Отчёт S, май 2026, с. 3]", "t [Отчёт S, май 2026, с. 3; сверка чтения не выполнялась]"
    assert [r.c for r in made.collect()] == [bare, told, told, "t [Отчёт S, май 2026, с. 3; текст собран по геометрии страницы]"]


def test_unreadable_dates_are_told(spark):
    df = spark.createDataFrame([("2026-08-30",), ("2026-08-01",), ("soon",), (None,), ("2026-08-24",)], "d string").select(forecast.staleness(F.col("d"), F.lit("2026-08-31").cast("date")).alias("s"), forecast.staleness(F.col("d"), F.current_date(), 0).alias("off"))
    assert [tuple(r.s) for r in df.collect()] == [(None, ""), (30, "30 days behind"), (None, "no date: soon"), (None, "no date: none"), (None, "")]
    assert {tuple(r.off) for r in df.collect()} == {(None, "")}
