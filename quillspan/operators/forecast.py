"""Smoothing forecasts with bands, their back-test, supply scenarios and second opinions."""

from __future__ import annotations

from datetime import timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import on_workers, table
from .series import MIN_FIT, band, daily_value, fit_alpha, horizon_elasticity, multiplier

ALPHA = 0.3  # of a series too short for a fit
WORLD_SUPPLY = 102.0  # million barrels a day
ELASTICITY, ELASTICITY_LONG, ELASTICITY_EDGE = -0.31, -0.9, -0.2
STALE_DAYS = 7


def sample_sigma(n: Column, total: Column, squares: Column) -> Column:
    """Standard deviation of n values by their sums, over n - 1; 0 for fewer than two."""
    return F.when(n >= 2, F.sqrt(F.greatest((squares - total * total / n) / (n - 1), F.lit(0.0)))).otherwise(F.lit(0.0))


def residuals(values: Column, alpha: Column) -> Column:
    """level, s and ss of simple exponential smoothing: its level after all values, the sum and the sum of squares of one-step errors."""
    seed = F.struct(F.element_at(values, 1).alias("level"), F.lit(0.0).alias("s"), F.lit(0.0).alias("ss"))

    def step(a: Column, y: Column) -> Column:
        e = y - a["level"]
        return F.struct((alpha * y + (1 - alpha) * a["level"]).alias("level"), (a["s"] + e).alias("s"), (a["ss"] + e * e).alias("ss"))

    return F.aggregate(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), seed, step)


def smoothing(held: DataFrame, alpha: Column) -> DataFrame:
    """``held`` (v: values in order) with level, sigma of the one-step errors, log_sigma of those of logarithms, and n. Values of 0 or less give log_sigma 0."""
    n = F.size("v") - 1
    plain, logs = residuals(F.col("v"), alpha), residuals(F.transform("v", lambda x: F.log(x)), alpha)
    out = held.withColumn("a", plain).withColumn("b", F.when(F.array_min("v") > 0, logs))
    log_sigma = F.coalesce(sample_sigma(n, F.col("b.s"), F.col("b.ss")), F.lit(0.0))
    return out.select(*held.columns, F.col("a.level").alias("level"), sample_sigma(n, F.col("a.s"), F.col("a.ss")).alias("sigma"), log_sigma.alias("log_sigma"), F.size("v").alias("n"))


def forecast(series: DataFrame, key: list[str], horizon: int) -> DataFrame:
    """(key, date, forecast, lower, upper) of the ``horizon`` days after each series (date, close), and what they rest on.

    Alpha is fitted by both grids, or 0.3 below 30 values. The forecast is flat; the 95 % band widens with the root of the days.
    Series of one value have no forecast; a horizon below 1 is an error.
    """
    if horizon < 1:
        raise ValueError("the horizon is at least one day")
    fitted = fit_alpha(series, key).select(*key, "alpha")
    held = series.groupBy(*key).agg(F.max("date").alias("last"), F.transform(F.array_sort(F.collect_list(F.struct("date", "close"))), lambda x: x["close"]).alias("v"))
    held = held.where(F.size("v") >= 2).join(fitted, key).select(*key, "last", "v", F.coalesce("alpha", F.lit(ALPHA)).alias("alpha"), F.col("alpha").isNotNull().alias("fitted"))
    rows = smoothing(held, F.col("alpha")).drop("v").withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    low, high = band(F.col("level"), F.col("log_sigma"), F.col("h"))
    return rows.select(*key, F.date_add("last", F.col("h")).alias("date"), F.col("level").alias("forecast"), low.alias("lower"), high.alias("upper"), "alpha", "fitted", "sigma", "n")


SHORTEST, EDGE, ROUNDS, POINTS, WIDEST, FINE = 10, 0.98, 20, 4, 0.96, 0.004  # values of a model at least; the search: bound, rounds, points to a side, first and last half width


def innovations(x: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> dict[str, np.ndarray]:
    """The exact Gaussian likelihood of an ARMA(1, 1) model of ``x``, for many coefficients at once: what is lost (the likelihood with the best
    variance, to be least), var, and the next value that is expected. One pass carries the expectation and its variance, as a Kalman filter does."""
    r = (1 + 2 * phi * theta + theta * theta) / (1 - phi * phi)
    ahead, ss, logs = np.zeros_like(phi), np.zeros_like(phi), np.zeros_like(phi)
    for value in x:
        e = value - ahead
        ss, logs = ss + e * e / r, logs + np.log(r)
        ahead, r = phi * value + theta / r * e, 1 + theta * theta - theta * theta / r
    var = ss / len(x)
    return {"lost": len(x) * np.log(np.maximum(var, 1e-300)) + logs, "var": var, "next": ahead}


def expected(x: np.ndarray, phi: float, theta: float) -> np.ndarray:
    """What the model expects each value of ``x`` to be by those before it: one pass, as in ``innovations``."""
    r, ahead, out = (1 + 2 * phi * theta + theta * theta) / (1 - phi * phi), 0.0, []
    for value in x.tolist():
        out.append(ahead)
        ahead, r = phi * value + theta / r * (value - ahead), 1 + theta * theta - theta * theta / r
    return np.array(out)


def likeliest(x: np.ndarray) -> tuple[float, float, bool]:
    """phi, theta and whether the search ended: nine values of each around the best so far, half as far apart in each round, or moved where the best lies at their edge."""
    p = t = 0.0
    half, inside = WIDEST, False
    for _ in range(ROUNDS):
        steps = half / POINTS * np.arange(-POINTS, POINTS + 1)
        phi, theta = (g.ravel() for g in np.meshgrid(np.round(p + steps, 10), np.round(t + steps, 10), indexing="ij"))
        ok = (abs(phi) <= EDGE) & (abs(theta) <= EDGE)
        phi, theta = phi[ok], theta[ok]
        best = np.lexsort((theta, phi, np.round(innovations(x, phi, theta)["lost"], 9)))[0]
        inside = bool(max(abs(phi[best] - p), abs(theta[best] - t)) < half - 1e-9)
        p, t = float(phi[best]), float(theta[best])
        if inside:
            if half < FINE:
                return p, t, True
            half /= 2
    return p, t, False


def _arima_rows(key: list[str], horizon: int):
    names = [*key, "date", "forecast", "lower", "upper", "phi", "theta", "converged", "in_logs", "sigma", "n"]

    def run(series: pa.Table) -> pa.Table:
        rows = sorted(zip(series["date"].to_pylist(), series["close"].to_pylist()))
        values = np.array([c for _, c in rows], float)
        logs = bool(values.min() > 0)
        y = np.log(values) if logs else values
        x = np.diff(y)
        phi, theta, converged = likeliest(x)
        at = innovations(x, np.array([phi]), np.array([theta]))
        told = y[:-1] + expected(x, phi, theta)
        left = values[1:] - (np.exp(told) if logs else told)
        j = np.arange(horizon)
        weight = 1 + (phi + theta) * (1 - phi**j) / (1 - phi)
        wide = 1.96 * np.sqrt(at["var"][0] * np.cumsum(weight**2))
        level = y[-1] + at["next"][0] * (1 - phi ** (j + 1)) / (1 - phi)
        out = [np.exp(v) if logs else v for v in (level, level - wide, level + wide)]
        n = len(j)
        columns = [*(series[k].slice(0, 1).take(pa.array([0] * n)) for k in key), pa.array([rows[-1][0] + timedelta(int(i) + 1) for i in j], pa.date32()), *(pa.array(v) for v in out)]
        columns += [pa.array([c] * n) for c in (phi, theta, converged, logs, float(left.std(ddof=1)))] + [pa.array([len(values)] * n, pa.int64())]
        return pa.table(dict(zip(names, columns)))

    return run


def arima(series: DataFrame, key: list[str], horizon: int) -> DataFrame:
    """(key, date, forecast, lower, upper, phi, theta, converged, in_logs, sigma, n): an ARIMA(1, 1, 1) model by maximum likelihood, for the ``horizon`` days after each series (date, close).

    It is fitted to log prices, or to prices where one is not positive; ``sigma`` is the deviation of its one-step errors in prices. A search that
    has not ended says so in ``converged``. Series of fewer than ten values, or of equal ones, have no model. A series is one group: as long as its days.
    """
    if horizon < 1:
        raise ValueError("the horizon is at least one day")
    on_workers(series.sparkSession)
    fit = fitness(series, key).where("reason = ''").select(*key)
    rows = series.select(*key, F.col("date").cast("date").alias("date"), F.col("close").cast("double").alias("close")).join(fit, key, "left_semi")
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), "date date, forecast double, lower double, upper double, phi double, theta double, converged boolean, in_logs boolean, sigma double, n long"])
    # A search costs far more than its series has bytes: so many partitions as a shuffle has, which are not merged for being small.
    spread = rows.repartition(int(series.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
    return spread.groupBy(*key).applyInArrow(_arima_rows(key, horizon), schema)


def fitness(series: DataFrame, key: list[str]) -> DataFrame:
    """(key, reason): why a series has no ARIMA model, or nothing."""
    few = F.when(F.count("close") < SHORTEST, F.concat(F.lit("only "), F.count("close").cast("string"), F.lit(f" of {SHORTEST} values")))
    return series.groupBy(*key).agg(F.coalesce(few, F.when(F.min("close") == F.max("close"), "all values are equal"), F.lit("")).alias("reason"))


#: Methods of forecasting by name: each takes (series, key, horizon) and gives (key, date, forecast, lower, upper, sigma, n).
METHODS = {"ses": forecast, "arima": arima}


def by_method(series: DataFrame, key: list[str], horizon: int, method: str = "auto") -> DataFrame:
    """(key, date, forecast, lower, upper, sigma, n, method, reason) by a method of METHODS. ``auto`` prefers ARIMA; where it has no model, smoothing
    takes its place and ``reason`` says why. A method that is asked for by name is never replaced; an unknown one is an error."""
    shared = [*key, "date", "forecast", "lower", "upper", "sigma", "n"]
    if method != "auto":
        if method not in METHODS:
            raise ValueError(f"no method of this name: {method}")
        return METHODS[method](series, key, horizon).select(*shared, F.lit(method).alias("method"), F.lit("").alias("reason"))
    why = fitness(series, key)
    first = arima(series, key, horizon).select(*shared, F.lit("arima").alias("method"), F.lit("").alias("reason"))
    rest = series.join(why.where("reason <> ''").select(*key), key, "left_semi")
    other = forecast(rest, key, horizon).join(why, key).select(*shared, F.lit("ses").alias("method"), "reason")
    return first.unionByName(other)


def chosen_elasticity(measured: DataFrame, literature: float = ELASTICITY) -> DataFrame:
    """(key, elasticity, measured): the measured one where it is of use, else that of the literature."""
    good = F.coalesce("usable", F.lit(False))
    return measured.select("key", F.when(good, F.col("value")).otherwise(F.lit(literature)).alias("elasticity"), good.alias("measured"))


#: All alphas that the two grids of a fit can lead to; every fifth is of the coarse one.
LATTICE = np.round(0.05 + 0.01 * np.arange(91), 2)


def _back_test(key: list[str], first: int, horizon: int, step: int):
    """One pass over a series with the errors of all alphas: after each value both grids are read off, as if the series ended there."""

    def run(series: pa.Table) -> pa.Table:
        v = np.array([c for _, c in sorted(zip(series["date"].to_pylist(), series["close"].to_pylist()))], float)
        logs = np.log(np.where(v > 0, v, 1.0))
        level, log_level = np.full(91, v[0]), np.full(91, logs[0])
        sse, log_s, log_ss = np.zeros(91), np.zeros(91), np.zeros(91)
        windows = inside = 0
        for n in range(1, len(v) - horizon):
            if n > 1:
                e, f = v[n - 1] - level, logs[n - 1] - log_level
                sse, log_s, log_ss = sse + e * e, log_s + f, log_ss + f * f
                level, log_level = level + LATTICE * e, log_level + LATTICE * f
            if n < first or (n - first) % step:
                continue
            at = int(np.flatnonzero(LATTICE == ALPHA)[0])
            if n >= MIN_FIT:
                rmse = np.round(np.sqrt(sse / max(n - 1, 1)), 9)
                coarse = 5 * int(rmse[::5].argmin())
                low = max(coarse - 4, 0)
                at = low + int(rmse[low : coarse + 5].argmin())
            k = n - 1
            sigma = np.sqrt(max((log_ss[at] - log_s[at] ** 2 / k) / (k - 1), 0.0)) if k >= 2 and v[:n].min() > 0 else 0.0
            wide = 1.96 * sigma * np.sqrt(horizon)
            windows += 1
            inside += int(level[at] * np.exp(-wide) <= v[n + horizon - 1] <= level[at] * np.exp(wide))
        return pa.table({**{k: series[k].slice(0, 1) for k in key}, "windows": pa.array([windows], pa.int64()), "inside": pa.array([inside], pa.int64())})

    return run


def coverage(series: DataFrame, key: list[str], first: int, horizon: int, step: int = 1) -> DataFrame:
    """(key, windows, inside, share): of forecasts made after ``first`` values, and each ``step`` values on, how many hold the value ``horizon`` days later. Each series is read once."""
    on_workers(series.sparkSession)
    rows = series.select(*key, "date", F.col("close").cast("double").alias("close"))
    kinds = dict(rows.dtypes)
    done = rows.groupBy(*key).applyInArrow(_back_test(key, first, horizon, step), ", ".join([*(f"`{k}` {kinds[k]}" for k in key), "windows long, inside long"])).where("windows > 0")
    return done.withColumn("share", F.col("inside") / F.col("windows"))


def under_scenario(rows: DataFrame, change: Column, days: Column, edge: float = ELASTICITY_EDGE) -> DataFrame:
    """Forecast rows under a change of supply (million barrels a day): the line moves by the elasticity of the horizon, the band's end on the
    side of the stronger answer by ``edge``. No change leaves rows as they are."""
    share = change / WORLD_SUPPLY
    central = multiplier(share, horizon_elasticity(days, ELASTICITY, ELASTICITY_LONG))
    outer = multiplier(share, F.lit(edge))
    return rows.withColumns({"forecast": F.col("forecast") * central, "lower": F.col("lower") * F.least(central, outer), "upper": F.col("upper") * F.greatest(central, outer)})


def envelope(near: DataFrame, far: DataFrame, key: list[str]) -> DataFrame:
    """Point of the near end of a range of scenarios, point_high of the far end, and the band over both."""
    other = far.select(*key, F.col("forecast").alias("point_high"), F.col("lower").alias("__l"), F.col("upper").alias("__u"))
    return near.join(other, key).select(*key, F.col("forecast").alias("point"), "point_high", F.least("lower", "__l").alias("lower"), F.greatest("upper", "__u").alias("upper"))


def second_opinion(mine: DataFrame, theirs: DataFrame, key: list[str]) -> DataFrame:
    """By how many percent another method's forecast differs at the last common date of each key."""
    last = mine.groupBy(*key).agg(F.max_by("forecast", "date").alias("mine"))
    other = theirs.groupBy(*key).agg(F.max_by("forecast", "date").alias("theirs"))
    return last.join(other, key).withColumn("gap", (F.col("theirs") - F.col("mine")) / F.col("mine") * 100)


def staleness(last: Column, today: Column, limit: int = STALE_DAYS) -> Column:
    """behind and note of the date, a text, on which a series ends: the days that it lags if they are more than the limit, and what to say of it.

    A date that cannot be read is told, as nobody knows how old it is; a fresh one, or no limit, gives an empty note.
    """
    day = F.try_to_date(last)
    behind = F.when(F.date_diff(today, day) > limit, F.date_diff(today, day))
    late = F.when(behind.isNotNull(), F.concat(behind.cast("string"), F.lit(" days behind")))
    note = F.when(day.isNull(), F.concat(F.lit("no date: "), F.coalesce(last, F.lit("none")))).otherwise(F.coalesce(late, F.lit("")))
    on = F.lit(limit > 0)
    return F.struct(F.when(on, behind).alias("behind"), F.when(on, note).otherwise("").alias("note"))


def q_forecast(spark: SparkSession, d: str) -> DataFrame:
    out = forecast(daily_value(spark, d), ["event_type"], 10)
    return out.select("event_type", "date", *[F.round(c, 6).alias(c) for c in ("forecast", "lower", "upper", "sigma")], "alpha", "fitted", "n")


def q_arima(spark: SparkSession, d: str) -> DataFrame:
    out = arima(daily_value(spark, d), ["event_type"], 7)
    return out.select("event_type", "date", *[F.round(c, 3).alias(c) for c in ("forecast", "lower", "upper", "phi", "theta")], "converged", "in_logs", "n")


def q_methods(spark: SparkSession, d: str) -> DataFrame:
    """The method of each user's days and why: users of few days, or of the same value on each, have no ARIMA model."""
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("date"), F.when(F.col("user_id") % 9 == 0, F.lit(5.0)).otherwise(F.col("value")).alias("close"))
    rows = e.where("user_id % 5 <> 0 OR day(date) % 5 = 0").groupBy("user_id", "date").agg(F.max("close").alias("close"))
    out = by_method(rows, ["user_id"], 2)
    return out.groupBy("user_id", "method", "reason").agg(F.max("n").alias("n"), F.min("date").alias("from"), F.count("*").alias("days"))


def q_coverage(spark: SparkSession, d: str) -> DataFrame:
    return coverage(daily_value(spark, d), ["event_type"], 8, 3).withColumn("share", F.round("share", 6))


def q_range(spark: SparkSession, d: str) -> DataFrame:
    """A cut by two to three million barrels a day, at the last of 10 days."""
    rows = forecast(daily_value(spark, d), ["event_type"], 10)
    last = rows.join(rows.groupBy("event_type").agg(F.max("date").alias("date")), ["event_type", "date"])
    both = [under_scenario(last, F.lit(x), F.lit(10)) for x in (-2.0, -3.0)]
    return envelope(*both, ["event_type"]).select("event_type", *[F.round(c, 6).alias(c) for c in ("point", "point_high", "lower", "upper")])


def q_second(spark: SparkSession, d: str) -> DataFrame:
    """The smoothed forecast beside one that keeps the last value."""
    rows = daily_value(spark, d)
    naive = rows.groupBy("event_type").agg(F.max("date").alias("date"), F.max_by("close", "date").alias("forecast"))
    return second_opinion(forecast(rows, ["event_type"], 5), naive, ["event_type"]).select("event_type", *[F.round(c, 6).alias(c) for c in ("mine", "theirs", "gap")])


def q_stale(spark: SparkSession, d: str) -> DataFrame:
    """Users whose last event lies more than a week before the last of all; some days are no days, some are missing."""
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"))
    rows = e.groupBy("user_id").agg(F.max("day").alias("last_day")).crossJoin(F.broadcast(e.agg(F.max("day").alias("today"))))
    last = F.when(F.col("user_id") % 10 == 3, F.date_format("last_day", "yyyy-MM-99")).when(F.col("user_id") % 10 != 7, F.col("last_day").cast("string"))
    return rows.select("user_id", last.alias("last_day"), F.col("today")).select("user_id", "last_day", staleness(F.col("last_day"), F.col("today")).alias("s")).select("user_id", "last_day", "s.*")


_LEVELS = "[list_reduce(v[1:i], lambda x, y: alpha * y + (1 - alpha) * x) FOR i IN range(1, len(v) + 1)]"
_SSE = "list_sum([(v[i] - lv[i - 1]) ** 2 FOR i IN range(2, len(v) + 1)])"
_SERIES = """s AS (SELECT event_type, CAST(ts AS DATE) AS date, sum(CAST(round(value * 10000) AS BIGINT)) / 10000 / count(*) AS close FROM events GROUP BY 1, 2),
  v AS (SELECT event_type, list(close ORDER BY date) AS v, max(date) AS last FROM s GROUP BY 1)"""


def fit_sql(key: str, source: str) -> str:
    """Steps c1 to f2 that fit alpha by both grids to the lists v of ``source``; f2 has key, v, alpha and fitted."""
    return f"""c1 AS (SELECT *, {_LEVELS} AS lv FROM (SELECT *, unnest([round(0.05 * i, 2) FOR i IN range(1, 20)]) AS alpha FROM {source})),
  c2 AS (SELECT * FROM c1 QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY round(sqrt({_SSE} / greatest(len(v) - 1, 1)), 9), alpha) = 1),
  f1 AS (SELECT *, {_LEVELS} AS lv FROM (SELECT * EXCLUDE (lv, alpha), unnest(list_filter([round(alpha + 0.01 * i, 2) FOR i IN range(-4, 5)], lambda a: a >= 0.05 AND a <= 0.95)) AS alpha FROM c2)),
  f2 AS (SELECT * EXCLUDE (lv, alpha), CASE WHEN len(v) >= 30 THEN alpha ELSE 0.3 END AS alpha, len(v) >= 30 AS fitted FROM f1
    QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY round(sqrt({_SSE} / greatest(len(v) - 1, 1)), 9), alpha) = 1)"""


_SMOOTH = f"""w AS (SELECT * EXCLUDE (v), v AS raw, unnest([v, list_transform(v, lambda x: ln(x))]) AS v, unnest(['plain', 'log']) AS kind FROM f2),
  l AS (SELECT *, {_LEVELS} AS lv FROM w), e AS (SELECT *, [v[i] - lv[i - 1] FOR i IN range(2, len(v) + 1)] AS r FROM l),
  sg AS (SELECT *, CASE WHEN len(r) >= 2 THEN list_stddev_samp(r) ELSE 0 END AS sd FROM e)"""
_ROWS = f"""{_SERIES}, {fit_sql("event_type", "v")}, {_SMOOTH},
  b AS (SELECT p.event_type, p.last, p.alpha, p.fitted, p.lv[len(p.v)] AS level, p.sd AS sigma, len(p.v) AS n, q.sd AS ls FROM sg p JOIN sg q USING (event_type) WHERE p.kind = 'plain' AND q.kind = 'log'),
  o AS (SELECT event_type, CAST(last + h AS DATE) AS date, level AS forecast, level * exp(-1.96 * ls * sqrt(h)) AS lower, level * exp(1.96 * ls * sqrt(h)) AS upper, sigma, alpha, fitted, n, h FROM b, (SELECT CAST(unnest(range(1, 11)) AS INTEGER) AS h))"""
_M = "pow(1 + {x} / 102.0, 1 / {e})"


def _arima_sql() -> str:
    """The search for the likeliest coefficients, round by round: candidates (c), their likelihood (l), and the best with its next half width (b)."""
    zero = "CAST(0 AS DOUBLE)"
    walk = """list_reduce(list_prepend({'v': CAST(0 AS DOUBLE), 'a': CAST(0 AS DOUBLE), 'r': (1 + 2 * phi * theta + theta * theta) / (1 - phi * phi), 's': CAST(0 AS DOUBLE), 'l': CAST(0 AS DOUBLE)}, x),
      lambda w, z: {'v': z.v, 'a': phi * z.v + theta / w.r * (z.v - w.a), 'r': 1 + theta * theta - theta * theta / w.r, 's': w.s + (z.v - w.a) ** 2 / w.r, 'l': w.l + ln(w.r)})"""
    steps = [
        f"""x AS MATERIALIZED (SELECT event_type, last, len(v) AS n, ln(v[len(v)]) AS y, [{{'v': ln(v[i]) - ln(v[i - 1]), 'a': {zero}, 'r': {zero}, 's': {zero}, 'l': {zero}}} FOR i IN range(2, len(v) + 1)] AS x FROM v WHERE len(v) >= {SHORTEST})""",
        f"b0 AS MATERIALIZED (SELECT event_type, {zero} AS p, {zero} AS t, CAST({WIDEST} AS DOUBLE) AS half, FALSE AS done FROM x)",
    ]
    for n in range(ROUNDS):
        steps += [
            f"""c{n} AS (SELECT event_type, p, t, half, done, phi, round(t + half / {POINTS} * j, 10) AS theta FROM (SELECT *, round(p + half / {POINTS} * unnest(range(-{POINTS}, {POINTS + 1})), 10) AS phi FROM b{n}), range(-{POINTS}, {POINTS + 1}) k(j) WHERE abs(phi) <= {EDGE} AND abs(round(t + half / {POINTS} * j, 10)) <= {EDGE} AND NOT done)""",
            f"l{n} AS (SELECT c.*, {walk} AS w, len(x) AS m FROM c{n} c JOIN x USING (event_type))",
            f"""b{n + 1} AS MATERIALIZED (SELECT event_type, phi AS p, theta AS t, CASE WHEN greatest(abs(phi - p), abs(theta - t)) < half - 1e-9 AND half >= {FINE} THEN half / 2 ELSE half END AS half,
              greatest(abs(phi - p), abs(theta - t)) < half - 1e-9 AND half < {FINE} AS done FROM l{n} QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY round(m * ln(greatest(w.s / m, 1e-300)) + w.l, 9), phi, theta) = 1
              UNION ALL SELECT * FROM b{n} WHERE done)""",
        ]
    return f"""WITH {_SERIES}, {", ".join(steps)}, f AS (SELECT event_type, last, n, y, p AS phi, t AS theta, done, x FROM b{ROUNDS} JOIN x USING (event_type)), g AS (SELECT *, {walk} AS w FROM f),
      h AS (SELECT *, (1 - phi ** h) / (1 - phi) AS k, list_sum([(1 + (phi + theta) * (1 - phi ** j) / (1 - phi)) ** 2 FOR j IN range(0, h)]) AS u FROM g, (SELECT CAST(unnest(range(1, 8)) AS INTEGER) AS h)),
      o AS (SELECT *, y + w.a * k AS m, 1.96 * sqrt(w.s / (n - 1) * u) AS e FROM h)
      SELECT event_type, CAST(last + h AS DATE) AS date, round(exp(m), 3) AS forecast, round(exp(m - e), 3) AS lower, round(exp(m + e), 3) AS upper, round(phi, 3) AS phi, round(theta, 3) AS theta, done AS converged, TRUE AS in_logs, n FROM o"""


SQL = {
    "forecast_rows": f"WITH {_ROWS} SELECT event_type, date, round(forecast, 6) AS forecast, round(lower, 6) AS lower, round(upper, 6) AS upper, round(sigma, 6) AS sigma, alpha, fitted, n FROM o",
    "arima_rows": _arima_sql(),
    "forecast_methods": """
      WITH r AS (SELECT user_id, CAST(ts AS DATE) AS date, max(CASE WHEN user_id % 9 = 0 THEN 5.0 ELSE value END) AS close FROM events WHERE user_id % 5 <> 0 OR day(ts) % 5 = 0 GROUP BY 1, 2),
      g AS (SELECT user_id, count(*) AS n, max(date) AS last, CASE WHEN count(*) < 10 THEN 'only ' || count(*) || ' of 10 values' WHEN min(close) = max(close) THEN 'all values are equal' ELSE '' END AS reason FROM r GROUP BY 1)
      SELECT user_id, CASE WHEN reason = '' THEN 'arima' ELSE 'ses' END AS method, reason, n, CAST(last + 1 AS DATE) AS "from", CAST(2 AS BIGINT) AS days FROM g WHERE n > 1""",
    "band_coverage": f"""
      WITH {_SERIES}, k AS (SELECT event_type, cut, v[1:cut] AS v, v[cut + 3] AS actual FROM (SELECT *, unnest(range(8, len(v) - 3)) AS cut FROM v)), {fit_sql("event_type, cut", "k")}, {_SMOOTH},
      b AS (SELECT p.event_type, p.actual, p.lv[len(p.v)] AS level, q.sd AS ls FROM sg p JOIN sg q USING (event_type, cut) WHERE p.kind = 'plain' AND q.kind = 'log'),
      i AS (SELECT event_type, actual BETWEEN level * exp(-1.96 * ls * sqrt(3)) AND level * exp(1.96 * ls * sqrt(3)) AS held FROM b)
      SELECT event_type, count(*) AS windows, count(*) FILTER (WHERE held) AS inside, round(count(*) FILTER (WHERE held) / count(*), 6) AS share FROM i GROUP BY 1""",
    "scenario_range": f"""
      WITH {_ROWS}, t AS (SELECT * FROM o WHERE h = 10), m AS (SELECT *, {_M.format(x="-2", e="-0.31")} AS c2, {_M.format(x="-3", e="-0.31")} AS c3, {_M.format(x="-2", e="-0.2")} AS e2, {_M.format(x="-3", e="-0.2")} AS e3 FROM t)
      SELECT event_type, round(forecast * c2, 6) AS point, round(forecast * c3, 6) AS point_high, round(least(lower * least(c2, e2), lower * least(c3, e3)), 6) AS lower,
        round(greatest(upper * greatest(c2, e2), upper * greatest(c3, e3)), 6) AS upper FROM m""",
    "second_opinion": f"""
      WITH {_ROWS}, n AS (SELECT event_type, arg_max(close, date) AS theirs FROM s GROUP BY 1)
      SELECT event_type, round(forecast, 6) AS mine, round(theirs, 6) AS theirs, round((theirs - forecast) / forecast * 100, 6) AS gap FROM o JOIN n USING (event_type) WHERE h = 5""",
    "stale_series": """
      WITH u AS (SELECT user_id, CAST(max(ts) AS DATE) AS day FROM events GROUP BY 1), t AS (SELECT CAST(max(ts) AS DATE) AS today FROM events),
      b AS (SELECT user_id, day, CASE WHEN user_id % 10 NOT IN (3, 7) AND date_diff('day', day, today) > 7 THEN date_diff('day', day, today) END AS behind FROM u, t)
      SELECT user_id, CASE user_id % 10 WHEN 3 THEN strftime(day, '%Y-%m-99') WHEN 7 THEN NULL ELSE CAST(day AS VARCHAR) END AS last_day, behind,
        CASE user_id % 10 WHEN 3 THEN 'no date: ' || strftime(day, '%Y-%m-99') WHEN 7 THEN 'no date: none' ELSE coalesce(behind || ' days behind', '') END AS note FROM b""",
}
QUERIES = {"arima_rows": q_arima, "forecast_methods": q_methods, "forecast_rows": q_forecast, "band_coverage": q_coverage, "scenario_range": q_range, "second_opinion": q_second, "stale_series": q_stale}
