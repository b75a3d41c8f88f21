"""Daily series, quarterly panels, smoothing forecasts, elasticities and supply scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import table

#: 95 % quantiles of Student's t by degrees of freedom (fixed values); beyond 30 the normal 1.96.
T95 = {
    1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228, 11: 2.201, 12: 2.179,
    13: 2.160, 14: 2.145, 15: 2.131, 16: 2.120, 17: 2.110, 18: 2.101, 19: 2.093, 20: 2.086, 25: 2.060, 30: 2.042,
}
ALPHAS = [round(0.05 * i, 2) for i in range(1, 20)]
MIN_FIT = 30  # values; a shorter series has no fitted alpha


def keep_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by an explicit order column; a blank last value wins too."""
    w = W.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def calendar(prices: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key, date, close) for every day from each series' first to its last: gaps take the last known price, leading ones the first. Without ``key`` there is one series, of a row a day."""
    key = key or []
    days = prices.groupBy(*key).agg(F.sequence(F.min("date"), F.max("date")).alias("d")).select(*key, F.explode("d").alias("date"))
    w = W.partitionBy(*key or [F.lit(0)]).orderBy("date")
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    filled = F.coalesce(F.last("close", True).over(back), F.first("close", True).over(ahead))
    return days.join(prices, [*key, "date"], "left").select(*key, "date", filled.alias("close"))


def daily_price(spark: SparkSession, d: str) -> DataFrame:
    """Mean order price a day, standing for a market price; an exact sum of cents keeps it alike on any partitioning."""
    orders = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    return orders.groupBy("date").agg((F.sum("cents") / F.count("*") / 100).alias("close"))


def smooth(values: Column, alpha: Column) -> Column:
    """Level of simple exponential smoothing after all values, seeded with the first, and the sum of squared one-step errors."""
    first = F.element_at(values, 1)
    seed = F.struct(first.alias("level"), F.lit(0.0).alias("sse"))

    def step(s: Column, y: Column) -> Column:
        return F.struct((alpha * y + (1 - alpha) * s["level"]).alias("level"), (s["sse"] + (y - s["level"]) * (y - s["level"])).alias("sse"))

    return F.aggregate(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), seed, step)


def best_alpha(held: DataFrame, key: list[str], alphas: Column) -> DataFrame:
    """Per row of (key, v) the alpha of the smallest one-step RMSE among ``alphas``, its level, RMSE and v; ties keep the smallest."""
    grid = held.withColumn("alpha", F.explode(alphas)).withColumn("s", smooth(F.col("v"), F.col("alpha")))
    rmse = F.sqrt(F.col("s.sse") / F.greatest(F.size("v") - 1, F.lit(1)))
    best = grid.groupBy(*key).agg(F.min(F.struct(F.round(rmse, 9).alias("rmse"), "alpha", F.col("s.level").alias("level"), F.size("v").alias("n"), "v")).alias("b"))
    return best.select(*key, "b.*")


def fit_alpha(series: DataFrame, key: list[str], alphas: list[float] = ALPHAS, fine: bool = True) -> DataFrame:
    """Per key the alpha of the smallest one-step RMSE, its level and RMSE. Needs (date, close).

    A second grid in steps of 0.01 lies around the best of ``alphas``; fewer than 30 values give nulls. Without ``fine``, ``alphas`` alone at any length.
    """
    held = series.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "close"))), lambda x: x["close"]).alias("v"))
    best = best_alpha(held, key, F.array(*[F.lit(a) for a in alphas]))
    if not fine:
        return best.drop("v")
    near = F.filter(F.array(*[F.round(F.col("alpha") + 0.01 * i, 2) for i in range(-4, 5)]), lambda a: a.between(ALPHAS[0], ALPHAS[-1]))
    best = best_alpha(best.select(*key, "v", near.alias("near")), key, F.col("near"))
    return best.select(*key, *[F.when(F.col("n") >= MIN_FIT, F.col(c)).alias(c) for c in ("rmse", "alpha", "level")], "n")


def band(level: Column, log_sigma: Column, h: Column) -> tuple[Column, Column]:
    """The 95 % band at h steps: multiplied by exp(plus or minus 1.96 sigma sqrt h)."""
    wide = 1.96 * log_sigma * F.sqrt(h)
    return level * F.exp(-wide), level * F.exp(wide)


def quarterly(spark: SparkSession, d: str) -> DataFrame:
    """Quarter panel of line items: production (quantity), consumption (net value), price (value a unit)."""
    li = table(spark, d, "lineitem").select(F.date_trunc("quarter", "l_shipdate").cast("date").alias("quarter"), "l_quantity", (F.col("l_extendedprice") * 100).cast("decimal(18,0)").alias("c"), (F.col("l_discount") * 100).cast("decimal(5,0)").alias("dp"))
    return li.groupBy("quarter").agg(
        F.sum("l_quantity").alias("production"),
        (F.sum(F.col("c") * (100 - F.col("dp"))).cast("double") / 10000).alias("consumption"),
        (F.sum("c").cast("double") / 100 / F.sum("l_quantity")).alias("price"),
    )


def log_changes(panel: DataFrame, columns: list[str], order: str, key: list[str] | None = None) -> DataFrame:
    """First differences of logarithms of positive complete rows, by key; a panel has a row a key and period."""
    w = W.partitionBy(*key or [F.lit(0)]).orderBy(order)
    held = panel.dropna(subset=columns)
    return held.select(*key or [], order, *[(F.log(c) - F.lag(F.log(c)).over(w)).alias(f"d_{c}") for c in columns]).dropna()


def t95(df: Column) -> Column:
    """Quantile for a number of degrees of freedom: the nearest listed one, the smaller of two; infinite below 1."""
    near = F.array_min(F.array(*[F.struct(F.abs(df - k).alias("d"), F.lit(k).alias("k"), F.lit(v).alias("t")) for k, v in T95.items()]))["t"]
    return F.when(df < 1, F.lit(float("inf"))).when(df > 30, 1.96).otherwise(near)


def slope(rows: DataFrame, y: str, x: str) -> DataFrame:
    """Ordinary least squares of one regressor: slope, se, r2, n and the 95 % interval. Needs three rows for an error."""
    base = rows.agg(F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("n"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"))
    se = F.when(F.col("n") > 2, F.sqrt(F.greatest((F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")) / (F.col("n") - 2), F.lit(0.0)) / F.col("sxx"))).otherwise(F.lit(float("inf")))
    base = base.withColumn("se", se)
    t = t95(F.col("n") - 2)
    return base.select("slope", "se", "r2", "n", (F.col("slope") - t * F.col("se")).alias("low"), (F.col("slope") + t * F.col("se")).alias("high"))


def instrument_ratio(rows: DataFrame, y: str, x: str, z: str) -> DataFrame:
    """Wald estimate cov(y, z) / cov(x, z); null with fewer than six rows or a covariance near 0."""
    base = rows.agg(F.covar_samp(y, z).alias("a"), F.covar_samp(x, z).alias("b"), F.count("*").alias("n"))
    return base.select(F.when((F.col("n") >= 6) & (F.abs("b") >= 1e-12), F.col("a") / F.col("b")).alias("elasticity"), "n")


def horizon_elasticity(days: Column, short: float, long: float, start: int = 90, end: int = 1825) -> Column:
    """Linear from the short-run to the long-run elasticity over the horizon, flat outside."""
    share = F.least(F.greatest((days - start) / (end - start), F.lit(0.0)), F.lit(1.0))
    return short + (long - short) * share


def multiplier(share: Column, elasticity: Column) -> Column:
    """Price factor of a change of supply by ``share``: (1 + share) ^ (1 / elasticity); an error unless the elasticity is negative and supply stays positive."""
    good = (elasticity < 0) & (1 + share > 0)
    return F.when(good, F.pow(1 + share, 1 / elasticity)).otherwise(F.raise_error(F.lit("elasticity must be negative and supply positive")))


def vintages(rows: DataFrame, key: str, ties: tuple[str, ...] = ("value",)) -> DataFrame:
    """One row a key: the latest actual value, else the latest projection; a null vintage counts as the latest. Of one vintage the smallest of ``ties`` is taken."""
    w = W.partitionBy(key).orderBy(F.col("actual").desc(), F.col("vintage").desc_nulls_first(), *ties)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def q_calendar(spark: SparkSession, d: str) -> DataFrame:
    return calendar(daily_price(spark, d)).select("date", F.round("close", 6).alias("close"))


def q_keep_last(spark: SparkSession, d: str) -> DataFrame:
    return keep_last(table(spark, d, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


def q_log_diff(spark: SparkSession, d: str) -> DataFrame:
    return log_changes(quarterly(spark, d), ["production", "consumption", "price"], "quarter").select("quarter", *[F.round(f"d_{c}", 6).alias(f"d_{c}") for c in ("production", "consumption", "price")])


def q_slope(spark: SparkSession, d: str) -> DataFrame:
    rows = log_changes(quarterly(spark, d), ["production", "consumption", "price"], "quarter")
    return slope(rows, "d_consumption", "d_production").select(*[F.round(c, 6).alias(c) for c in ("slope", "se", "r2", "low", "high")], "n")


def q_iv(spark: SparkSession, d: str) -> DataFrame:
    rows = log_changes(quarterly(spark, d), ["production", "consumption", "price"], "quarter")
    return instrument_ratio(rows, "d_consumption", "d_price", "d_production").select(F.round("elasticity", 6).alias("elasticity"), "n")


def daily_value(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("date")).agg((F.sum(F.round(F.col("value") * 10000).cast("bigint")) / 10000 / F.count("*")).alias("close"))


def q_alpha(spark: SparkSession, d: str) -> DataFrame:
    """The coarse grid alone, as in its SQL."""
    return fit_alpha(daily_value(spark, d), ["event_type"], fine=False).select("event_type", F.round("rmse", 6).alias("rmse"), "alpha", F.round("level", 6).alias("level"), "n")


def q_alpha_fit(spark: SparkSession, d: str) -> DataFrame:
    """The whole fit: both grids, and nulls for short series."""
    return fit_alpha(daily_value(spark, d), ["event_type"]).select("event_type", F.round("rmse", 6).alias("rmse"), "alpha", F.round("level", 6).alias("level"), "n")


def q_scenario(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier's share of line quantity taken away, priced at the one-year elasticity."""
    li = table(spark, d, "lineitem")
    total = li.agg(F.sum("l_quantity").alias("all"))
    own = li.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q")).crossJoin(F.broadcast(total))
    share = -F.col("q") / F.col("all")
    return own.select("l_suppkey", F.round(multiplier(share, horizon_elasticity(F.lit(365), -0.31, -0.9)), 9).alias("multiplier"))


def q_vintage(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), (F.col("o_orderstatus") == "F").alias("actual"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderkey")).alias("vintage"), F.col("o_totalprice").alias("value"))
    return vintages(o, "day")


_Q = """p AS (SELECT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS quarter, sum(l_quantity) AS production,
  CAST(sum(CAST(l_extendedprice * 100 AS DECIMAL(18,0)) * (100 - CAST(l_discount * 100 AS DECIMAL(5,0)))) AS DOUBLE) / 10000 AS consumption,
  CAST(sum(CAST(l_extendedprice * 100 AS DECIMAL(18,0))) AS DOUBLE) / 100 / sum(l_quantity) AS price FROM lineitem GROUP BY 1),
g AS (SELECT quarter, ln(production) - lag(ln(production)) OVER w AS d_production, ln(consumption) - lag(ln(consumption)) OVER w AS d_consumption,
  ln(price) - lag(ln(price)) OVER w AS d_price FROM p WINDOW w AS (ORDER BY quarter)), c AS (SELECT * FROM g WHERE d_price IS NOT NULL)"""
_LEVELS = "[list_reduce(v[1:i], lambda x, y: alpha * y + (1 - alpha) * x) FOR i IN range(1, len(v) + 1)]"
_RMSE = "sqrt(list_sum([(v[i] - lv[i - 1]) ** 2 FOR i IN range(2, len(v) + 1)]) / greatest(len(v) - 1, 1))"
SQL = {
    "calendar_fill": """
      WITH o AS (SELECT CAST(o_orderdate AS DATE) AS date, sum(CAST(round(o_totalprice * 100) AS BIGINT)) / count(*) / 100 AS close FROM orders GROUP BY 1),
      d AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM o)
      SELECT date, round(coalesce(last_value(close IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), first_value(close IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS close
      FROM d LEFT JOIN o USING (date)""",
    "dedup_keep_last": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "log_diff": f"WITH {_Q} SELECT quarter, round(d_production, 6) AS d_production, round(d_consumption, 6) AS d_consumption, round(d_price, 6) AS d_price FROM c",
    "ols_slope": f"""
      WITH {_Q}, r AS (SELECT regr_slope(d_consumption, d_production) AS slope, regr_r2(d_consumption, d_production) AS r2, count(*) AS n,
        sqrt((regr_syy(d_consumption, d_production) - regr_sxy(d_consumption, d_production) ** 2 / regr_sxx(d_consumption, d_production)) / (count(*) - 2) / regr_sxx(d_consumption, d_production)) AS se FROM c),
      t AS (SELECT *, CASE WHEN n - 2 > 30 THEN 1.96 ELSE (SELECT t FROM (VALUES {", ".join(f"({k}, {v})" for k, v in T95.items())}) q(k, t) ORDER BY abs(k - (n - 2)), k LIMIT 1) END AS q FROM r)
      SELECT round(slope, 6) AS slope, round(se, 6) AS se, round(r2, 6) AS r2, round(slope - q * se, 6) AS low, round(slope + q * se, 6) AS high, n FROM t""",
    "iv_elasticity": f"WITH {_Q} SELECT round(covar_samp(d_consumption, d_production) / covar_samp(d_price, d_production), 6) AS elasticity, count(*) AS n FROM c",
    "alpha_grid": f"""
      WITH s AS (SELECT event_type, CAST(ts AS DATE) AS date, sum(CAST(round(value * 10000) AS BIGINT)) / 10000 / count(*) AS close FROM events GROUP BY 1, 2),
      v AS (SELECT event_type, list(close ORDER BY date) AS v FROM s GROUP BY 1),
      a AS (SELECT unnest({ALPHAS}) :: DOUBLE AS alpha),
      l AS (SELECT event_type, alpha, v, [list_reduce(v[1:i], lambda x, y: alpha * y + (1 - alpha) * x) FOR i IN range(1, len(v) + 1)] AS lv FROM v, a),
      e AS (SELECT event_type, alpha, lv[len(v)] AS level, len(v) AS n, round(sqrt(list_sum([(v[i] - lv[i - 1]) ** 2 FOR i IN range(2, len(v) + 1)]) / greatest(len(v) - 1, 1)), 9) AS rmse FROM l)
      SELECT event_type, round(rmse, 6) AS rmse, alpha, round(level, 6) AS level, n FROM e QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY rmse, alpha) = 1""",
    "alpha_fit": f"""
      WITH s AS (SELECT event_type, CAST(ts AS DATE) AS date, sum(CAST(round(value * 10000) AS BIGINT)) / 10000 / count(*) AS close FROM events GROUP BY 1, 2),
      v AS (SELECT event_type, list(close ORDER BY date) AS v FROM s GROUP BY 1),
      c AS (SELECT event_type, v, alpha, {_RMSE} AS rmse FROM (SELECT *, {_LEVELS} AS lv FROM (SELECT *, unnest([round(0.05 * i, 2) FOR i IN range(1, 20)]) AS alpha FROM v))),
      b AS (SELECT event_type, v, alpha AS a0 FROM c QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY round(rmse, 9), alpha) = 1),
      f AS (SELECT event_type, v, alpha, lv, {_RMSE} AS rmse FROM (SELECT *, {_LEVELS} AS lv FROM (SELECT *, unnest([round(a0 + 0.01 * i, 2) FOR i IN range(-4, 5)]) AS alpha FROM b)) WHERE alpha BETWEEN 0.05 AND 0.95),
      w AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY round(rmse, 9), alpha) = 1)
      SELECT event_type, CASE WHEN len(v) >= 30 THEN round(rmse, 6) END AS rmse, CASE WHEN len(v) >= 30 THEN alpha END AS alpha, CASE WHEN len(v) >= 30 THEN round(lv[len(v)], 6) END AS level, len(v) AS n FROM w""",
    "supply_scenario": """
      SELECT l_suppkey, round(pow(1 - sum(l_quantity) / (SELECT sum(l_quantity) FROM lineitem), 1 / (-0.31 + (-0.9 + 0.31) * (365 - 90) / (1825.0 - 90))), 9) AS multiplier FROM lineitem GROUP BY 1""",
    "vintage_select": """
      SELECT CAST(o_orderdate AS DATE) AS day, o_orderstatus = 'F' AS actual, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderkey END AS vintage, o_totalprice AS value FROM orders
      QUALIFY row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderstatus = 'F' DESC, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderkey END DESC NULLS FIRST, o_totalprice) = 1""",
}
QUERIES = {
    "calendar_fill": q_calendar, "dedup_keep_last": q_keep_last, "log_diff": q_log_diff, "ols_slope": q_slope, "iv_elasticity": q_iv,
    "alpha_grid": q_alpha, "alpha_fit": q_alpha_fit, "supply_scenario": q_scenario, "vintage_select": q_vintage,
}
