"""Quarterly factors from report tables: cells, vintages, elasticities, and the price path they imply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import table
from .forecast import chosen_elasticity, sample_sigma
from .series import daily_price, t95, vintages, vintages

#: Rows of the balance table by their number (fixed values of the report's layout).
ROWS = {0: "production", 10: "consumption", 24: "stock_change", 28: "inventories"}
MIN_QUARTERS, NEAREST_DAYS = 6, 120


def cell_number(cell: Column) -> Column:
    """The number in a table cell: thousands commas go, any dash before digits is a minus; dashes, NA, NM and junk are null, not 0."""
    text = F.translate(F.regexp_replace(F.trim(cell), ",", ""), "−–", "--")
    return F.when(~text.isin("", "-", "--", "NA", "NM"), text.try_cast("double"))


def quarter_end(label: Column) -> Column:
    """Last day of the quarter that a label such as 2026Q1 names; null for a year or anything else."""
    parts = lambda i: F.regexp_extract(F.trim(label), r"^(\d{4})Q([1-4])$", i)
    return F.when(parts(1) != "", F.last_day(F.make_date(parts(1).try_cast("int"), parts(2).try_cast("int") * 3, F.lit(1))))


def vintage_of(path: Column) -> Column:
    """First day of the month that a file's name holds, as in REPORT_2026-07.pdf; null without one, or for no month of a year."""
    name = F.substring_index(path, "/", -1)
    parts = lambda i: F.regexp_extract(name, r"(\d{4})-(\d{2})", i)
    return F.when(parts(2).try_cast("int").between(1, 12), F.make_date(parts(1).try_cast("int"), parts(2).try_cast("int"), F.lit(1)))


def report_factors(cells: DataFrame) -> DataFrame:
    """(path, vintage, quarter_end, actual, factors) of reports' balance tables from their cells (path, row_no, label, cell).

    Annual columns are left out. A quarter is actual if it ended before the report's month; without a month none is.
    """
    rows = cells.select("path", "row_no", quarter_end(F.col("label")).alias("quarter_end"), cell_number(F.col("cell")).alias("x")).where("quarter_end IS NOT NULL")
    out = rows.groupBy("path", "quarter_end").agg(*[F.max(F.when(F.col("row_no") == n, F.col("x"))).alias(name) for n, name in ROWS.items()])
    vintage = vintage_of(F.col("path"))
    return out.select("path", vintage.alias("vintage"), "quarter_end", F.coalesce(F.col("quarter_end") < vintage, F.lit(False)).alias("actual"), *ROWS.values())


def latest(observations: DataFrame) -> DataFrame:
    """One row a quarter: of the latest vintage in which it is actual, else of the latest one, as in ``vintages``."""
    return vintages(observations, "quarter_end", tuple(sorted(ROWS.values())))


def projection_errors(observations: DataFrame) -> DataFrame:
    """(n, sigma) of log actual less log projected production, of projections for a quarter at most 120 days ahead; sigma is null below three."""
    w = W.partitionBy("quarter_end").orderBy(F.col("vintage").desc(), "production")
    known = observations.where("actual").withColumn("__n", F.row_number().over(w)).where("__n = 1").select("quarter_end", F.col("production").alias("truth"))
    near = observations.where(~F.col("actual") & (F.date_diff("quarter_end", "vintage") <= NEAREST_DAYS) & (F.col("production") > 0))
    e = near.join(known.where("truth > 0"), "quarter_end").select((F.log("truth") - F.log("production")).alias("e"))
    sums = e.agg(F.count("*").alias("n"), F.sum("e").alias("s"), F.sum(F.col("e") * F.col("e")).alias("ss"))
    return sums.select("n", F.when(F.col("n") >= 3, sample_sigma(F.col("n"), F.col("s"), F.col("ss"))).alias("sigma"))


def changes(panel: DataFrame) -> DataFrame:
    """(key, quarter_end, dP, dS, dC, dI): changes between complete quarters of each key: logarithms of price, production and consumption,
    and inventories as days of consumption. Panel: key, quarter_end, price, production, consumption, inventories."""
    held = panel.dropna(subset=["price", "production", "consumption", "inventories"])
    w = W.partitionBy("key").orderBy("quarter_end")
    step = lambda c: F.log(c) - F.lag(F.log(c)).over(w)
    stock = (F.col("inventories") - F.lag("inventories").over(w)) / F.col("consumption") / 91.0
    return held.select("key", "quarter_end", step("price").alias("dP"), step("production").alias("dS"), step("consumption").alias("dC"), stock.alias("dI")).where("dS IS NOT NULL")


def _line(y: str, x: str) -> list[Column]:
    """Slope of y on x and its standard error, by key."""
    n = F.count("*")
    b = F.regr_slope(y, x)
    rest = F.greatest(F.regr_syy(y, x) - b * F.regr_sxy(y, x), F.lit(0.0))
    return [b.alias(f"b_{y}"), F.sqrt(rest / (n - 2) / F.regr_sxx(y, x)).alias(f"se_{y}")]


def clearing_elasticity(d: DataFrame) -> DataFrame:
    """(key, value, low, high, usable, n): 1 over the slope of price on supply, with the slope's 95 % interval turned over.

    An interval of the slope that holds 0 leaves the ends infinite. Usable: negative, and so is its high end. Fewer than six changes give none.
    """
    base = d.groupBy("key").agg(F.count("*").alias("n"), *_line("dP", "dS")).where((F.col("n") >= MIN_QUARTERS) & (F.abs("b_dP") >= 1e-12))
    t = t95(F.col("n") - 2)
    base = base.withColumns({"lo": F.col("b_dP") - t * F.col("se_dP"), "hi": F.col("b_dP") + t * F.col("se_dP")})
    open_ = (F.col("lo") < 0) & (F.col("hi") > 0)
    base = base.withColumns({"value": 1 / F.col("b_dP"), "low": F.when(open_, float("-inf")).otherwise(F.least(1 / F.col("lo"), 1 / F.col("hi"))), "high": F.when(open_, float("inf")).otherwise(F.greatest(1 / F.col("lo"), 1 / F.col("hi")))})
    return base.select("key", "value", "low", "high", usable(F.col("value"), F.col("high")).alias("usable"), "n")


def demand_elasticity(d: DataFrame) -> DataFrame:
    """(key, value, low, high, usable, r2, n): the Wald estimate with supply as instrument; its interval adds the relative errors of both slopes (delta method)."""
    r2 = F.regr_r2("dP", "dS").alias("r2")
    base = d.groupBy("key").agg(F.count("*").alias("n"), F.covar_samp("dC", "dS").alias("a"), F.covar_samp("dP", "dS").alias("b"), r2, *_line("dC", "dS"), *_line("dP", "dS"))
    base = base.where((F.col("n") >= MIN_QUARTERS) & (F.abs("b") >= 1e-12) & (F.abs("b_dP") >= 1e-12)).withColumn("value", F.col("a") / F.col("b"))
    relative = F.when(F.col("b_dC") != 0, F.hypot(F.col("se_dC") / F.col("b_dC"), F.col("se_dP") / F.col("b_dP"))).otherwise(float("inf"))
    spread = F.abs("value") * relative * t95(F.col("n") - 2)
    return base.select("key", "value", (F.col("value") - spread).alias("low"), (F.col("value") + spread).alias("high"), usable(F.col("value"), F.col("value") + spread).alias("usable"), "r2", "n")


def usable(value: Column, high: Column) -> Column:
    """An elasticity is of use if it and the high end of its interval are negative."""
    return (value < 0) & (high < 0)


def price_response(d: DataFrame) -> DataFrame:
    """(key, intercept, supply, inventory, sigma, r2, n) of price changes on changes of supply and inventories; sigma over n - 3.

    Inventories that stand still have coefficient 0. Fewer than six changes give none.
    """
    pairs = [("dS", "dP"), ("dI", "dP"), ("dS", "dI")]
    base = d.groupBy("key").agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in ("dP", "dS", "dI")], *[F.var_samp(c).alias(f"v_{c}") for c in ("dP", "dS", "dI")], *[F.covar_samp(a, b).alias(f"c_{a}{b}") for a, b in pairs]
    )
    still = F.sqrt("v_dI") < 1e-12
    det = F.col("v_dS") * F.col("v_dI") - F.col("c_dSdI") * F.col("c_dSdI")
    supply = F.when(still, F.col("c_dSdP") / F.col("v_dS")).otherwise((F.col("c_dSdP") * F.col("v_dI") - F.col("c_dIdP") * F.col("c_dSdI")) / det)
    stock = F.when(still, 0.0).otherwise((F.col("c_dIdP") * F.col("v_dS") - F.col("c_dSdP") * F.col("c_dSdI")) / det)
    base = base.where(F.col("n") >= MIN_QUARTERS).withColumns({"supply": supply, "inventory": stock})
    rest = F.greatest(F.col("v_dP") - F.col("supply") * F.col("c_dSdP") - F.col("inventory") * F.col("c_dIdP"), F.lit(0.0))
    return base.select(
        "key", (F.col("m_dP") - F.col("supply") * F.col("m_dS") - F.col("inventory") * F.col("m_dI")).alias("intercept"), "supply", "inventory",
        F.sqrt(rest * (F.col("n") - 1) / (F.col("n") - 3)).alias("sigma"), (1 - rest / F.col("v_dP")).alias("r2"), "n",
    )


def price_path(projected: DataFrame, model: DataFrame, anchor: DataFrame, error: Column) -> DataFrame:
    """(key, date, forecast, lower, upper) for each day from the anchor to the last projected quarter.

    ``projected`` has the changes dS and dI of quarters to come, ``model`` what ``price_response`` gives, ``anchor`` key, date and close of
    the last known price, ``error`` the sigma of projected production (null: none). Log prices add up by quarter, from the anchor, to the
    first change that is no number, and run straight between quarters; errors of model and projection add up at right angles, with the root of the quarters.
    """
    w = W.partitionBy("key").orderBy("quarter_end")
    change = F.col("intercept") + F.col("supply") * F.col("dS") + F.col("inventory") * F.col("dI")
    steps = projected.join(model, "key").withColumn("change", change)
    steps = steps.withColumn("bad", F.max(F.col("change").isNull() | F.isnan("change")).over(w)).where("NOT bad")
    steps = steps.withColumns({"sum": F.sum("change").over(w.rowsBetween(W.unboundedPreceding, 0)), "k": F.row_number().over(w).cast("double")})
    step_sigma = F.hypot("sigma", F.col("supply") * F.coalesce(error, F.lit(0.0)))
    at = steps.join(anchor, "key").select("key", "quarter_end", (F.log("close") + F.col("sum")).alias("y"), "k", step_sigma.alias("s"), "date", F.log("close").alias("y0"))
    before = lambda c, first: F.coalesce(F.lag(c).over(w), first)
    legs = at.select("key", "quarter_end", "y", "k", "s", before("quarter_end", F.col("date")).alias("d0"), before("y", F.col("y0")).alias("from_y"), before("k", F.lit(0.0)).alias("from_k"))
    days = legs.where("quarter_end > d0").withColumn("date", F.explode(F.sequence(F.date_add("d0", 1), "quarter_end")))
    share = F.date_diff("date", "d0") / F.date_diff("quarter_end", "d0")
    log_price = F.col("from_y") + share * (F.col("y") - F.col("from_y"))
    wide = 1.96 * F.col("s") * F.sqrt(F.col("from_k") + share * (F.col("k") - F.col("from_k")))
    return days.select("key", "date", F.exp(log_price).alias("forecast"), F.exp(log_price - wide).alias("lower"), F.exp(log_price + wide).alias("upper"))


# ---- Stand-ins from line items: brands are markets, their quarters factors ------------------


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Factors of each brand and quarter; inventories are the running sum of what came back less what stayed away."""
    li = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("key")), "l_partkey")
    q = F.last_day(F.add_months(F.date_trunc("quarter", "l_shipdate"), 2)).alias("quarter_end")
    qty = F.col("l_quantity")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    p = li.groupBy("key", q).agg(
        F.sum("l_quantity").alias("production"), F.sum(F.when(F.col("l_returnflag") != "A", qty)).alias("consumption"), (F.sum(cents) / 100 / F.sum("l_quantity")).alias("price"),
        F.sum(F.when(F.col("l_returnflag") == "R", qty).when(F.col("l_returnflag") == "A", -qty).otherwise(0)).alias("net"),
    )
    return p.withColumn("inventories", F.sum("net").over(W.partitionBy("key").orderBy("quarter_end").rowsBetween(W.unboundedPreceding, 0))).drop("net")


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Quarters of line items as reported four months before to four months after they shipped; some reports have no month."""
    li = table(spark, d, "lineitem")
    vintage = F.when(F.col("l_orderkey") % 13 != 0, F.trunc(F.add_months(F.col("l_shipdate").cast("date"), (F.col("l_orderkey") % 9).cast("int") - 4), "month"))
    q = F.last_day(F.add_months(F.date_trunc("quarter", "l_shipdate"), 2))
    rows = li.groupBy(q.alias("quarter_end"), vintage.alias("vintage")).agg(F.sum("l_quantity").alias("production"), F.sum("l_linenumber").cast("double").alias("consumption"))
    return rows.select("vintage", "quarter_end", F.coalesce(F.col("quarter_end") < F.col("vintage"), F.lit(False)).alias("actual"), "production", "consumption", F.lit(None).cast("double").alias("stock_change"), F.lit(None).cast("double").alias("inventories"))


def q_report(spark: SparkSession, d: str) -> DataFrame:
    """Cells are line items' sums as reports print them, with thousands commas, dashes for nothing, and a column a year beside those of quarters."""
    li = table(spark, d, "lineitem").where("l_linenumber <= 4")
    year, month = F.year("l_shipdate"), F.month("l_shipdate")
    label = F.explode(F.array(F.concat(year.cast("string"), F.lit("Q"), F.quarter("l_shipdate").cast("string")), year.cast("string"))).alias("label")
    path = F.concat(F.lit("/in/REPORT_"), F.date_format("l_shipdate", "yyyy"), F.lit("-0"), (1 + month % 9).cast("string"), F.lit(".pdf")).alias("path")
    number = F.element_at(F.array(*[F.lit(n) for n in ROWS]), F.col("l_linenumber")).alias("row_no")
    sums = li.select(path, label, number, "l_quantity").groupBy("path", "label", "row_no").agg(F.sum("l_quantity").alias("x"))
    cell = F.when(F.col("x") % 7 == 0, "–").when(F.col("row_no") == 24, F.concat(F.lit("−"), F.format_number("x", 1))).otherwise(F.format_number("x", 1))
    return report_factors(sums.withColumn("cell", cell))


def q_latest(spark: SparkSession, d: str) -> DataFrame:
    return latest(observations(spark, d)).select("quarter_end", "vintage", "actual", "production", "consumption")


def q_errors(spark: SparkSession, d: str) -> DataFrame:
    return projection_errors(observations(spark, d)).select("n", F.round("sigma", 6).alias("sigma"))


def q_clearing(spark: SparkSession, d: str) -> DataFrame:
    return clearing_elasticity(changes(panel(spark, d))).select("key", *[F.round(c, 4).alias(c) for c in ("value", "low", "high")], "usable", "n")


def q_chosen(spark: SparkSession, d: str) -> DataFrame:
    return chosen_elasticity(clearing_elasticity(changes(panel(spark, d)))).withColumn("elasticity", F.round("elasticity", 4))


def q_demand(spark: SparkSession, d: str) -> DataFrame:
    return demand_elasticity(changes(panel(spark, d))).select("key", *[F.round(c, 4).alias(c) for c in ("value", "low", "high", "r2")], "usable", "n")


def q_response(spark: SparkSession, d: str) -> DataFrame:
    return price_response(changes(panel(spark, d))).select("key", *[F.round(c, 5).alias(c) for c in ("intercept", "supply", "inventory", "sigma", "r2")], "n")


def q_path(spark: SparkSession, d: str) -> DataFrame:
    """Quarters of 2000 are projections; the price is anchored on the last known day of 1999."""
    moves = changes(panel(spark, d))
    model = price_response(moves.where("quarter_end < '2000-01-01'"))
    last = daily_price(spark, d).where("date < '2000-01-01'").agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"))
    anchor = model.select("key").crossJoin(F.broadcast(last))
    path = price_path(moves.where("quarter_end BETWEEN '2000-01-01' AND '2000-12-31'"), model, anchor, F.lit(0.018))
    return path.select("key", "date", *[F.round(c, 3).alias(c) for c in ("forecast", "lower", "upper")])


_PANEL = """p AS (SELECT p_brand AS key, last_day(CAST(date_trunc('quarter', l_shipdate) AS DATE) + INTERVAL 2 MONTH) AS quarter_end, sum(l_quantity) AS production, sum(l_quantity) FILTER (WHERE l_returnflag <> 'A') AS consumption,
    sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100 / sum(l_quantity) AS price, sum(CASE l_returnflag WHEN 'R' THEN l_quantity WHEN 'A' THEN -l_quantity ELSE 0 END) AS net FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
  i AS (SELECT *, sum(net) OVER (PARTITION BY key ORDER BY quarter_end ROWS UNBOUNDED PRECEDING) AS inventories FROM p),
  g AS (SELECT * FROM (SELECT key, quarter_end, ln(price) - lag(ln(price)) OVER w AS dP, ln(production) - lag(ln(production)) OVER w AS dS, ln(consumption) - lag(ln(consumption)) OVER w AS dC,
    (inventories - lag(inventories) OVER w) / consumption / 91 AS dI FROM i WHERE consumption IS NOT NULL WINDOW w AS (PARTITION BY key ORDER BY quarter_end)) WHERE dS IS NOT NULL)"""
_OBS = """o AS (SELECT last_day(CAST(date_trunc('quarter', l_shipdate) AS DATE) + INTERVAL 2 MONTH) AS quarter_end, CASE WHEN l_orderkey % 13 <> 0 THEN CAST(date_trunc('month', CAST(l_shipdate AS DATE) + to_months(CAST(l_orderkey % 9 - 4 AS INTEGER))) AS DATE) END AS vintage,
    sum(l_quantity) AS production, CAST(sum(l_linenumber) AS DOUBLE) AS consumption FROM lineitem GROUP BY 1, 2), v AS (SELECT *, coalesce(quarter_end < vintage, FALSE) AS actual FROM o)"""
#: The quantiles at the degrees of freedom that the tables lead to, beside the normal one (fixed values).
_T = "CASE {n} - 2 WHEN 4 THEN 2.776 WHEN 18 THEN 2.101 WHEN 19 THEN 2.093 WHEN 20 THEN 2.086 WHEN 21 THEN 2.086 WHEN 22 THEN 2.086 WHEN 23 THEN 2.060 WHEN 24 THEN 2.060 WHEN 25 THEN 2.060 WHEN 26 THEN 2.060 WHEN 27 THEN 2.060 END"
_SE = "sqrt(greatest(regr_syy({y}, dS) - regr_sxy({y}, dS) ** 2 / regr_sxx({y}, dS), 0) / (count(*) - 2) / regr_sxx({y}, dS))"


def _response(where: str) -> str:
    """Steps u and m: the two-factor model through the normal equations of centred values."""
    return f"""u AS (SELECT key, count(*) AS n, avg(dP) AS mp, avg(dS) AS ms, avg(dI) AS mi, sum(dS * dS) - count(*) * avg(dS) ** 2 AS ss, sum(dI * dI) - count(*) * avg(dI) ** 2 AS ii, sum(dS * dI) - count(*) * avg(dS) * avg(dI) AS si,
    sum(dS * dP) - count(*) * avg(dS) * avg(dP) AS sp, sum(dI * dP) - count(*) * avg(dI) * avg(dP) AS ip, sum(dP * dP) - count(*) * avg(dP) ** 2 AS pp FROM g WHERE {where} GROUP BY 1 HAVING count(*) >= 6),
  b AS (SELECT *, (sp * ii - ip * si) / (ss * ii - si * si) AS supply, (ip * ss - sp * si) / (ss * ii - si * si) AS inventory FROM u),
  m AS (SELECT key, n, mp - supply * ms - inventory * mi AS intercept, supply, inventory, sqrt((pp - supply * sp - inventory * ip) / (n - 3)) AS sigma, 1 - (pp - supply * sp - inventory * ip) / pp AS r2 FROM b)"""


SQL = {
    "report_factors": """
      WITH l AS (SELECT year(l_shipdate) AS y, month(l_shipdate) AS m, last_day(make_date(year(l_shipdate), 3 * quarter(l_shipdate), 1)) AS quarter_end, l_linenumber AS k, l_quantity FROM lineitem WHERE l_linenumber <= 4),
      s AS (SELECT y, 1 + m % 9 AS v, quarter_end, k, sum(l_quantity) AS x FROM l GROUP BY 1, 2, 3, 4),
      c AS (SELECT *, CASE WHEN x % 7 = 0 THEN NULL WHEN k = 3 THEN -x ELSE x END AS z FROM s)
      SELECT '/in/REPORT_' || y || '-0' || v || '.pdf' AS path, make_date(y, v, 1) AS vintage, quarter_end, quarter_end < make_date(y, v, 1) AS actual, max(z) FILTER (WHERE k = 1) AS production,
        max(z) FILTER (WHERE k = 2) AS consumption, max(z) FILTER (WHERE k = 3) AS stock_change, max(z) FILTER (WHERE k = 4) AS inventories FROM c GROUP BY 1, 2, 3, 4""",
    "latest_factors": f"WITH {_OBS} SELECT quarter_end, vintage, actual, production, consumption FROM v QUALIFY row_number() OVER (PARTITION BY quarter_end ORDER BY actual DESC, vintage DESC NULLS FIRST, consumption) = 1",
    "projection_errors": f"""
      WITH {_OBS}, t AS (SELECT quarter_end, arg_max(production, vintage) AS truth FROM v WHERE actual GROUP BY 1)
      SELECT count(*) AS n, round(stddev_samp(ln(truth) - ln(production)), 6) AS sigma FROM v JOIN t USING (quarter_end) WHERE NOT actual AND quarter_end - vintage <= 120""",
    "clearing_elasticity": f"""
      WITH {_PANEL}, e AS (SELECT key, count(*) AS n, regr_slope(dP, dS) AS b, {_SE.format(y="dP")} AS se FROM g GROUP BY 1 HAVING count(*) >= 6),
      f AS (SELECT *, b - {_T.format(n="n")} * se AS lo, b + {_T.format(n="n")} * se AS hi FROM e),
      r AS (SELECT key, n, 1 / b AS value, CASE WHEN lo < 0 AND hi > 0 THEN '-inf'::DOUBLE ELSE least(1 / lo, 1 / hi) END AS low, CASE WHEN lo < 0 AND hi > 0 THEN 'inf'::DOUBLE ELSE greatest(1 / lo, 1 / hi) END AS high FROM f)
      SELECT key, round(value, 4) AS value, round(low, 4) AS low, round(high, 4) AS high, value < 0 AND high < 0 AS usable, n FROM r""",
    "demand_elasticity": f"""
      WITH {_PANEL}, e AS (SELECT key, count(*) AS n, regr_slope(dC, dS) AS bc, regr_slope(dP, dS) AS bp, regr_r2(dP, dS) AS r2, {_SE.format(y="dC")} AS sc, {_SE.format(y="dP")} AS sp FROM g GROUP BY 1 HAVING count(*) >= 6),
      f AS (SELECT *, bc / bp AS value, abs(bc / bp) * sqrt((sc / bc) ** 2 + (sp / bp) ** 2) * {_T.format(n="n")} AS w FROM e)
      SELECT key, round(value, 4) AS value, round(value - w, 4) AS low, round(value + w, 4) AS high, round(r2, 4) AS r2, value < 0 AND value + w < 0 AS usable, n FROM f""",
    "price_response": f"WITH {_PANEL}, {_response('true')} SELECT key, round(intercept, 5) AS intercept, round(supply, 5) AS supply, round(inventory, 5) AS inventory, round(sigma, 5) AS sigma, round(r2, 5) AS r2, n FROM m",
    "factor_path": f"""
      WITH {_PANEL}, {_response("quarter_end < DATE '2000-01-01'")},
      a AS (SELECT max(date) AS d, arg_max(close, date) AS c FROM (SELECT CAST(o_orderdate AS DATE) AS date, sum(CAST(round(o_totalprice * 100) AS BIGINT)) / count(*) / 100 AS close FROM orders GROUP BY 1) WHERE date < DATE '2000-01-01'),
      k AS (SELECT key, quarter_end AS x, ln(c) + sum(intercept + supply * dS + inventory * dI) OVER w AS y, CAST(row_number() OVER w AS DOUBLE) AS q, sqrt(sigma ** 2 + (supply * 0.018) ** 2) AS s
            FROM g JOIN m USING (key), a WHERE quarter_end BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' WINDOW w AS (PARTITION BY key ORDER BY quarter_end)),
      z AS (SELECT key, x, y, q, s FROM k UNION ALL SELECT key, d, ln(c), 0, NULL FROM (SELECT DISTINCT key FROM k), a),
      days AS (SELECT key, CAST(unnest(generate_series(CAST(min(x) AS DATE) + INTERVAL 1 DAY, max(x), INTERVAL 1 DAY)) AS DATE) AS date FROM z GROUP BY 1),
      j AS (SELECT t.key, t.date, l.x AS x0, l.y AS y0, l.q AS q0, (SELECT min(x) FROM z r WHERE r.key = t.key AND r.x >= t.date) AS x1 FROM days t ASOF JOIN z l ON t.key = l.key AND t.date > l.x),
      n AS (SELECT j.key, j.date, y0 + (date - x0) / (x1 - x0) * (r.y - y0) AS p, 1.96 * r.s * sqrt(q0 + (date - x0) / (x1 - x0) * (r.q - q0)) AS h FROM j JOIN z r ON r.key = j.key AND r.x = x1)
      SELECT key, date, round(exp(p), 3) AS forecast, round(exp(p - h), 3) AS lower, round(exp(p + h), 3) AS upper FROM n""",
}
SQL["chosen_elasticity"] = f"WITH c AS ({SQL['clearing_elasticity']}) SELECT key, CASE WHEN usable THEN value ELSE -0.31 END AS elasticity, usable AS measured FROM c"
QUERIES = {
    "chosen_elasticity": q_chosen, "report_factors": q_report, "latest_factors": q_latest, "projection_errors": q_errors, "clearing_elasticity": q_clearing, "demand_elasticity": q_demand, "price_response": q_response, "factor_path": q_path,
}
