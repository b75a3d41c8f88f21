"""What questions ask for: horizon, supply scenario, freshness and route, all as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import table

# The words that questions use, as results depend on them.
FRESH = ["сейчас", "сегодня", "вчера", "текущ", "актуальн", "последн", "свеж", "новост", "на данный момент", "котировк", "заявил", "объявил"]
NUMERALS = {
    1: ["один", "одного", "одну"], 2: ["два", "две", "двух", "пару", "пары"], 3: ["три", "трёх", "трех"], 4: ["четыре", "четырёх", "четырех"], 5: ["пять", "пяти"], 6: ["шесть", "шести"],
    7: ["семь", "семи"], 8: ["восемь", "восьми"], 9: ["девять", "девяти"], 10: ["десять", "десяти"], 12: ["двенадцать", "двенадцати"],
}
#: Of a number of periods and of one named alone: the pattern and its days, in the order in which they are tried.
PERIODS = [(r"(\d+)\s*(?:кв|квартал)", 90), (r"(\d+)\s*(?:мес|month)", 30), (r"(\d+)\s*(?:год|лет|года|year)", 365), (r"(\d+)\s*(?:недел|week)", 7), (r"(\d+)\s*(?:дн|день|дней|day)", 1)]
ALONE = [(r"(?U)\bна\s+квартал", 90), (r"(?U)\bна\s+(?:год|году)\b", 365), (r"(?U)\bна\s+месяц\b", 30), (r"(?U)\bна\s+недел", 7)]
NUM, BBL = r"(\d+(?:[  ]\d{3})*(?:[.,]\d+)?)", r"(?:барр\w*|баррел\w*|б\s*/\s*с)"
#: Units of a change of supply: pattern, million barrels a day of one, name.
UNITS = [
    (rf"(?U){NUM}\s*(?:%|процент\w*)", 1.02, "процент"), (rf"(?U){NUM}\s*(?:млн|миллион\w*)\s*\.?\s*{BBL}", 1.0, "млн барр./сут"), (rf"(?U){NUM}\s*(?:тыс\w*|тысяч\w*)\s*\.?\s*{BBL}", 0.001, "тыс. барр./сут"),
    (rf"(?U){NUM}\s*(?:mmb|mb)\s*/?\s*d\b", 1.0, "mb/d"), (rf"(?U){NUM}\s*(?:kb)\s*/?\s*d\b", 0.001, "kb/d"), (rf"(?U){NUM}\s*{BBL}\s*(?:в\s*сутки|/\s*сут\w*|в\s*день)", 1e-6, "барр./сут"),
]
CUT = "сокращ|сократ|снижен|сниз|уменьш|срез|урез|упад|паден|выпаден|потер|выбыт|останов|сверн|cut|reduc|declin|drop"
RAISE = "вырас|выраст|увелич|нараст|наращ|прибав|повыс|рост|подним|добав|rise|increas|grow|boost|raise"
SUPPLY = r"добыч|предложен|производств|поставк|квот|опек|opec|supply|production|output|баррел|барр\b|б\s*/\s*с|mb\s*/?\s*d"
SUPPLY_WORD = f"(?U){SUPPLY}"
HORIZON = r"(?U)\d+(?:[.,]\d+)?\s*(?:кв\b|квартал\w*|мес\w*|month\w*|год\w*|лет\b|year\w*|недел\w*|week\w*|дн\w*|день|day\w*)"
RANGE = rf"(?U)(?:\b(?:с|от)\s*{NUM}\s*(?:до|по)\s+|{NUM}\s*[‒–—−-]\s*)$"
CAP_DAYS, DEFAULT_DAYS = 730, 90


def needs_fresh(question: Column) -> Column:
    """Whether a question is about the present."""
    low = F.lower(question)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in FRESH])


def asked_days(question: Column) -> Column:
    """The horizon that a question names, in days and in no way limited; null for none. Numbers may be words."""
    low = F.lower(question)
    for n, names in NUMERALS.items():
        low = F.regexp_replace(low, rf"(?U)\b(?:{'|'.join(names)})\b", str(n))
    found = [F.regexp_extract(low, p, 1).try_cast("long") * days for p, days in PERIODS]
    return F.coalesce(*found, *[F.when(low.rlike(p), F.lit(days).cast("long")) for p, days in ALONE])


def horizon_days(question: Column, default: int = DEFAULT_DAYS) -> Column:
    """The named horizon or the default, from 1 to 730 days."""
    return F.greatest(F.lit(1).cast("long"), F.least(F.coalesce(asked_days(question), F.lit(default)), F.lit(CAP_DAYS).cast("long")))


def _number(x: Column) -> Column:
    return F.replace(F.regexp_replace(x, "[\\s ]", ""), F.lit(","), F.lit(".")).try_cast("double")


def _before(text: Column, pattern: str) -> Column:
    """The text before the first match of the pattern (with one group); the whole text if there is none."""
    return F.element_at(F.split(text, pattern, 2), 1)


def _matches(text: Column, words: str) -> Column:
    """(before, size) of all matches of the words in a text: the text between a match and the one before it, and the match's length."""
    sizes = F.transform(F.regexp_extract_all(text, F.lit(f"({words})"), F.lit(1)), F.length)
    return F.zip_with(F.split(text, words, -1), sizes, lambda p, n: F.struct(p.alias("before"), n.alias("size")))


def _direction(cut: Column, raised: Column, at: Column) -> Column:
    """-1 or 1 of the word of cutting or raising (``_matches``) nearest to a place, turned by a "не" before it; null without such words. Of two as near, cutting counts."""

    def each(found: Column, sign: int) -> Column:
        # One pass: a match begins where the one before it ended, and its text before it later.
        seed = F.struct(F.lit(0).alias("end"), F.expr("cast(null as struct<d:int,o:int,sign:int>)").alias("best"))

        def step(a: Column, m: Column) -> Column:
            start = a["end"] + F.length(m["before"])
            one = F.struct(F.abs(start - at).alias("d"), F.lit(sign).alias("o"), F.when(m["before"].rlike(r"(?U)\bне\s*$"), -sign).otherwise(sign).alias("sign"))
            return F.struct((start + m["size"]).alias("end"), F.least(a["best"], one).alias("best"))

        # What is left after the last match has no size.
        return F.aggregate(F.filter(found, lambda m: m["size"].isNotNull()), seed, step)["best"]

    return F.least(each(cut, -1), each(raised, 1))["sign"]


def scenario(rows: DataFrame, question: str = "question") -> DataFrame:
    """``rows`` with stated, understood, unit, change and change_far (million barrels a day, negative for a cut) and note.

    change is 0 both without a scenario and with one that cannot be read; ``understood`` tells which. Of a range, change is the end nearer
    to 0 and change_far the other; both have one sign.

    Each pattern is held against a text once: words of direction only where one unit is named, cues only where none is.
    """
    text, n, of = F.col("__text"), F.col("__n"), F.col("__of")
    held = rows.withColumn("__text", F.lower(F.coalesce(F.col(question), F.lit(""))))
    held = held.withColumn("__has", F.when(text.rlike(r"(?U)\d"), F.array(*[text.rlike(p) for p, _, _ in UNITS])))  # all units need a number
    held = held.withColumns({"__n": F.coalesce(F.size(F.filter("__has", lambda h: h)), F.lit(0)), "__of": F.array_position("__has", F.lit(True)).cast("int")})
    single = n == 1
    pick = lambda give: F.when(single, reduce(lambda c, iu: c.when(of == iu[0] + 1, give(*iu[1])), list(enumerate(UNITS))[1:], F.when(of == 1, give(*UNITS[0]))))
    held = held.withColumns({
        "unit": pick(lambda p, f, u: F.lit(u)), "__factor": pick(lambda p, f, u: F.lit(f)), "__size": pick(lambda p, f, u: _number(F.regexp_extract(text, p, 1))), "__before": pick(lambda p, f, u: _before(text, p)),
        "__cut": F.when(single, _matches(text, CUT)), "__raise": F.when(single, _matches(text, RAISE)),
        "__cue": F.when(n == 0, text.rlike(SUPPLY_WORD) & text.rlike(f"{CUT}|{RAISE}")),
    })
    tail = F.coalesce(*[_number(F.nullif(F.regexp_extract("__before", RANGE, i), F.lit(""))) for i in (1, 2)])
    held = held.withColumns({"__sign": _direction(F.col("__cut"), F.col("__raise"), F.length("__before")), "__tail": F.when(single, tail)})
    sign, tail, cue = F.col("__sign"), F.col("__tail"), F.col("__cue")
    number_left = F.regexp_replace(text, HORIZON, " ").rlike(r"\d")
    note = (
        F.when((n == 0) & ~cue, "")
        .when((n == 0) & number_left, "unit unknown")
        .when(n == 0, "no size given")
        .when(n > 1, "two units at once")
        .when(sign.isNull(), "no direction given")
        .when(tail.isNotNull(), "range")
        .otherwise("")
    )
    good = single & sign.isNotNull()
    near = F.when(good, sign * F.least("__size", F.coalesce("__tail", "__size")) * F.col("__factor")).otherwise(0.0)
    far = F.when(good & tail.isNotNull(), sign * F.greatest("__size", "__tail") * F.col("__factor"))
    stated = (n > 0) | cue
    held = held.withColumns({"change": near, "change_far": far, "note": note, "stated": stated, "understood": ~stated | good})
    return held.drop("__text", "__has", "__n", "__of", "__factor", "__size", "__before", "__cut", "__raise", "__cue", "__sign", "__tail")


def without_reasoning(text: Column) -> Column:
    """A model's reply without its closed thoughts; an unclosed one cuts off all that follows."""
    return F.when(F.contains(text, F.lit("<think>")), F.trim(F.element_at(F.split(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), "<think>", 2), 1))).otherwise(F.trim(text))


def route(reply: Column) -> Column:
    """The last route named as a whole word in a reply without its thoughts; industry for none."""
    found = F.regexp_extract_all(F.lower(without_reasoning(reply)), F.lit(r"(?U)\b(forecast|industry|other)\b"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("industry"))


def next_step(route_name: Column, unreadable: Column, hits: Column, fresh: Column, top_k: int = 5) -> Column:
    """Where a question goes: forecast (or clarify), out_of_scope, web for few hits or a question about the present, else answer."""
    return (
        F.when((route_name == "forecast") & unreadable, "clarify")
        .when(route_name == "forecast", "forecast")
        .when(route_name == "other", "out_of_scope")
        .when((hits < max(1, top_k // 2)) | fresh, "web")
        .otherwise("answer")
    )


# ---- Questions about orders and items, worded by their numbers -------------------------------


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """A question for each line item, in one of eight wordings."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_suppkey", "l_extendedprice")
    n, q = F.col("l_suppkey").cast("string"), F.format_string("%.1f", "l_quantity")
    wording = [
        F.concat(F.lit("Прогноз на "), n, F.lit(" недель при сокращении добычи на "), F.replace(q, F.lit("."), F.lit(",")), F.lit(" тыс. барр./сут")),
        F.concat(F.lit("Если ОПЕК не сократит, а увеличит квоты на "), q, F.lit("%, что сегодня с ценой?")),
        F.concat(F.lit("А на пять лет при падении с "), q, F.lit(" до "), n, F.lit(" kb/d?")),
        F.concat(F.lit("Спрогнозируй цену на год, запасы "), q),
        F.concat(F.lit("Рост добычи в США за "), n, F.lit(" дней")),
        F.concat(F.lit("Сократят ли предложение на "), q, F.lit(" попугаев?")),
        F.concat(F.lit("Изменение на "), q, F.lit(" млн б/с")),
        F.concat(F.lit("Снижение на "), q, F.lit("–"), n, F.lit(" млн баррелей, или "), n, F.lit("%")),
    ]
    return li.withColumn("kind", (F.col("l_orderkey") * 3 + F.col("l_linenumber")) % 8).withColumn("question", F.element_at(F.array(*wording), (F.col("kind") + 1).cast("int")))


def q_horizon(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("question")
    rows = _questions(spark, d).select("kind", "l_suppkey", asked_days(q).alias("asked"), horizon_days(q).alias("days"), needs_fresh(q).alias("fresh"))
    return rows.groupBy("kind", "l_suppkey", "asked", "days", "fresh").agg(F.count("*").alias("n"))


def q_scenario(spark: SparkSession, d: str) -> DataFrame:
    """Equal questions are counted first and read once."""
    rows = _questions(spark, d).groupBy("kind", "l_quantity", "l_suppkey", "question").agg(F.count("*").alias("n"))
    return scenario(rows).select("kind", "l_quantity", "l_suppkey", "stated", "understood", "unit", F.round("change", 6).alias("change"), F.round("change_far", 6).alias("change_far"), "note", "n")


def q_route(spark: SparkSession, d: str) -> DataFrame:
    """Replies with thoughts that name other routes, closed or cut off."""
    e = table(spark, d, "events")
    name = F.when(F.col("event_type") == "error", "other").when(F.col("event_type") == "purchase", "Forecast").when(F.col("event_type") == "signup", "reforecasting").otherwise("industry")
    open_ = F.col("user_id") % 3 == 0
    reply = F.concat(F.lit("<think>forecast? other?</think> "), name, F.when(open_, " <think>no, forecast").otherwise(" "))
    hits = (F.col("event_id") % 5).cast("int")
    rows = e.select("event_id", route(reply).alias("route"), next_step(route(reply), F.col("user_id") % 2 == 0, hits, F.col("value") > 150).alias("next_step"))
    return rows


_Q = "l AS (SELECT (l_orderkey * 3 + l_linenumber) % 8 AS kind, l_suppkey AS s, l_quantity AS q FROM lineitem)"
#: Words that take back a scenario (fixed values).
WAIVER = r"без\s+сценар|без\s+услов|без\s+допущ|(?U)базов\w*\s+прогноз|не\s+важно|неважно"


def clarified(turns: DataFrame, key: list[str], order: str = "turn", question: str = "question") -> DataFrame:
    """``turns`` with outcome and effective, the question that is answered.

    A question whose scenario cannot be read asks back, and is pending at the next turn of its conversation. There a waiver answers it
    without the scenario ("waived"); a reply that makes it readable, and is not readable alone, completes it ("joined"); any other
    turn is taken for itself ("plain", or "asks" again), and what was pending is forgotten. Whether something is pending before a turn is
    the value of the last turn that decides it whatever was pending, turned over by each turn since that a pending question alone keeps from asking.
    """
    w = W.partitionBy(*key).orderBy(order)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    text = F.coalesce(F.col(question), F.lit(""))
    held = turns.withColumns({"__own": text, "__last": F.lag(text).over(w)})
    held = held.withColumn("__both", F.concat_ws(" ", F.rtrim(F.col("__last"), F.lit(" ?!.")), F.ltrim("__own")))
    told = lambda rows, name: scenario(rows, name).withColumns({f"{name}_s": F.col("stated"), f"{name}_u": F.col("understood")}).drop("stated", "understood", "unit", "change", "change_far", "note")
    held = told(told(held, "__own"), "__both")
    waives = F.lower("__own").rlike(WAIVER)
    joins = F.col("__both_s") & F.col("__both_u") & ~(F.col("__own_s") & F.col("__own_u"))
    held = held.withColumns({"__waives": waives, "__ends": F.col("__last").isNotNull() & (waives | joins), "__asks": F.col("__own_s") & ~F.col("__own_u")})
    turns_over = F.col("__ends") & F.col("__asks")
    held = held.withColumn("__flips", F.coalesce(F.sum(turns_over.cast("int")).over(before), F.lit(0)))
    decides = F.last(F.when(~turns_over, F.struct(F.col("__asks").alias("asks"), F.col("__flips").alias("flips"))), True).over(before)
    held = held.withColumn("__by", decides)
    flips = F.col("__flips") - F.coalesce("__by.flips", F.lit(0))
    pending = F.coalesce("__by.asks", F.lit(False)) != (flips % 2 == 1)
    ends = pending & F.col("__ends")
    outcome = F.when(ends & F.col("__waives"), "waived").when(ends, "joined").when(F.col("__asks"), "asks").otherwise("plain")
    effective = F.when(outcome == "waived", F.col("__last")).when(outcome == "joined", F.col("__both")).otherwise(F.col("__own"))
    return held.select(*turns.columns, outcome.alias("outcome"), effective.alias("effective"))


#: Turns of all kinds: a cut without a size, a size without a direction, a waiver, no scenario, a readable scenario, a horizon.
_SAYS = ["сократит добычу?", "на 2 млн барр/сут", "посчитай без сценария", "что с ценой Brent", "если добыча вырастет на 2 mb/d", "на 3 месяца"]


def q_clarified(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as the turns of a conversation, of one of six kinds by a rule of their values."""
    e = table(spark, d, "events").select("user_id", "event_id", (F.floor(F.col("value") * 7) % 6).cast("int").alias("kind"))
    says = F.element_at(F.array(*[F.lit(x) for x in _SAYS]), F.col("kind") + 1)
    return clarified(e.select("user_id", "event_id", says.alias("question")), ["user_id"], "event_id").select("user_id", "event_id", "outcome", "effective")


SQL = {
    "clarified_questions": f"""
      WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(floor(value * 7) AS INTEGER) % 6 AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
      r AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(-1 AS INTEGER) AS k, CAST(-1 AS INTEGER) AS last, 'none' AS outcome FROM (SELECT DISTINCT user_id FROM e)
        UNION ALL SELECT e.user_id, e.n, e.event_id, e.k, r.k, CASE WHEN r.outcome = 'asks' AND e.k = 2 THEN 'waived' WHEN r.outcome = 'asks' AND (r.k, e.k) IN ((0, 1), (1, 0)) THEN 'joined' WHEN e.k IN (0, 1) THEN 'asks' ELSE 'plain' END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1),
      s AS (SELECT *, {_SAYS!r}[k + 1] AS own, {_SAYS!r}[last + 1] AS before FROM r WHERE n > 0)
      SELECT user_id, event_id, outcome, CASE outcome WHEN 'waived' THEN before WHEN 'joined' THEN rtrim(before, ' ?!.') || ' ' || own ELSE own END AS effective FROM s""",
    "question_horizon": f"""
      WITH {_Q}, a AS (SELECT kind, s, CASE kind WHEN 0 THEN 7 * s WHEN 2 THEN 5 * 365 WHEN 3 THEN 365 WHEN 4 THEN s END AS asked FROM l)
      SELECT kind, s AS l_suppkey, asked, CAST(greatest(1, least(coalesce(asked, 90), 730)) AS BIGINT) AS days, kind = 1 AS fresh, count(*) AS n FROM a GROUP BY ALL""",
    "question_scenario": f"""
      WITH {_Q}, a AS (SELECT kind, q AS l_quantity, s AS l_suppkey, kind <> 3 AS stated, kind IN (0, 1, 2, 3) AS understood,
        CASE kind WHEN 0 THEN 'тыс. барр./сут' WHEN 1 THEN 'процент' WHEN 2 THEN 'kb/d' WHEN 6 THEN 'млн барр./сут' END AS unit,
        CASE kind WHEN 0 THEN -q * 0.001 WHEN 1 THEN q * 1.02 WHEN 2 THEN -least(q, s) * 0.001 ELSE 0 END AS change, CASE WHEN kind = 2 THEN -greatest(q, s) * 0.001 END AS change_far,
        CASE kind WHEN 2 THEN 'range' WHEN 4 THEN 'no size given' WHEN 5 THEN 'unit unknown' WHEN 6 THEN 'no direction given' WHEN 7 THEN 'two units at once' ELSE '' END AS note FROM l)
      SELECT kind, l_quantity, l_suppkey, stated, understood, unit, round(change, 6) + 0.0 AS change, round(change_far, 6) AS change_far, note, count(*) AS n FROM a GROUP BY ALL""",
    "question_route": """
      WITH r AS (SELECT event_id, user_id, value, CASE event_type WHEN 'error' THEN 'other' WHEN 'purchase' THEN 'forecast' ELSE 'industry' END AS route FROM events)
      SELECT event_id, route, CASE WHEN route = 'forecast' AND user_id % 2 = 0 THEN 'clarify' WHEN route = 'forecast' THEN 'forecast' WHEN route = 'other' THEN 'out_of_scope'
        WHEN event_id % 5 < 2 OR value > 150 THEN 'web' ELSE 'answer' END AS next_step FROM r""",
}
QUERIES = {
    "clarified_questions": q_clarified,"question_horizon": q_horizon, "question_scenario": q_scenario, "question_route": q_route}
