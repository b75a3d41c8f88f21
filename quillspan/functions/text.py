"""Text and number expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[A-Za-zА-Яа-яЁё]{2,}"
NUMBER = r"-?\d+(?:[.,]\d+)*"


def tokens(text: Column) -> Column:
    """Letters-only words of two or more, in lower case; numbers are dropped."""
    return F.transform(written(text), F.lower)


def written(text: Column) -> Column:
    """Words as ``tokens`` finds them, in their own case: where they become rows at once, it is cheaper to lower them there."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def fixed(number: Column, digits: int) -> Column:
    """A double with so many decimals, as ``format_string("%.nf")`` writes it: by way of a decimal where that is the same, which takes a fraction of the time."""
    plain = (number > 0) & (number < 1e12)
    return F.when(plain, number.cast(f"decimal({14 + digits},{digits})").cast("string")).otherwise(F.format_string(f"%.{digits}f", number))


def digit_ratio(text: Column) -> Column:
    """Share of digits among the characters; 0 for an empty text."""
    n = F.length(text)
    return F.when(n > 0, F.length(F.regexp_replace(text, "[^0-9]", "")) / n).otherwise(F.lit(0.0))


def axis_scale(text: Column) -> Column:
    """Whether five numbers in a row rise or fall by one step that is not 0, as along a chart's axis.

    Years and runs in steps of one are common in prose and tables and don't count.
    """
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"-?\d+\.?\d*"), F.lit(0)), lambda x: x.cast("double"))

    def run(v: Column, i: Column) -> Column:
        part = F.slice(v, i, 5)
        step = lambda j: F.round(F.element_at(part, j + 1) - F.element_at(part, j), 6)
        first = step(F.lit(1))
        even = F.forall(F.sequence(F.lit(2), F.lit(4)), lambda j: step(j) == first)
        whole = F.forall(part, lambda x: x == F.floor(x))
        return even & (first != 0) & ~(whole & (F.forall(part, lambda x: x.between(1900, 2100)) | (F.abs(first) == 1)))

    held = F.array(numbers)
    return F.exists(held, lambda v: (F.size(v) >= 5) & F.exists(F.when(F.size(v) >= 5, F.sequence(F.lit(1), F.size(v) - 4)).otherwise(F.array().cast("array<int>")), lambda i: run(v, i)))


#: What glossaries and notes on methods say (fixed values).
BOILERPLATE = ["defined in the glossary", "= organization for", "purchasing power parity", "apparent consumption", "oxford economics", "stand-alone report"]


def boilerplate(text: Column) -> Column:
    """Whether a text holds a phrase of glossaries and methods."""
    low = F.lower(text)
    return F.exists(F.array(*[F.lit(x) for x in BOILERPLATE]), lambda x: F.contains(low, x))


def carries_no_data(text: Column) -> Column:
    """A chart's axis or boilerplate."""
    return axis_scale(text) | boilerplate(text)


#: Beginnings of Russian words and the words of the reports for them (fixed values).
GLOSSARY = [
    ("добыч производств", "production"), ("нефт сыр", "oil crude petroleum"), ("запас резерв хранилищ", "inventories reserves stocks storage"), ("сша америк штат", "united states"),
    ("цен стоимост котиров", "price prices spot"), ("спрос потреблен", "consumption demand"), ("предложен поставк", "supply"), ("газ", "gas natural"), ("опек", "opec"), ("бензин", "gasoline"),
    ("дизел мазут", "distillate diesel"), ("переработк нпз рафинир", "refinery refining refiner"), ("экспорт", "exports export"), ("импорт", "imports import"), ("брент", "brent"), ("прогноз", "forecast forecasts"),
    ("миров глобальн", "world global"), ("баланс", "balance balances"), ("электро электрич", "electricity generation"), ("уголь угл", "coal"), ("сланц", "shale tight"), ("квот сокращен", "quota cuts curtailment"),
]


def expand(question: Column) -> Column:
    """Words of a question in the reports' language, each once: ASCII words as they are, others by the beginnings that the glossary knows, in its order."""
    known = F.array(*[F.struct(F.split(F.lit(a), " ").alias("starts"), F.split(F.lit(b), " ").alias("words")) for a, b in GLOSSARY])

    def of(word: Column) -> Column:
        found = F.filter(known, lambda g: F.exists(g["starts"], lambda s: F.startswith(word, s)))
        return F.when(word.rlike("^[a-z]+$"), F.array(word)).otherwise(F.flatten(F.transform(found, lambda g: g["words"])))

    return F.array_distinct(F.flatten(F.transform(tokens(question), of)))


def collapse(text: Column) -> Column:
    """Spaces and tabs in a row as one space, and no more than one empty line."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")


def strip_tags(html: Column) -> Column:
    """A text without its markup and without space at its ends."""
    return F.trim(F.regexp_replace(html, "<[^>]+>", ""))


#: Names of months in citations (fixed values).
MONTHS = ["январь", "февраль", "март", "апрель", "май", "июнь", "июль", "август", "сентябрь", "октябрь", "ноябрь", "декабрь"]


def file_meta(path: Column) -> Column:
    """source_name and date of a report's file name: NAME_2026-07 or NAME_2026; else the whole name and an empty date. A month beyond 12 stays a number."""
    stem_ = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    month = F.regexp_extract(stem_, r"[_-]\d{4}-(\d{2})$", 1)
    dated = stem_.rlike(r"[_-]\d{4}-\d{2}$")
    year = stem_.rlike(r"[_-]\d{4}$")
    named = F.coalesce(F.get(F.array(*[F.lit(m) for m in MONTHS]), month.try_cast("int") - 1), month.try_cast("int").cast("string"))
    name = F.when(dated, F.regexp_replace(stem_, r"[_-]\d{4}-\d{2}$", "")).when(year, F.regexp_replace(stem_, r"[_-]\d{4}$", "")).otherwise(stem_)
    date = F.when(dated, F.concat_ws(" ", named, F.regexp_extract(stem_, r"(\d{4})-\d{2}$", 1))).when(year, F.regexp_extract(stem_, r"(\d{4})$", 1)).otherwise("")
    return F.struct(F.trim(F.replace(name, F.lit("_"), F.lit(" "))).alias("source_name"), date.alias("date"))


def stem(word: Column) -> Column:
    """A word less 3, 2 or 1 of its last characters if it has 8, 6 or 4 of them."""
    n = F.length(word)
    cut = F.when(n >= 8, 3).when(n >= 6, 2).when(n >= 4, 1).otherwise(0)
    return F.substring(word, F.lit(1), n - cut)


def title(question: Column) -> Column:
    """First 60 characters of a question at a word's end where that leaves 30, without closing marks, with an ellipsis if cut."""
    flat = F.trim(F.regexp_replace(F.coalesce(question, F.lit("")), r"\s+", " "))
    head = F.substring(flat, 1, 60)
    at = F.lit(60) - F.locate(" ", F.reverse(head))
    cut = F.when((F.locate(" ", F.reverse(head)) > 0) & (at >= 30), F.substring(head, F.lit(1), at)).otherwise(head)
    out = F.when(F.length(flat) <= 60, flat).otherwise(F.concat(F.regexp_replace(cut, r"[ ,.;:!?-]+$", ""), F.lit("…")))
    return F.when(flat == "", F.lit("Untitled")).otherwise(out)


def host(url: Column) -> Column:
    """Authority of a URL in lower case without www.; null for no URL."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def content_id(namespace: str, *parts: Column) -> Column:
    """Name-based UUID (version 5) of the parts joined by bars: equal content has equal ids on every run."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(text, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))
