"""Words on pages to lines, columns and table rows, and the scoring of parsed tables against the truth."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, reduce
from itertools import accumulate, groupby, islice
from operator import itemgetter
from xml.parsers import expat
from xml.sax.saxutils import unescape

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import fixed
from ..sources.tables import on_workers, table

#: Formats of the pages (fixed values): how far words of a line may differ in height, captions, values, and names of columns.
SAME_LINE, CAPTION, VALUE, COLUMN = 1.6, r"^Table\s+\d+[a-z]?\.", r"^(-|--|NA|W|-?\d[\d,]*\.\d+)$", r"^(Q[1-4]|\d{4})$"
COLUMNS, VALUES, SHIFT = 8, 3, 3
#: Files of boxes that a worker holds as words at once.
FILES = 100


#: Where the words stand in what a layout tool writes of a document (below a root of any name), and where a line may end after ``$``, as in the JVM.
BBOX, CLOSE = ["", "body", "doc", "page", "flow", "block", "line", "word"], r"(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)"
IS_CAPTION, IS_VALUE, IS_COLUMN, IS_YEAR = (re.compile(x.replace("$", CLOSE), re.ASCII) for x in (CAPTION, VALUE, COLUMN, r"^(\d{4}|Year)$"))
BLANK = "".join(map(chr, range(33)))
WORD = pa.struct([("word", pa.string()), ("x0", pa.float64()), ("x1", pa.float64()), ("top", pa.float64())])
NO_WORDS = pa.array([], WORD)


#: A word that needs no parser: four numbers, and text without marks but the five that XML names itself. Between such words stands what is parsed; where that holds more than
#: elements (comments, CDATA, entities and the like may hold what looks like a word), all of the file is.
IS_WORD = re.compile(r'<word xMin="([-0-9.]+)" yMin="([-0-9.]+)" xMax="([-0-9.]+)" yMax="[-0-9.]+">([^<>\x00-\x1f]*)</word>')
IS_ODD = re.compile(r"<!(?!DOCTYPE[^<>\[]*>)|<\?(?!xml[ \t\r\n])")
IS_BAD, IS_TEXT = re.compile("[\ud800-\udfff\ufffe\uffff]"), re.compile("(?:[^&]|&(?:amp|lt|gt|quot|apos);)*")
QUOTES = {"&quot;": '"', "&apos;": "'"}


def _corner(value: str | None) -> float | None:
    return None if value is None else float(value.replace(",", ""))


@lru_cache(10_000)
def _said(text: str) -> str | None:
    """What a word says; null if it has marks of a file's own."""
    return unescape(text, QUOTES).strip(BLANK) if IS_TEXT.fullmatch(text) else None


def _plain_words(xml: str) -> tuple[str, pa.StructArray]:
    """An XML text with each run of plain words as ``<?words from to?>``, and these words; all of it and no words if that might change its meaning."""
    parts = IS_WORD.split(xml)
    rest = parts[::5]
    said = [_said(w) if "&" in w or " " in w else w for w in parts[4::5]]
    if not said or None in said or IS_ODD.search("".join(rest)) or (not xml.isascii() and IS_BAD.search(xml)):
        return xml, NO_WORDS
    try:
        corners = pa.array([*parts[1::5], *parts[3::5], *parts[2::5]], pa.string()).cast(pa.float64())
    except pa.ArrowInvalid:
        return xml, NO_WORDS
    out, at = [], 0
    for i, between in enumerate(rest):
        if between and between.strip(" \t\r\n"):
            out += [f"<?words {at} {i}?>", between] if i > at else [between]
            at = i
    if at < len(said):
        out.append(f"<?words {at} {len(said)}?>")
    return "".join(out), pa.StructArray.from_arrays([pa.array(said, pa.string()), *(corners.slice(i * len(said), len(said)) for i in range(3))], fields=list(WORD))


def box_words(xml: str | None) -> tuple[list[int], pa.StructArray]:
    """The numbers of words of the pages in an XML file of boxes, and these words (word, x0, x1, top); what cannot be read has no page, what follows the root is left."""
    sizes: list[int] = []
    spans: list[tuple[int, int]] = []  # of plain words, then of those that were read here
    found: list[dict] = []
    path: list[str] = []
    said: list[str] = []
    word: dict | None = None

    def start(name: str, corners: dict) -> None:
        nonlocal word, root
        root = root or not path
        path.append(name if path else "")
        if name == "word":
            word = corners if path == BBOX else None
            said.clear()
        elif name == "page":
            if path == BBOX[:4]:
                sizes.append(0)
        elif len(path) < 4 and path == BBOX[: len(path)]:
            sizes.clear()  # of two bodies the last counts
            spans.clear()

    def keep(a: int, b: int) -> None:
        sizes[-1] += b - a
        spans.append((a, b))

    def run(_: str, ends: str) -> None:
        nonlocal word
        if path == BBOX[:-1]:
            keep(*map(int, ends.split()))
        elif not root:
            raise ValueError("a word is the root")
        else:
            word = None

    def end(name: str) -> None:
        nonlocal word
        if word is not None and len(path) == len(BBOX):
            found.append({"word": "".join(said).strip(BLANK)} | {to: _corner(word.get(x)) for to, x in (("x0", "xMin"), ("x1", "xMax"), ("top", "yMin"))})
            keep(len(plain) + len(found) - 1, len(plain) + len(found))
            word = None
        path.pop()

    def text(part: str) -> None:
        if word is not None and len(path) == len(BBOX):
            said.append(part)

    root = False
    rest, plain = _plain_words(xml or "")
    reader = expat.ParserCreate()
    reader.StartElementHandler, reader.EndElementHandler, reader.CharacterDataHandler, reader.buffer_text = start, end, text, True
    if len(plain):
        reader.ProcessingInstructionHandler = run
    try:
        reader.Parse(rest, True)
    except expat.ExpatError:
        if path or not root:
            return [], plain[:0]
    except ValueError:
        return [], plain[:0]
    if sum(sizes) == len(plain) and not found:
        return sizes, plain
    return sizes, pa.concat_arrays([plain, pa.array(found, WORD)]).take(pa.array([i for span in spans for i in range(*span)], pa.int64()))


def read_boxes(xml: str | None) -> list[list[tuple]]:
    """The words (word, x0, x1, top) of each page that ``box_words`` finds."""
    sizes, found = box_words(xml)
    words = zip(*(c.to_pylist() for c in found.flatten()))
    return [list(islice(words, n)) for n in sizes]


def _lists(sizes: Iterable[int], values: pa.Array) -> pa.Array:
    """``values`` cut into arrays of these sizes."""
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int32()), values)


def boxes(files: DataFrame, text: str = "xml") -> Column:
    """The pages in each XML file of boxes, as arrays of words (word, x0, x1, top, line), with the line that ``line_numbers`` gives."""
    on_workers(files.sparkSession)

    def found(xml: pa.Array) -> pa.Array:
        files = [box_words(x) for x in xml.to_pylist()]
        sizes = [n for pages, _ in files for n in pages]
        columns = pa.concat_arrays([NO_WORDS, *(words for _, words in files)]).flatten()
        tops = columns[-1].to_pylist() if columns[-1].null_count else columns[-1].to_numpy().tolist()
        ends = list(accumulate(sizes))
        lines = [n for a, b in zip([0, *ends], ends) for n in line_numbers(tops[a:b])]
        words = pa.StructArray.from_arrays([*columns, pa.array(lines, pa.int32())], fields=[*WORD, pa.field("line", pa.int32())])
        return _lists((len(pages) for pages, _ in files), _lists(sizes, words))

    @F.arrow_udf("array<array<struct<word string, x0 double, x1 double, top double, line int>>>")
    def read(xml: pa.Array) -> pa.Array:
        return pa.concat_arrays([found(xml.slice(i, FILES)) for i in range(0, max(len(xml), 1), FILES)])

    return read(text)


def bbox_pages(files: DataFrame, text: str = "xml") -> DataFrame:
    """(path, page, words) of the pages in XML files (path, xml) of boxes, from 1; words as ``boxes`` has them."""
    rows = files.select("path", boxes(files, text).alias("p")).select("path", F.posexplode("p").alias("page", "words"))
    return rows.select("path", (F.col("page") + 1).alias("page"), "words")


def page_sums(pages: Column, mark: str) -> Column:
    """Of each page that ``boxes`` finds the number of words, the last line, the number of words equal to ``mark``, and the sums of x0 and x1."""

    @F.arrow_udf("array<struct<words long, lines int, marks long, left double, right double>>")
    def sums(files: pa.Array) -> pa.Array:
        words = pa.table({"page": files.flatten().value_parent_indices()} | dict(zip(("word", "x0", "x1", "top", "line"), files.flatten().flatten().flatten())))
        words = words.append_column("mark", pc.equal(words["word"], mark))
        of = words.group_by("page", use_threads=False).aggregate([("page", "count"), ("line", "max"), ("mark", "sum"), ("x0", "sum"), ("x1", "sum")])
        every = pa.table({"page": pa.array(range(len(files.flatten())), pa.int64())}).join(of, "page", use_threads=False).sort_by("page")
        columns = [every[c].cast(t).combine_chunks() for c, t in (("page_count", pa.int64()), ("line_max", pa.int32()), ("mark_sum", pa.int64()), ("x0_sum", pa.float64()), ("x1_sum", pa.float64()))]
        return _lists(files.value_lengths().fill_null(0).to_pylist(), pa.StructArray.from_arrays(columns, ["words", "lines", "marks", "left", "right"]))

    return sums(pages)


def bbox_words(files: DataFrame, text: str = "xml") -> DataFrame:
    """(path, page, word, x0, x1, top) of all words in XML files (path, xml) of boxes, pages from 1; what cannot be read has none."""
    return bbox_pages(files, text).select("path", "page", F.inline("words")).drop("line")


def by_page(words: DataFrame, key: list[str]) -> DataFrame:
    """Pages (key, words) of words (key, word, x0, x1, top): those of each page as one array, in any order."""
    return words.dropna(subset=key).groupBy(*key).agg(F.collect_list(F.struct("word", "x0", "x1", "top")).alias("words"))


def line_numbers(tops: list[float | None]) -> list[int]:
    """The line that each word of a page stands in, from 1: a line goes on while a word is at most 1.6 below its first one. NaN comes last, none is above all lines."""
    lines: dict = {None: 0}
    first, n = 0.0, 0
    for top in sorted(t for t in set(tops) if t is not None and t == t):
        if not n or not top - first <= SAME_LINE:
            first, n = top, n + 1
        lines[top] = n
    return [lines.get(t, n + 1) for t in tops]


def _rank(x: float | str | None) -> tuple:
    """Orders as Spark does: nulls first, NaN last."""
    return (0, 0) if x is None else (1, x) if x == x else (2, 0)


def _above(a: float | None, b: float | None) -> bool:
    return a is not None and b is not None and (a > b or (a != a and b == b))


def _middle(a: float | None, b: float | None) -> float | None:
    return None if a is None or b is None else (a + b) / 2


def page_lines(words: list, x0: list, x1: list, tops: list, odd: bool = True) -> list[tuple[int, list[tuple]]]:
    """(line, words) of a page in order: the words of each line from left to right, as (x0, x1, word). Nulls and NaN have places of their own if it may be ``odd``."""
    rows = sorted(zip(line_numbers(tops), x0, x1, words), key=(lambda w: tuple(map(_rank, w))) if odd else None)
    return [(line, [w[1:] for w in of]) for line, of in groupby(rows, itemgetter(0))]


def page_caption(lines: list[tuple[int, list[tuple]]]) -> str | None:
    """The first line of a page that is a caption."""
    return next((text for _, of in lines if IS_CAPTION.match(text := " ".join(w for *_, w in of if w is not None))), None)


@lru_cache(100_000)
def is_value(word: str) -> bool:
    return IS_VALUE.match(word) is not None


def page_columns(lines: list[tuple[int, list[tuple]]]) -> tuple[int, list, list] | None:
    """(header_line, names, centres): the first line of a page that names eight columns at least and two other words at most, with
    each quarter's nearest year in the line above."""
    above: list[tuple] = []
    for line, of in lines:
        if len(of) >= COLUMNS:
            other = islice((w for *_, w in of if w is None or not IS_COLUMN.match(w)), 3)
            if (n := sum(1 for _ in other)) <= 2 and len(of) - n >= COLUMNS:
                break
        above = of
    else:
        return None
    centres = [_middle(a, b) for a, b, _ in of]
    band = [(_middle(a, b), w) for a, b, w in above if w is not None and IS_YEAR.match(w)]
    names = []
    for at, (*_, word) in zip(centres, of):
        away = [(_rank(None if at is None or c is None else abs(c - at)), i) for i, (c, _) in enumerate(band)]
        near = band[min(away)[1]][1] if away else "Year"
        names.append(word if near == "Year" or word is None else near + word)
    return line, names, centres


def page_cells(lines: list[tuple[int, list[tuple]]]) -> list[tuple]:
    """(line, label, column, name, value) of a page: the values of lines with three of them at least, each in the column whose centre is nearest;
    what is no value, or lies left of the columns, is the label."""
    head = page_columns(lines)
    if head is None:
        return []
    header_line, names, centres = head
    bounds = [_middle(a, b) for a, b in zip(centres, centres[1:])]
    first, next_ = centres[0], bounds[0]
    left = None if first is None else first - (0.0 if next_ is None else next_ - first)
    ordered = None not in bounds and all(a <= b for a, b in zip(bounds, bounds[1:]))
    out = []
    for line, of in lines:
        if line == header_line or len(of) < VALUES:
            continue
        label, values = [], []
        for x0, x1, word in of:
            if word is None:
                continue
            if is_value(word):
                at = None if x0 is None or x1 is None else (x0 + x1) / 2
                if _above(at, left):
                    values.append((bisect_left(bounds, at) if ordered and at == at else sum(_above(at, b) for b in bounds), word))
                    continue
                if at is None or left is None:
                    continue  # neither a value nor part of the label
            label.append((x0, word))
        if len(values) >= VALUES:
            label.sort(key=lambda w: (_rank(w[0]), w[1]))  # places of equal x0 go by x1 in a line
            name = " ".join(w for _, w in label).strip(" .")
            out += [(line, name, column, names[column], word) for column, word in values]
    return out


def pages_of(words: pa.Array) -> Iterator[list[tuple[int, list[tuple]]]]:
    """The lines of each page of a column of pages' words."""
    parts = words.flatten().flatten()
    odd = any(c.null_count or (pa.types.is_floating(c.type) and pc.any(pc.is_nan(c)).as_py()) for c in parts)
    held = [c.to_pylist() if c.null_count else c.to_numpy(zero_copy_only=False).tolist() for c in parts]
    at = 0
    for n in words.value_lengths().fill_null(0).to_pylist():
        yield page_lines(*(c[at : at + n] for c in held), odd)
        at += n


def page_captions(pages: DataFrame, document: str, page: str) -> DataFrame:
    """(document, page, caption) of pages (document, page, words): the first line of each that is a caption, else the last one of an earlier page of the document."""
    on_workers(pages.sparkSession)

    @F.arrow_udf("string")
    def caption(words: pa.Array) -> pa.Array:
        return pa.array(map(page_caption, pages_of(words)), pa.string())

    w = W.partitionBy(document).orderBy(page).rowsBetween(W.unboundedPreceding, 0)
    return pages.select(document, page, caption("words").alias("c")).select(document, page, F.last("c", True).over(w).alias("caption"))


def cells(pages: DataFrame, key: list[str]) -> DataFrame:
    """(key, line, label, column, name, value): what ``page_cells`` finds on pages (key, words)."""
    on_workers(pages.sparkSession)
    kinds = {"line": pa.int32(), "label": pa.string(), "column": pa.int32(), "name": pa.string(), "value": pa.string()}

    @F.arrow_udf("array<struct<line int, label string, column int, name string, value string>>")
    def found(words: pa.Array) -> pa.Array:
        pages = [page_cells(lines) for lines in pages_of(words)]
        columns = zip(*(c for p in pages for c in p)) if any(pages) else [()] * len(kinds)
        return _lists(map(len, pages), pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], list(kinds)))

    return pages.select(*key, found("words").alias("c")).select(*key, F.inline("c"))


def dense(sparse: DataFrame, key: list[str], width: int) -> DataFrame:
    """(key, values): cells (key, column, value) as an array of the width, gaps empty; of two in one column the last by text."""
    held = sparse.groupBy(*key).agg(F.collect_list(F.struct("column", "value")).alias("c"))
    at = lambda i: F.array_max(F.transform(F.filter("c", lambda c: c["column"] == i), lambda c: c["value"]))
    return held.select(*key, F.array(*[F.coalesce(at(i), F.lit("")) for i in range(width)]).alias("values"))


def norm(cell: Column) -> Column:
    """A cell for comparison: no space around it, no thousands commas, one kind of minus; a dash is not an empty cell."""
    return F.translate(F.replace(F.trim(cell), F.lit(","), F.lit("")), "−–", "--")


def shift(actual: Column, expected: Column) -> Column:
    """(wrong, shift) at the shift of at most three columns under which the fewest expected cells are wrong; of equal ones the leftmost."""
    want, got = F.transform(expected, norm), F.transform(actual, norm)
    wrong = lambda s: F.size(F.filter(F.transform(want, lambda x, i: F.coalesce(F.when(i + s >= 0, F.get(got, i + s)) == x, F.lit(False))), lambda ok: ~ok))
    return F.array_min(F.transform(F.array(*[F.lit(s) for s in range(-SHIFT, SHIFT + 1)]), lambda s: F.struct(wrong(s).alias("wrong"), s.alias("shift"))))


def match_labels(parsed: DataFrame, truth: DataFrame, key: list[str]) -> DataFrame:
    """Truth rows (key, label) with the place of the parsed row (key, place, label) they stand for: the first equal one, else the first that holds the label; null for none."""
    low = lambda c: F.lower(F.trim(c))
    p = parsed.select(*key, F.col("place").alias("__place"), low(F.col("label")).alias("__label"))
    near = truth.join(p, key).where(F.contains("__label", low(F.col("label"))))
    best = near.groupBy(*key, "label").agg(F.min(F.struct((F.col("__label") != low(F.col("label"))).alias("o"), "__place")).alias("b"))
    return truth.join(best, [*key, "label"], "left").withColumn("place", F.col("b.__place")).drop("b")


def best_shift(got: list[str | None] | None, want: list[str | None]) -> tuple[int, int]:
    """``shift`` of cells that ``norm`` has been through, in plain Python."""
    got, best = got or [], None
    for s in range(-SHIFT, SHIFT + 1):
        a, b = (want[-s:], got) if s < 0 else (want, got[s:])
        wrong = len(want) - sum(x == y and x is not None for x, y in zip(a, b))
        if best is None or wrong < best[0]:
            best = wrong, s
    return best


def score_page(labels: list, wanted: list, places: list, names: list, cells: list) -> tuple[int, int, int | None, int | None, int]:
    """What ``score`` gives for one page: labels and cells of the truth, and places, labels and cells of what was parsed; labels in lower case, all cells as they were."""
    spelled = lambda x: None if x is None else [None if c is None else c.strip(" ").replace(",", "").replace("−", "-").replace("–", "-") for c in x]
    held: dict = {}
    for place, values in zip(places, cells):
        held.setdefault(place, []).append(spelled(values))
    rows = found = shifted = 0
    sizes, missed = [], []
    for label, want in zip(labels, wanted):
        meets = [(name != label, place is not None, place) for name, place in zip(names, places) if label is not None and name is not None and label in name]
        place = min(meets)[2] if meets else None
        want = spelled(want)
        for got in held.get(place, [None]) if place is not None else [None]:
            rows += 1
            found += place is not None
            wrong, moved = (None if want is None else len(want)), 0
            if place is not None:
                wrong, moved = (None, -SHIFT) if want is None else best_shift(got, want)
            shifted += moved != 0
            if want is not None:
                sizes.append(len(want))
                missed.append(wrong)
    return rows, found, sum(sizes) if sizes else None, sum(missed) if missed else None, shifted


def score(parsed: DataFrame, truth: DataFrame, key: list[str]) -> DataFrame:
    """(key, rows, rows_found, cells, misplaced, shifted): parsed rows (key, place, label, values) against the truth (key, label, values).

    A row that is not found has all its cells misplaced. The rows of a page meet once, in one call of ``score_page``; a row is
    matched as ``match_labels`` and ``shift`` do.
    """
    on_workers(truth.sparkSession)
    low = F.lower(F.trim("label")).alias("label")
    t = truth.groupBy(*key).agg(F.collect_list(F.struct(low, "values")).alias("__t"))
    p = parsed.groupBy(*key).agg(F.collect_list(F.struct("place", low, "values")).alias("__p"))

    @F.arrow_udf("rows long, rows_found long, cells long, misplaced long, shifted long")
    def scored(labels: pa.Array, wanted: pa.Array, places: pa.Array, names: pa.Array, cells: pa.Array) -> pa.Array:
        pages = [score_page(*(x or [] for x in page)) for page in zip(*(c.to_pylist() for c in (labels, wanted, places, names, cells)))]
        columns = [pa.array(c, pa.int64()) for c in zip(*pages)] if pages else [pa.array([], pa.int64())] * 5
        return pa.StructArray.from_arrays(columns, ["rows", "rows_found", "cells", "misplaced", "shifted"])

    held = t.join(p, key, "left").select(*key, scored("__t.label", "__t.values", "__p.place", "__p.label", "__p.values").alias("s"))
    return held.select(*key, "s.*")


# ---- Pages made of line items: a page an order, a document a customer -------------------------


def _rows(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey").repartition("l_orderkey")  # once for all that follows
    li = items.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"), F.min("l_partkey").alias("p"))
    return li.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")


def _written(word: Callable[[Column, Column, int, Column], Column]) -> tuple[Column, Column]:
    """The words above a page's rows, and those of one row (null where a cell is missing), as ``word`` writes each: a caption on pages of even numbers, years over
    eight quarters, and rows whose cells lie off their columns' centres by a few points; every third cell is missing."""
    n = F.lit
    number = F.concat((F.col("l_orderkey") % 9).cast("string"), F.lit("b."))
    caption = F.array(*[word(w, n(10 + 40 * i), 30, n(5 + i * 0.3)) for i, w in enumerate([n("Table"), number, n("World"), n("Supply")])])
    head = F.array(*[word(n(f"Q{i % 4 + 1}"), n(200 + 50 * i), 10, n(40 + i % 2)) for i in range(8)], *[word(n(str(2025 + i)), n(270 + 200 * i), 20, n(30)) for i in range(2)], word(n("Footer"), n(10), 30, n(900)))
    height = lambda line: 50 + 10 * line
    y = height(F.col("l_linenumber"))
    value = [F.when((F.col("p") + j) % 3 != 0, word(fixed(F.col("q") + j, 1), n(193 + 50 * j) + (F.col("p") % 5) * 5, 14, y + (j % 3) * 0.5)) for j in range(8)]
    # A function of arrays in one word keeps Spark from generating a single method for all of them: the JVM does not compile one of that length, it interprets it.
    label = [word(n("Line"), n(10), 20, y), word(F.col("l_linenumber").cast("string"), n(40), 5, y + 1), word(n("...."), n(60), 50, F.get(F.transform(F.array("l_linenumber"), height), n(0)))]
    return F.when(F.col("l_orderkey") % 2 == 0, F.concat(caption, head)).otherwise(head), F.array(*label, *value)


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """(o_custkey, l_orderkey, words) of the pages."""
    top, row = _written(lambda w, x, wide, top: F.struct(w.alias("word"), x.cast("double").alias("x0"), (x + wide).cast("double").alias("x1"), top.cast("double").alias("top")))
    body = _rows(spark, d).select("o_custkey", "l_orderkey", row.alias("w")).groupBy("o_custkey", "l_orderkey").agg(F.flatten(F.collect_list("w")).alias("w"))
    return body.select("o_custkey", "l_orderkey", F.array_compact(F.concat(top, "w")).alias("words"))


def q_bbox(spark: SparkSession, d: str) -> DataFrame:
    """The words of all pages written as boxes, a file a customer, and read back into lines; marks of XML stand in some words."""
    point = lambda x: F.concat(x.cast("string"), F.lit(".0"))

    def one(word: Column, x: Column, wide: int, top: Column) -> Column:
        plain = reduce(lambda w, m: F.replace(w, F.lit(m[0]), F.lit(m[1])), [("....", "a<b & \"c\""), ("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")], word)
        return F.concat(F.lit('<word xMin="'), point(x), F.lit('" yMin="'), top.cast("double").cast("string"), F.lit('" xMax="'), point(x + wide), F.lit('" yMax="0">'), plain, F.lit("</word>"))

    top, row = _written(one)
    # Line items go to their customer as they are, and are written there: no text is shuffled.
    w = W.partitionBy("o_custkey", "l_orderkey").orderBy("l_linenumber")
    rows = _rows(spark, d).repartition("o_custkey").withColumns({"first": F.row_number().over(w) == 1, "last": F.lead(F.lit(True)).over(w).isNull()})
    begin, end = F.concat(F.lit("<page><flow><block><line>"), F.array_join(top, "")), F.lit("</line></block></flow></page>")
    line = F.concat(F.when(F.col("first"), begin).otherwise(""), F.array_join(row, ""), F.when(F.col("last"), end).otherwise(""))
    file = rows.select("o_custkey", F.struct("l_orderkey", "l_linenumber", line.alias("line")).alias("l")).groupBy("o_custkey").agg(F.sort_array(F.collect_list("l")).alias("l"))
    files = file.select(F.col("o_custkey").cast("string").alias("path"), F.concat(F.lit('<html xmlns="http://www.w3.org/1999/xhtml"><body><doc>'), F.array_join("l.line", ""), F.lit("</doc></body></html>")).alias("xml"))
    pages = files.select("path", F.posexplode(page_sums(boxes(files), 'a<b & "c"')).alias("page", "p")).where("p.words > 0")
    return pages.select("path", (F.col("page") + 1).alias("page"), "p.words", "p.lines", "p.marks", F.round("p.left", 3).alias("left"), F.round("p.right", 3).alias("right"))


def q_captions(spark: SparkSession, d: str) -> DataFrame:
    return page_captions(_pages(spark, d), "o_custkey", "l_orderkey")


def q_cells(spark: SparkSession, d: str) -> DataFrame:
    return cells(_pages(spark, d), ["o_custkey", "l_orderkey"]).select("l_orderkey", "label", "column", "name", "value")


def q_dense(spark: SparkSession, d: str) -> DataFrame:
    return dense(cells(_pages(spark, d), ["o_custkey", "l_orderkey"]), ["l_orderkey", "label"], 8).withColumn("values", F.array_join("values", "|"))


def q_score(spark: SparkSession, d: str) -> DataFrame:
    """The truth has eight cells a row; parsed rows lose their first cell, their dashes, or their label, by their number."""
    rows = _rows(spark, d)
    want = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.when((F.col("p") + j) % 4 == 0, "−").otherwise(F.format_number(F.col("q") * 100 + j, 1)))
    truth = rows.select("l_orderkey", F.concat(F.lit("Line "), F.col("l_linenumber").cast("string")).alias("label"), want.alias("values"), "l_linenumber", "p")
    got = F.when(F.col("l_linenumber") % 4 == 1, F.expr("slice(values, 2, 7)")).when(F.col("l_linenumber") % 4 == 2, F.filter("values", lambda v: v != "−")).otherwise(F.transform("values", lambda v: F.translate(v, "−,", "-")))
    label = F.when(F.col("l_linenumber") % 4 == 3, F.concat(F.lit(" total of LINE "), F.col("l_linenumber").cast("string"))).when(F.col("l_linenumber") == 4, "other").otherwise(F.col("label"))
    parsed = truth.select("l_orderkey", F.col("l_linenumber").alias("place"), label.alias("label"), got.alias("values"))
    return score(parsed, truth.select("l_orderkey", "label", "values"), ["l_orderkey"])


_BASE = """b AS (SELECT l_orderkey, l_linenumber AS n, min(l_quantity) AS q, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2),
  o AS (SELECT b.*, o_custkey FROM b JOIN orders ON o_orderkey = l_orderkey),
  c AS (SELECT *, unnest(range(0, 8)) AS j FROM o), k AS (SELECT l_orderkey, 'Line ' || n AS label, CAST(j AS INTEGER) AS col, (2025 + j // 4) || 'Q' || (j % 4 + 1) AS name, printf('%.1f', q + j) AS value FROM c WHERE (p + j) % 3 <> 0)"""
SQL = {
    "bbox_words": f"""
      WITH {_BASE}, g AS (SELECT o_custkey, l_orderkey, count(*) AS n, sum(c) AS cells, sum(s) AS x FROM (SELECT o_custkey, l_orderkey, n, count(*) FILTER (WHERE (p + j) % 3 <> 0) AS c,
          sum(193 + 50 * j + p % 5 * 5) FILTER (WHERE (p + j) % 3 <> 0) AS s FROM c GROUP BY ALL) GROUP BY ALL)
      SELECT CAST(o_custkey AS VARCHAR) AS path, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey) AS INTEGER) AS page, CAST(11 + CASE WHEN l_orderkey % 2 = 0 THEN 4 ELSE 0 END + 3 * n + cells AS BIGINT) AS words,
        CAST(3 + CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE 0 END + n AS INTEGER) AS lines, n AS marks, CAST(3750 + CASE WHEN l_orderkey % 2 = 0 THEN 280 ELSE 0 END + 110 * n + x AS DOUBLE) AS left,
        CAST(3750 + 150 + CASE WHEN l_orderkey % 2 = 0 THEN 400 ELSE 0 END + 185 * n + x + 14 * cells AS DOUBLE) AS right FROM g""",
    "page_captions": f"""
      WITH {_BASE}, g AS (SELECT DISTINCT o_custkey, l_orderkey FROM o)
      SELECT o_custkey, l_orderkey, last_value(CASE WHEN l_orderkey % 2 = 0 THEN 'Table ' || l_orderkey % 9 || 'b. World Supply' END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY l_orderkey ROWS UNBOUNDED PRECEDING) AS caption FROM g""",
    "page_cells": f'WITH {_BASE} SELECT l_orderkey, label, col AS "column", name, value FROM k',
    "dense_rows": f"""
      WITH {_BASE} SELECT l_orderkey, 'Line ' || n AS label, string_agg(CASE WHEN (p + j) % 3 <> 0 THEN printf('%.1f', q + j) ELSE '' END, '|' ORDER BY j) AS values FROM c GROUP BY l_orderkey, n""",
    "table_score": f"""
      WITH {_BASE}, t AS (SELECT l_orderkey, n, [CASE WHEN (p + j) % 4 = 0 THEN '-' ELSE printf('%.1f', q * 100 + j) END FOR j IN range(0, 8)] AS want FROM o),
      g AS (SELECT *, CASE n % 4 WHEN 1 THEN want[2:8] WHEN 2 THEN list_filter(want, lambda v: v <> '-') ELSE want END AS got, n <> 4 AS found FROM t),
      s AS (SELECT *, unnest(range(-3, 4)) AS s FROM g), m AS (SELECT l_orderkey, n, found, s, len([1 FOR j IN range(1, 9) IF j + s < 1 OR j + s > len(got) OR got[j + s] IS DISTINCT FROM want[j]]) AS wrong FROM s),
      r AS (SELECT l_orderkey, n, found, CASE WHEN found THEN wrong ELSE 8 END AS wrong, found AND s <> 0 AS moved FROM m QUALIFY row_number() OVER (PARTITION BY l_orderkey, n ORDER BY wrong, s) = 1)
      SELECT l_orderkey, count(*) AS rows, count(*) FILTER (WHERE found) AS rows_found, count(*) * 8 AS cells, CAST(sum(wrong) AS BIGINT) AS misplaced, count(*) FILTER (WHERE moved) AS shifted FROM r GROUP BY 1""",
}
QUERIES = {"bbox_words": q_bbox, "page_captions": q_captions, "page_cells": q_cells, "dense_rows": q_dense, "table_score": q_score}
