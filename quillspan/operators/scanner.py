"""One pass over a report's stream: captions, sections, names of columns and table rows, with the places where they stand.

A row is a label, a leader of dots and four values at least. Where its label begins depends on the row accepted before, so this is a
plain function of one stream; Spark runs it over columns of streams.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa

#: Formats of the reports (fixed values): a table's caption, a leader of dots, values after it, and names of columns.
CAPTION = r"Table\s+\d+[a-z]?\.\s+[A-Z](?:[A-Za-z .,/&'-]|(?<=[A-Za-z])\d){4,80}(?:\([^)]{0,40}\))?"
LEADER, VALUE = r"\.{3,}", r"(?:-?[\d,]+(?:\.\d+)?|-)"
PERIOD = r"(?:Q[1-4]|Year|(?:18|19|20)\d{2}|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
NUMBER = r"-?\d[\d,]*(?:\.\d+)?"
LABEL_NEAR, LABEL_WITHIN, LABELS = 100, 200, 3  # characters in which a number ends a label's search, characters of a label at most, periods of a header at least

CAPTIONS, LEADERS, NUMBERS, LETTERS = re.compile(CAPTION), re.compile(LEADER), re.compile(NUMBER), re.compile("[A-Za-z]{2,}")
VALUES = re.compile(rf"\s*(?:{VALUE}(?:[ \t]+|(?=\n|$))){{4,}}")
PERIODS, CELLS = re.compile(PERIOD, re.I), re.compile(rf"{VALUE}|{PERIOD}", re.I)
BLANK = " \t\n"
TO_DIGIT = re.compile(r"(?s:.*)\d")  # up to the last digit
is_value, is_period, is_cell = re.compile(VALUE).fullmatch, PERIODS.fullmatch, CELLS.fullmatch

KINDS = CAPTION_AT, SECTION_AT, HEADER_AT, ROW_AT = range(4)
FOUND = "at long, what int, stop long, text string, width int"


class Labels:
    """Finds where the labels of a stream's rows begin. ``barriers`` are spans (start, stop) that no label holds, in order."""

    def __init__(self, stream: str, barriers: list[tuple[int, int]]) -> None:
        self.stream, self.starts, self.stops = stream, [b[0] for b in barriers], [b[1] for b in barriers]

    def _after_blank(self, at: int, leader: int) -> int:
        while at < leader and self.stream[at] in BLANK:
            at += 1
        return at

    def _barrier(self, at: int, leader: int) -> int:
        """The end of the barriers that reach beyond a place or begin between it and the leader, 0 for none."""
        first, last = bisect_right(self.starts, at), bisect_right(self.starts, leader - 1)
        if first and self.stops[first - 1] > at:
            first -= 1
        return max(self.stops[first:last]) if first < last else 0

    def _line_before(self, at: int) -> int:
        """Where the line begins that ends at a place."""
        line = self.stream.rfind("\n", 0, at) + 1
        return line if line < at else self.stream.rfind("\n", 0, max(at - 1, 0)) + 1

    def _belongs(self, piece: str) -> bool:
        """Whether a piece before a label is part of a name: it has letters, no leader, and less than three cells that stand alone."""
        if "..." in piece or not LETTERS.search(piece):
            return False
        words = piece.split()
        return len(words) < 3 or sum(1 for w in words if is_cell(w)) < 3

    def _number_before(self, near: int, leader: int) -> int:
        """The end of the last number between two places, ``near`` for none. It holds the last digit; only commas after that can belong to it too."""
        digit = TO_DIGIT.match(self.stream, near, leader)
        if digit is None:
            return near
        at = digit.end()
        return at if at == leader or self.stream[at] != "," else near + max(m.end() for m in NUMBERS.finditer(self.stream[near:leader]))

    def begin(self, leader: int, done: int) -> int | None:
        """Where the label of the row with this leader begins, none if it has no label; ``done`` is the end of the row before."""
        at = self._number_before(max(0, leader - LABEL_NEAR), leader)
        barrier = self._barrier(at, leader)
        at = self._after_blank(max(at, barrier), leader)
        # Dashes at the front are values of the row before that stand for no data.
        while at < leader and self.stream[at] == "-" and (at + 1 >= leader or self.stream[at + 1].isspace()):
            at = self._after_blank(at + 1, leader)
        if at >= leader:
            return None
        behind = bisect_right(self.starts, at) - 1
        floor = max(barrier, done, leader - LABEL_WITHIN, self.stops[behind] if behind >= 0 else 0)
        # The number may be part of the name: lines before it are taken back as long as they belong to one.
        while at > floor:
            start = max(self._line_before(at), floor)
            if not self._belongs(self.stream[start:at]):
                break
            at = self._after_blank(start, leader)
        return at


def table_rows(stream: str, barriers: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """(begin, leader, stop) of the table rows of a stream, none of which overlaps the one before or holds a barrier in its label."""
    labels, done = Labels(stream, barriers), 0
    for leader in LEADERS.finditer(stream):
        begin = labels.begin(leader.start(), done)
        values = None if begin is None else VALUES.match(stream, leader.end())
        if values:
            done = values.end()
            yield begin, leader.start(), done


def width(row: str) -> int:
    """How many values a row has after its leader."""
    cut = LEADERS.search(row)
    return sum(1 for w in (row[cut.end() :] if cut else row).split() if is_value(w))


def scan(stream: str, titles: set[str]) -> list[tuple[int, int, int, str, int | None]]:
    """(at, what, stop, text, width) of all that a stream holds, in order: captions, sections (lines that are titles), headers (lines of period names) and rows."""
    found = [(m.start(), CAPTION_AT, m.end(), m.group().strip(), None) for m in CAPTIONS.finditer(stream)]
    at = 0
    for line in stream.split("\n"):
        text, words = line.strip(" "), line.split()
        if text in titles:
            # A section's place is its line's; as a barrier it ends with its words.
            found.append((at, SECTION_AT, at + len(line.rstrip(" ")), text, None))
        if len(words) >= LABELS and is_period(words[0]) and all(is_period(w) for w in words):
            found.append((at, HEADER_AT, at + len(line), text, len(words)))
        at += len(line) + 1
    barriers = sorted((f[0], f[2]) for f in found if f[1] in (CAPTION_AT, SECTION_AT))
    for begin, leader, stop in table_rows(stream, barriers):
        # All words behind the row's leader are values; only dots in its label begin earlier.
        row = stream[begin:stop]
        found.append((begin, ROW_AT, stop, row, width(row) if "..." in stream[begin:leader] else len(row[leader - begin :].lstrip(".").split())))
    return sorted(found, key=itemgetter(0, 1))


def scanned(keys: int):
    """For mapInArrow: rows (keys, text, titles) to rows (keys, at, what, stop, text, width), one for each event of ``scan``."""
    kinds = [("at", pa.int64()), ("what", pa.int32()), ("stop", pa.int64()), ("text", pa.string()), ("width", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, of = [], []
            for n, (text, titles) in enumerate(zip(batch.column(keys).to_pylist(), batch.column(keys + 1).to_pylist())):
                events = scan(text or "", set(titles or ()))
                found += events
                of += [n] * len(events)
            if found:
                columns = [pa.array(c, t) for c, (_, t) in zip(zip(*found), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(of)) for i in range(keys)] + columns, [*batch.schema.names[:keys], *(k for k, _ in kinds)])

    return run
