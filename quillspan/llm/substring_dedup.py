"""Removal of passages that repeat anywhere in a corpus: recurring windows are confirmed, then automata of them read every document.

A window is 35 consecutive words. Its anchor is the smallest hash of eight consecutive words in it, so equal windows have
equal anchors. Anchors are counted over the corpus, and those that occur once go back to their document. What is left of its
windows is counted in the same way. Passages of windows that do recur are compiled into Aho-Corasick automata, one shard
for a batch of documents, which locate every occurrence of them in the batch, word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_type, on_workers, table

WINDOW, GRAM = 35, 8
SLIDE = WINDOW - GRAM + 1  # grams of a window
PIECE, SHARD = 2_000, 400_000  # words of a passage in an automaton, and of all passages in one
ROW = 50_000  # hashes of a row at most
U = np.uint64
STEP = U(0xD1342543DE82EF95), U(0xAF251AF3B0F025B5)  # odd: bases of the polynomials over words
INSIDE = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])  # bytes of words
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U)  # masks of a number's first bytes
LONG_WORD = 1 << 12  # bytes; longer words are hashed one by one


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[U(1)], np.full(max(n - 1, 0), base, U)]), dtype=U)[:n]


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column in a row, and where each begins (with the end of the last)."""
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of a column of texts, and where each text's words begin (with the end of the last)."""
    data, at = _texts(column)
    inside = INSIDE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = at[:-1][at[:-1] < len(data)]
    first[begins] = inside[begins]
    last = inside
    last[:-1] &= ~inside[1:] | first[1:]
    starts, size = np.flatnonzero(first), np.flatnonzero(last) + 1
    size -= starts
    # Eight bytes at a time, of the words that have so many.
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    words, left, done = size.astype(U) * STEP[0], np.arange(len(starts)), 0
    while len(left) and done < LONG_WORD:
        rest = size[left] - done
        words[left] = _mixed(words[left] ^ (eight[starts[left] + done] & FIRST[np.minimum(rest, 8)]))
        left, done = left[rest > 8], done + 8
    for n in left:
        words[n] = int.from_bytes(hashlib.blake2b(data[starts[n] : starts[n] + size[n]].tobytes(), digest_size=8).digest(), "little")
    return words, np.searchsorted(starts, at)


def _runs(words: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """A hash of every n consecutive words, mixed; as many as there are words (those that pass the end mean nothing)."""
    total = np.zeros(len(words) + 1, U)
    power = _powers(base, len(words))
    np.cumsum(words * power, out=total[1:], dtype=U)
    out = np.zeros(len(words), U)
    m = max(len(words) - n + 1, 0)
    # Divided by the power of their start, so that equal words give equal hashes wherever they stand.
    out[:m] = (total[n:] - total[:m]) * _powers(U(pow(int(base), -1, 1 << 64)), len(words))[:m]
    return _mixed(out)


def _slide(x: np.ndarray, n: int, best: np.ufunc, fill: int) -> np.ndarray:
    """``best`` of every n consecutive values from each place on; beyond the end stands ``fill``."""
    shifted = lambda y, k: np.concatenate([y[k:], np.full(min(k, len(y)), fill, U)])
    done = 1
    while 2 * done <= n:
        x, done = best(x, shifted(x, done)), 2 * done
    return best(x, shifted(x, n - done)) if n > done else x


def _anchors(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of eight words, the anchor of the window that begins at each word, and whether one does (no window crosses texts)."""
    grams = _runs(words, GRAM, STEP[0])
    whole = np.zeros(len(words), bool)
    left = np.repeat(counts[1:], np.diff(counts)) - np.arange(len(words))
    whole[:] = left >= WINDOW
    return grams, np.where(whole, _slide(grams, SLIDE, np.minimum, (1 << 64) - 1), U(0)), whole


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.zeros(0, U)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64) if kind == pa.int64() else flat.astype(np.int32), kind))


def _flat(column: pa.Array) -> np.ndarray:
    """All values of a column of lists of 64-bit numbers; nulls have none."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).astype(np.int64).view(U)


def _count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, hs): the anchors of a text, each place once."""
    for batch in batches:
        words, counts = _words(batch.column(1))
        grams, anchors, _ = _anchors(words, counts)
        # A place is an anchor if its hash is the largest of the anchors of all windows that hold it: it is none of theirs otherwise.
        held = _slide(anchors[::-1], SLIDE, np.maximum, 0)[::-1]
        at = np.flatnonzero((held == grams) & (held > 0))
        text = np.searchsorted(counts, at, "right") - 1
        keys, parts = [], []
        cuts = np.searchsorted(text, np.arange(len(batch) + 1))
        for n in np.unique(text):
            for lo in range(cuts[n], cuts[n + 1], ROW):
                keys.append(batch.column(0)[int(n)].as_py())
                parts.append(grams[at[lo : min(lo + ROW, cuts[n + 1])]])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), _lists(parts, pa.int64())], ["key", "hs"])


def _candidates(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows (first words, two hashes) whose anchor is none of those (third column) that occur once, and where texts' words begin."""
    words, counts = _words(batch.column(1))
    _, anchors, whole = _anchors(words, counts)
    at = np.flatnonzero(whole & ~np.isin(anchors, _flat(batch.column(2))))
    h1 = _runs(words, WINDOW, STEP[0])[at]
    h2 = (_runs(_mixed(words ^ STEP[1]), WINDOW, STEP[1])[at] >> U(33)).astype(np.int64)
    return at, h1, h2, counts


def _count_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, h1, h2): hashes of the candidate windows of a text."""
    for batch in batches:
        at, h1, h2, counts = _candidates(batch)
        cuts = np.searchsorted(at, counts)
        for n in np.flatnonzero(np.diff(cuts)):
            for lo in range(cuts[n], cuts[n + 1], ROW):
                part = slice(lo, min(lo + ROW, cuts[n + 1]))
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[int(n)].as_py()], pa.int64()), _lists([h1[part]], pa.int64()), _lists([h2[part]], pa.int32())], ["key", "h1", "h2"])


def _passages(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Words (first, end) of the passages that windows at these places make up, in pieces that share all but a window's last word."""
    if len(at):
        breaks = np.flatnonzero(np.diff(at) > 1)
        for first, last in zip(at[np.r_[0, breaks + 1]], at[np.r_[breaks, len(at) - 1]]):
            for lo in range(int(first), int(last) + 1, PIECE - WINDOW + 1):
                yield lo, min(lo + PIECE, int(last) + WINDOW)


def _located(texts: list[list[bytes]], passages: set[tuple[bytes, ...]]) -> list[np.ndarray]:
    """Which words of each text stand in an occurrence of a passage: automata over the passages' words, a shard at a time, read all texts."""
    import ahocorasick

    hit = [np.zeros(len(ws) + 1, np.int64) for ws in texts]
    todo = sorted(passages)
    while todo:
        ids: dict[bytes, int] = {}
        shard, size = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), 0
        while todo and size < SHARD:
            passage = todo.pop()
            shard.add_word(tuple([ids.setdefault(w, len(ids) + 1) for w in passage]), len(passage))
            size += len(passage)
        shard.make_automaton()
        for ws, marks in zip(texts, hit):
            for end, n in shard.iter(tuple(map(ids.get, ws, repeat(0)))):
                marks[end + 1 - n] += 1
                marks[end + 1] -= 1
    return [np.cumsum(m)[:-1] > 0 for m in hit]


def _remove(id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
        for batch in batches:
            at, h1, h2, counts = _candidates(batch)
            once = _flat(batch.column(3))
            order = np.argsort(once, kind="stable")
            known = np.searchsorted(once[order], h1)
            known[known == len(once)] = 0
            single = (once[order[known]] == h1) & (_flat(batch.column(4)).view(np.int64)[order[known]] == h2) if len(once) else np.zeros(len(h1), bool)
            at = at[~single]
            data, begins = _texts(batch.column(1))
            texts = [data[begins[i] : begins[i + 1]].tobytes().split() for i in range(len(batch))]
            cuts, passages = np.searchsorted(at, counts), set()
            some = np.flatnonzero(np.diff(cuts))  # texts without a window that recurs hold no passage
            for n in some:
                passages |= {tuple(texts[n][lo:hi]) for lo, hi in _passages(at[cuts[n] : cuts[n + 1]] - counts[n])}
            gone = [np.zeros(len(ws), bool) for ws in texts]
            for n, hit in zip(some, _located([texts[n] for n in some], passages)):
                gone[n] = hit
            kept = [b" ".join(compress(ws, (~g).tolist()) if g.any() else ws) for ws, g in zip(texts, gone)]
            columns = [batch.column(0), pa.array([len(g) for g in gone], pa.int64()), pa.array([int(g.sum()) for g in gone], pa.int64())]
            digests = pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())
            yield pa.RecordBatch.from_arrays([columns[0].cast(id_type), *columns[1:], digests, pa.array(kept, pa.binary()).cast(pa.string())], names)

    return run


def once_only(rows: DataFrame, hashes: list[str]) -> DataFrame:
    """(key, lists of the hashes) of those hashes that occur in one of the ``rows`` (key, hashes) only: a sum and a smallest key
    tell so, both combined before the shuffle, so a frequent hash costs a row a task."""
    counted = rows.groupBy(*hashes).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key")).where("n = 1")
    return counted.groupBy("key").agg(F.collect_list(F.struct(*hashes)).alias("s")).select("key", *[F.col(f"s.{h}").alias(h) for h in hashes])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept): every document less the words of windows that also start elsewhere.

    A word is a run of characters other than space and ``\\x09-\\x0D``; ``kept`` are the words that stay, joined by one space. Windows
    are told by 95 bits over the whole corpus, repeats within a document and repeated rows included. A null text has no words, texts
    of fewer than 35 words lose none, null ids stay null, repeated rows lose all their windows, an empty table gives an empty
    result, and other columns are left out. Texts are shuffled once, by a hash of id and text, and of hot
    windows only counts move. A task holds one Arrow batch of documents and an automaton of at most 400,000 words of passages.
    """
    on_workers(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.xxhash64(F.col(id_col), text).alias("key"), text.alias("text"), F.col(id_col).alias("doc_id"))
    anchors = keyed.select("key", "text").mapInArrow(_count_anchors, "key long, hs array<long>").select("key", F.explode("hs").alias("h"))
    held = keyed.join(once_only(anchors, ["h"]), "key", "left")
    # The same columns as below, so that texts are shuffled once for both.
    windows = held.select("key", "text", "h", "doc_id").mapInArrow(_count_windows, "key long, h1 array<long>, h2 array<int>").select("key", F.inline(F.arrays_zip("h1", "h2")))
    held = held.join(once_only(windows, ["h1", "h2"]), "key", "left")
    id_type = dict(docs.dtypes)[id_col]
    return held.select("doc_id", "text", "h", "h1", "h2").mapInArrow(_remove(arrow_type(keyed, "doc_id")), f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string, kept string")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept")


#: Every window of every text against all others: a self-join on text.
OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, i, md5(array_to_string(ws[i : i + 34], ' ')) AS h FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)),
n AS (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM w),
g AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM n WHERE n > 1)),
e AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
k AS (SELECT r, count(*) AS kept, string_agg(word, ' ' ORDER BY p) AS text FROM e ANTI JOIN g USING (r, p) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(kept, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""

QUERIES = {"op13_substring_dedup": op13_substring_dedup}
SQL = {"op13_substring_dedup": OP13_SQL}
