"""Language identification by cross-parsing.

A suffix automaton of each language's labelled text gives longest matches. A document, its letters in lower
case and a space for each run of other characters, is parsed from left to right into the fewest phrases that
occur in that text; a phrase may span words. The language that needs the fewest phrases per character wins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import id_remainder, table

#: The automaton of a language holds about this many characters of labelled text at most; documents are taken whole, in the order of a hash of their id.
SAMPLE_CHARS = 100_000
MAX_LANGUAGES = 500  # beyond it, samples would be too much for one task: an error
_other = regex.compile(r"[^\p{L}\p{M}]+")  # marks belong to the letters before them
_letter = regex.compile(r"\p{L}").search
_models: dict[int, "Parser"] = {}


def normal(text: str) -> str:
    """Letters in lower case, and one space for each run of other characters."""
    return _other.sub(" ", text.lower())


class SuffixAutomaton:
    """All substrings of a text; a state is the dictionary of the states that one more character leads to."""

    def __init__(self, text: str):
        step: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            cur = len(length)
            length.append(length[last] + 1)
            link.append(0)
            step.append({})
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = cur
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    step.append(dict(step[q]))
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        for state in step:
            for c, to in state.items():
                state[c] = step[to]
        self.root = step[0]

    def phrases(self, text: str) -> int:
        """Phrases of the greedy parse: each is the longest match from its start, or one unknown character."""
        state = root = self.root
        n = 0
        for c in text:
            if c in state:
                state = state[c]
            else:
                n += state is not root
                if c in root:
                    state = root[c]
                else:
                    n += 1
                    state = root
        return n + (state is not root)


class Parser:
    """Cross-parsing of texts by the automata of all languages."""

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        self.automata = [SuffixAutomaton(f" {normal(texts[lang])} ") for lang in self.langs]

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and the runner-up's share of the phrases of the best two (0.5: a tie, which the first name wins)."""
        if not text or not self.langs or not _letter(text):
            return "und", 0.0
        plain = normal(text)
        counts = np.array([a.phrases(plain) for a in self.automata])
        order = np.argsort(counts, kind="stable")
        if len(order) == 1:
            return self.langs[0], 1.0
        best, second = counts[order[0]], counts[order[1]]
        return self.langs[order[0]], float(second / (best + second))


def training_texts(docs: DataFrame, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Labelled text of each language outside the held-out fold, of about ``chars`` characters at most.

    Documents of at most a quarter of that are taken whole, in the order of a hash of their id, until the size is reached; a language that has
    only longer ones gives its shortest. More than MAX_LANGUAGES languages are an error.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(id_remainder(F.col("doc_id"), 4) != 2)
    known = known.select("lang", "text", F.length("text").alias("n"), F.xxhash64("doc_id").alias("h"))
    fits = F.col("n") <= chars // 4
    total = known.groupBy("lang").agg(F.sum(F.when(fits, F.col("n"))).alias("total"), F.min(F.when(fits, F.col("h"))).alias("first"), F.min(F.struct("n", "h")).alias("shortest"))
    if total.count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # Four times the wanted size in expectation, before the ordered sum per language.
    drawn = (F.col("n") <= chars // 4) & ((F.col("h") == F.col("first")) | F.expr(f"pmod(h, 1000000) < 1000000 * ({4 * chars} / greatest(total, 1))"))
    only = F.col("total").isNull() & (F.struct("n", "h") == F.col("shortest"))
    some = known.join(F.broadcast(total), "lang").where(drawn | only).select("lang", "text", "n", "h")
    order = W.partitionBy("lang").orderBy("h", "text")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    some = some.withColumn("before", before).where((F.col("before") == 0) | (F.col("before") + F.col("n") <= chars))
    out: dict[str, list] = {}
    for r in some.select("lang", "h", "text").collect():
        out.setdefault(r.lang, []).append((r.h, r.text))
    return {lang: " ".join(t for _, t in sorted(rows)) for lang, rows in out.items()}


def _predict(texts: dict[str, str]) -> Callable:
    model_key = hash(tuple(sorted(texts.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_key not in _models:  # one build per Python worker
            _models.clear()
            _models[model_key] = Parser(texts)
        parser = _models[model_key]
        for b in batches:
            got = [parser.predict(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, texts: dict[str, str]) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text.

    ``und`` and 0 where the text is null or has no letter, or no language was learned. Repeated rows
    come out as often as they went in; extra columns are ignored, and an empty table gives an empty result.
    """
    id_type = dict(docs.dtypes)["doc_id"]
    out = docs.select("doc_id", "text").mapInArrow(_predict(texts), f"doc_id {id_type}, lang_pred string, score double")
    return out.select("doc_id", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, training_texts(docs))


QUERIES = {"op8_language": op8_language}
SQL: dict[str, str] = {}
