"""Toxicity scores from a linear classifier over character n-grams.

A text's features are the hashed n-grams of three to five characters that occur in it, each scaled by
its naive Bayes log-count ratio between the two labels; ridge logistic regression weighs them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import id_remainder, stored, table

ORDERS, BUCKETS = (3, 4, 5), 1 << 20
#: The classifier is fitted on about this many labelled rows at most, taken by a hash of their id.
MAX_TRAINING_ROWS = 12_000
#: So many n-grams, those whose presence tells the labels apart best (chi-square), carry weights.
MAX_FEATURES, MIN_CHI2, RIDGE = 1024, 12.0, 1.0
CHUNK = 1 << 17  # characters at once; a longer text is read in slices
U = np.uint64


def _grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text) of all n-grams of each order within the texts."""
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    h = c + U(1)
    for n in range(2, max(ORDERS) + 1):
        if len(c) < n:
            return
        h = h[: len(c) - n + 1] * U(0x9E3779B97F4A7C15) + c[n - 1 :] + U(1)
        if n in ORDERS:
            bucket = (((h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)) >> U(44)).astype(np.int32)
            inside = doc[: len(bucket)] == doc[n - 1 :]
            yield bucket[inside], doc[: len(bucket)][inside]


def _groups(column: pa.Array) -> Iterator[list[str]]:
    """Texts in order, so many as hold CHUNK characters at most, or one longer text."""
    held, size = [], 0
    for x in column:
        text = f" {(x.as_py() or '').lower()} "
        if held and size + len(text) > CHUNK:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def _distinct(texts: list[str], used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the n-grams of a group, each once a text, sorted; of those that ``used`` names if it is given."""
    if len(texts) == 1 and len(texts[0]) > CHUNK:
        seen, over = np.zeros(BUCKETS, bool), max(ORDERS) - 1
        for at in range(0, len(texts[0]) - over, CHUNK - over):
            for bucket, _ in _grams([texts[0][at : at + CHUNK]]):
                seen[bucket] = True
        bucket = np.flatnonzero(seen if used is None else seen & used)
        return np.zeros(len(bucket), np.int64), bucket
    keys = [np.empty(0, np.int64)]
    for bucket, doc in _grams(texts):
        if used is not None:
            some = used[bucket]
            bucket, doc = bucket[some], doc[some]
        keys.append(doc.astype(np.int64) * BUCKETS + bucket)
    keys = np.unique(np.concatenate(keys))
    return keys // BUCKETS, keys % BUCKETS


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, p, q): toxic and other texts of a task that hold an n-gram of the bucket. Columns: text, label."""
    counts = np.zeros((2, BUCKETS), np.int32)
    for b in batches:
        labels, first = b.column(1).to_numpy() == 1, 0
        for texts in _groups(b.column(0)):
            doc, bucket = _distinct(texts)
            toxic = labels[first + doc]
            np.add.at(counts[0], bucket[toxic], 1)
            np.add.at(counts[1], bucket[~toxic], 1)
            first += len(texts)
    some = np.flatnonzero(counts.any(axis=0))
    for at in range(0, len(some), 100_000):
        part = some[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[0, part]), pa.array(counts[1, part])], ["bucket", "p", "q"])


def choose(counts: DataFrame, pos: int, neg: int) -> tuple[list[int], list[float]]:
    """The buckets that tell ``pos`` toxic texts from ``neg`` others best, in order, and their log-count ratios.

    ``counts`` are (bucket, p, q), p and q below 2^31. At most MAX_FEATURES rows come to the driver.
    """
    total = counts.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("p"), F.coalesce(F.sum("q"), F.lit(0)).alias("q")).first()
    p, q = F.col("p").cast("double"), F.col("q").cast("double")
    df, n = p + q, float(pos + neg)
    chi2 = n * F.pow(p * (neg - q) - q * (pos - p), F.lit(2.0)) / (float(pos) * neg * df * (n - df))
    ratio = F.log((p + 1) / float(total.p + BUCKETS)) - F.log((q + 1) / float(total.q + BUCKETS))
    some = counts.where((df >= 3) & (df < n)).select("bucket", chi2.alias("chi2"), ratio.alias("ratio")).where(F.col("chi2") >= MIN_CHI2)
    best = sorted((r.bucket, r.ratio) for r in some.orderBy(F.col("chi2").desc(), "bucket").limit(MAX_FEATURES).collect())
    return [b for b, _ in best], [r for _, r in best]


def _occurring(buckets: list[int]) -> Callable:
    """label and the numbers of the chosen buckets that occur in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.full(BUCKETS, -1, np.int32)
        number[buckets] = np.arange(len(buckets))
        used = number >= 0
        for b in batches:
            first = 0
            for texts in _groups(b.column(0)):
                doc, bucket = _distinct(texts, used)
                at = np.searchsorted(doc, np.arange(len(texts) + 1))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(number[bucket]))
                yield pa.RecordBatch.from_arrays([b.column(1).slice(first, len(texts)), lists], ["label", "at"])
                first += len(texts)

    return run


def fit(labels: np.ndarray, lists: list[np.ndarray], ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Regression weights of the features and the intercept. A list has the features of a text, which count ``ratio`` each."""
    y, k = (labels == 1).astype(float), len(ratio)
    x = np.zeros((len(y), k + 1), np.float32)
    for i, at in enumerate(lists):
        x[i, at] = ratio[at]
    x[:, -1] = 1
    blocks = [slice(i, i + 1000) for i in range(0, len(y), 1000)]
    penalty = np.r_[np.full(k, RIDGE), 1e-6]
    w = np.zeros(k + 1)
    w[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    times = lambda v: np.concatenate([x[b] @ v for b in blocks])
    loss = lambda v: np.logaddexp(0, z := times(v)).sum() - y @ z + 0.5 * (penalty * v * v).sum()
    for _ in range(12):  # Newton steps of a convex loss, each halved until it lowers the loss
        s = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        curve, slope = np.diag(penalty), -penalty * w
        for b in blocks:
            part = x[b].astype(float)
            curve = curve + (part * (s[b] * (1 - s[b]))[:, None]).T @ part
            slope = slope + part.T @ (y[b] - s[b])
        step = np.linalg.solve(curve, slope)
        now, size = loss(w), 1.0
        while size > 1e-3 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-5:
            break
    return w[:-1], float(w[-1])


def _train(ratio: list[float]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, lists = [], []
        for b in batches:
            labels.append(b.column(0).to_numpy())
            flat, at = b.column(1).values.to_numpy(), b.column(1).offsets.to_numpy()
            lists += [flat[x:z].astype(np.int16) for x, z in zip(at[:-1], at[1:])]  # so the batch itself can go
        weights, bias = fit(np.concatenate(labels), lists, np.array(ratio))
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps({"weights": weights.tolist(), "bias": bias})])], ["model"])

    return run


def train(docs: DataFrame, labels: DataFrame, rows: int = MAX_TRAINING_ROWS) -> dict:
    """The classifier from labelled documents outside the held-out fold: buckets, their weights (log-count ratios times regression weights) and the intercept.

    Of labels that disagree about one id the toxic one counts; null labels are left out. At most about ``rows`` labelled
    rows, chosen by a hash of their id and of distinct texts, are used. Spark counts in how many of them each n-gram
    occurs; the chosen n-grams of each, not its text, meet in one task, and at most 1,024 weights come to the driver.
    Without rows of both labels the score is the share of toxic ones.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(id_remainder(F.col("doc_id"), 5) != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("label"))
    share = min(1.0, rows / max(1, known.count()))
    some = known.where(F.expr(f"pmod(xxhash64(doc_id), 1000000) < {round(share * 1e6)}"))
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    sample = stored(sample.groupBy(F.xxhash64("text").alias("k")).agg(F.max("text").alias("text"), F.max("label").alias("label")).drop("k"), "labelled")
    sample = sample.select("text", F.col("label").cast("int"))
    size = sample.agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg")).first()
    if not size.pos or not size.neg:
        return {"buckets": [], "weights": [], "bias": float(np.log((size.pos + 1) / (size.neg + 1)))}
    counts = sample.mapInArrow(_frequencies, "bucket int, p int, q int").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    buckets, ratio = choose(stored(counts, "frequencies"), size.pos, size.neg)
    (row,) = sample.mapInArrow(_occurring(buckets), "label int, at array<int>").repartition(1).mapInArrow(_train(ratio), "model string").collect()
    model = json.loads(row.model)
    return {"buckets": buckets, "weights": [w * r for w, r in zip(model["weights"], ratio)], "bias": model["bias"]}


def _scorer(model: dict) -> Callable[[pa.Array], np.ndarray]:
    used, weight = np.zeros(BUCKETS, bool), np.zeros(BUCKETS)
    used[model["buckets"]] = True
    weight[model["buckets"]] = model["weights"]

    def score(column: pa.Array) -> np.ndarray:
        out = [np.empty(0)]
        for texts in _groups(column):
            doc, bucket = _distinct(texts, used)
            z = np.bincount(doc, weight[bucket], len(texts)) + model["bias"]
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return np.concatenate(out)

    return score


def _score(model: dict) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score(b.column(1)))], ["doc_id", "score"])

    return run


def scores(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text; null counts as empty and gets the score of no n-gram.

    Repeated rows come out as often as they went in; extra columns are ignored. A null id is held out.
    """
    id_type = dict(docs.dtypes)["doc_id"]
    out = docs.select("doc_id", "text").mapInArrow(_score(model), f"doc_id {id_type}, score double")
    return out.select("doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns.

    Each row is scored and passed on, or not, where it stands: no join, and rows that share an id are told apart. Null
    texts count as empty, repeated rows stay as often as they come, and an empty table stays empty.
    """
    model, at = train(docs, labels), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(model)
        for b in batches:
            yield b.filter(pa.array(score(b.column(at)) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scores(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op6_toxicity": op6_toxicity}
SQL: dict[str, str] = {}
