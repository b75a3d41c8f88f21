"""Compression of vectors to codes by a codebook for each part of them, over a trie of the parts' values.

Distinct parts in order of their components make a trie. Its depth-first traversal keeps one array of distances to all entries a node,
to which a component adds its own: parts that begin alike share the sums of what they have in common. A leaf takes the nearest
entry and adds its part to that entry, as often as the part occurs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_type, on_workers, stored, table

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
BROADCAST_LABELS, SALTS = 1_000_000, 16  # sums of labels that are broadcast at most (16 MB); beyond it rows and sums meet by label and salt


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest entry for each of the distinct ``parts``, which are in ascending order; ties go to the lower entry."""
    n, width = parts.shape
    code, error = np.zeros(n, np.int64), np.zeros(n, np.int64)
    stack = [(0, n, 0, np.zeros(len(book), np.int64))] if n and width else []
    while stack:
        lo, hi, at, so_far = stack.pop()
        column = parts[lo:hi, at]
        starts = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
        sizes = np.diff(np.append(starts, hi - lo))
        shared = so_far + (column[starts, None] - book[:, at]) ** 2
        leaf = sizes == 1
        rows = lo + starts[leaf]
        if len(rows):  # branches with one part left end together
            far = shared[leaf]
            for rest in range(at + 1, width):
                far += (parts[rows, rest, None] - book[:, rest]) ** 2
            code[rows] = far.argmin(1)
            error[rows] = far.min(1)
        for child in np.flatnonzero(~leaf)[::-1]:
            first = lo + int(starts[child])
            stack.append((first, first + int(sizes[child]), at + 1, shared[child]))
    return code, error


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of a column as rows; those of other lengths than the first vector's are an error, as is a distance that might pass a long."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(values) != width * len(column) or (np.diff(column.offsets.to_numpy()) != width).any():
        raise ValueError(f"vectors of other lengths than {width}")
    if len(values) and width * (2 * max(int(values.max()), -int(values.min()))) ** 2 >= 1 << 63:
        raise ValueError("a squared distance might pass a long")
    return values.reshape(len(column), width)


def _coded(vectors: np.ndarray, books: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each part position: distinct parts, their number, entry and distance, and which of them each vector has."""
    size = vectors.shape[1] // PARTS
    for p, book in enumerate(books):
        piece = vectors[:, p * size : (p + 1) * size]
        if size:
            distinct, which, times = np.unique(piece, axis=0, return_inverse=True, return_counts=True)
        else:
            distinct, which, times = piece[:1], np.zeros(len(piece), np.int64), np.array([len(piece)])
        yield distinct, times, *nearest(distinct, book), which.reshape(-1)


def _sums(books: np.ndarray):
    """Sums of the parts of each entry: (part, entry, n, sums), one row an entry and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, times_of = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for p, (distinct, times, code, _, _) in enumerate(_coded(_matrix(batch.column(0), books.shape[0] * books.shape[2]), books)):
                np.add.at(total[p], code, distinct * times[:, None])
                np.add.at(times_of[p], code, times)
        part, entry = np.nonzero(times_of)
        if len(part):
            columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(times_of[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "sums"])

    return run


def _encode(books: np.ndarray, id_type: pa.DataType, label_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(2), books.shape[0] * books.shape[2])
            code, error = np.zeros((len(batch), PARTS), np.uint8), np.zeros(len(batch), np.int64)
            for p, (_, _, entry, far, which) in enumerate(_coded(vectors, books)):
                code[:, p] = entry[which]
                error += far[which]
            columns = [batch.column(0).cast(id_type), batch.column(1).cast(label_type), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "code", "error"])

    return run


def codebooks(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> np.ndarray:
    """Entries (part, entry, component) fitted to ``vectors`` (id, vector: integers): the parts of the vectors of the smallest ids, moved
    ``rounds`` times to the floor of the mean of the parts nearest to them. Only sums, as many as all entries have components, come to the driver."""
    first = [r.vector for r in vectors.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()]
    width = len(first[0]) if first else 0
    if width % PARTS or any(len(v) != width for v in first):
        raise ValueError(f"vectors have no one length that is a multiple of {PARTS}")
    books = np.array(first, np.int64).reshape(len(first), PARTS, width // PARTS).transpose(1, 0, 2).copy()
    for _ in range(rounds if width else 0):
        sums = vectors.select("vector").mapInArrow(_sums(books), "part int, entry int, n long, sums array<long>")
        each = sums.select("part", "entry", "n", F.posexplode("sums").alias("at", "v")).groupBy("part", "entry", "at")
        for r in each.agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(20,0)")).alias("v")).collect():
            books[r.part, r.entry, r.at] = int(r.v) // r.n
    return books


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every vector without null or non-finite components.

    Components become integers, floor(4096 x). Codes are the entries of the eight parts as hex digits; ``error`` is the squared distance of
    all parts, ``label_error`` its sum over equal labels, nulls together. Vectors need one length, a multiple of eight (else an error). Fewer
    than 16 vectors give as many entries; of equal ids the smaller vector comes first, a null id last; repeated rows are coded as often as
    they occur, other columns are left out, and an empty table gives an empty result. Vectors are written once as integers and never shuffled.
    """
    on_workers(vectors.sparkSession)
    x = F.col(vector_col)
    fine = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    whole = F.transform(x, lambda v: F.floor(F.lit(float(SCALE)) * v.cast("double")))
    rows = vectors.where(fine).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), whole.alias("vector"))
    rows = stored(rows, "vectors")
    books = codebooks(rows)
    kinds = dict(rows.dtypes)
    made = rows.mapInArrow(_encode(books, arrow_type(rows, "id"), arrow_type(rows, "label")), f"id {kinds['id']}, label {kinds['label']}, code string, error long")
    made = stored(made, "codes")
    totals = stored(made.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "label-errors")
    if totals.count() <= BROADCAST_LABELS:
        held = made.join(F.broadcast(totals), F.expr("label <=> of"))
    else:
        salted = totals.withColumn("salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        held = made.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int")).join(salted, F.expr("label <=> of AND salt = salt_of"))
    digest = hashlib.sha256(",".join(str(v) for v in books.reshape(-1)).encode()).hexdigest()
    return held.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """Six rounds one below the other: assignment (a), then means (b)."""
    far = "list_sum(list_transform(list_zip(x, c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS r, * FROM (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0))""",
        f"p AS MATERIALIZED (SELECT r, k AS part, x[k * len(x) // {PARTS} + 1 : (k + 1) * len(x) // {PARTS}] AS x FROM v, range({PARTS}) t(k))",
        f"b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS c FROM p WHERE r <= {ENTRIES})",
    ]
    for n in range(ROUNDS + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, part, min({{'far': far, 'entry': entry}}) AS m FROM (SELECT r, part, entry, {far} AS far FROM p JOIN b{n} USING (part)) GROUP BY r, part)")
        if n < ROUNDS:
            mean = f"(SELECT part, m.entry AS entry, i, count(*) AS n, sum(x[i]) AS s FROM (SELECT part, m, x, unnest(range(1, len(x) + 1)) AS i FROM a{n} JOIN p USING (r, part)) GROUP BY part, m.entry, i)"
            steps.append(f"m{n} AS MATERIALIZED (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM {mean} GROUP BY part, entry)")
            steps.append(f"b{n + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.c, b.c) AS c FROM b{n} b LEFT JOIN m{n} m USING (part, entry))")
    return f"""WITH {", ".join(steps)},
      e AS (SELECT r, string_agg(printf('%02x', CAST(m.entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(m.far) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r),
      h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})
      SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN e USING (r), h"""


QUERIES = {"op12_vector_codes": op12_vector_codes}
SQL = {"op12_vector_codes": _sql()}
