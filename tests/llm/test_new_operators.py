"""Conversation repair, vector codes and removal of repeated passages against plain versions, and on odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import conversation_repair as repair
from quillspan.llm import shared, substring_dedup, vector_codes
from tests.oracle import SMALL

EMPTY = hashlib.sha256(b"").hexdigest()
LEGAL = re.compile(r"(s?(ua)+)?\Z")


# ---- Conversations ------------------------------------------------------------------------------


@lru_cache(None)
def plain_repair(kinds):
    """The least (cost, audit) over all edits of each row and up to three insertions in each gap."""
    found = []
    for edits in product("KRD", repeat=len(kinds)):
        if any(e != "D" and f in ("blank", "duplicate") for e, (_, f) in zip(edits, kinds)):
            continue
        for gaps in product(range(3), repeat=len(kinds) + 1):
            audit = "".join("I" * g + e for g, e in zip(gaps, edits)) + "I" * gaps[-1]
            slots = [[c or "-"] if e == "K" else "ua" for g, e, (c, _) in zip(gaps, edits, kinds) for e, c in [*[("I", "")] * g, (e, c)] if e != "D"] + ["ua"] * gaps[-1]
            if any(LEGAL.match("".join(s)) for s in product(*slots)):
                cost = sum({"K": 0, "R": 3, "D": 4}[e] + 3 * (e != "D" and f == "truncated") for e, (_, f) in zip(edits, kinds)) + 3 * sum(gaps)
                found.append((cost, audit))
    return min(found)


def test_parsing_equals_all_edits():
    rng = random.Random(1)
    for _ in range(120):
        kinds = tuple((rng.choice("suat"), rng.choice(["", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randint(0, 3)))
        assert repair.best(repair.cells_of(list(kinds))) == plain_repair(kinds)


def test_all_splits_give_the_same_cells():
    """Cells combined in pairs are those of a chart over all spans and all of their splits."""
    rng = random.Random(2)
    for _ in range(20):
        kinds = [(rng.choice("suat"), rng.choice(["", "", "truncated", "blank"])) for _ in range(9)]
        chart = {(i, i + 1): repair.row_cells(*k) for i, k in enumerate(kinds)}
        for n in range(2, 10):
            for i in range(10 - n):
                ways = [repair.combined(chart[i, k], chart[k, i + n]) for k in range(i + 1, i + n)]
                assert all(w == ways[0] for w in ways)
                chart[i, i + n] = ways[0]
        assert repair.cells_of(kinds) == chart[0, 9]


TURNS = "conv_id long, turn long, role string, text string, at string, copies int"
ODD = [
    (1, 0, "user", "Hello there.", "x", 9), (1, 1, "assistant", "Yes!", None, 9), (2, None, "user", "a?", "x", 9), (2, None, None, None, "x", 9), (None, 1, "user", "b.", "x", 9), (None, 2, "", "c.", "x", 9),
    (3, 5, "user", "same.", "x", 9), (3, 5, "user", "same.", "x", 9), (3, 9, "user", "same.", "x", 9), (4, 1, "tool", "cut", "x", 9), (5, 1, "user", "w " * 200_000 + ".", "x", 9), (6, 3, "user", " \n\t", "x", 9),
]


def plain_report(rows):
    seen, kinds, made = set(), [], []
    for role, text in rows:
        t = text.strip(repair.SPACE)
        kinds.append((role[:1], "blank" if not t else "duplicate" if (role, text) in seen else "" if t[-1] in ".!?" else "truncated"))
        seen.add((role, text))
    cost, audit = plain_repair(tuple(kinds)) if len(kinds) <= 3 else repair.best(repair.cells_of(kinds))
    left = iter(rows)
    for e in audit:
        due = "assistant" if made and made[-1][0][0] == "u" else "user"
        if e == "I":
            made.append((due, ""))
        else:
            role, text = next(left)
            made += [] if e == "D" else [(role if e == "K" else due, text)]
    count = Counter(f for _, f in kinds)
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
    return count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest(), made


@pytest.mark.parametrize("span", [repair.SPAN, 1])
def test_odd_conversations(spark, span):
    """Nulls, repeated rows, empty roles, long texts and clashing names; whole and in spans."""
    shared.on_workers(spark)
    held = repair.damaged(spark.createDataFrame(ODD, TURNS))
    rows, want = held.collect(), defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.turn is not None, r.turn or 0, r.role, r.text)):
        want[r.conv_id] += [(r.role, r.text)] * r.copies
    got, made = {}, defaultdict(dict)
    for r in repair.repairs(held, True, span).collect():
        if r["at"] is None:
            assert r.conv_id not in got
            got[r.conv_id] = r
        else:
            made[r.conv_id][r["at"]] = (r.role, r.text)
    assert set(got) == {r[0] for r in ODD}
    for conv, r in got.items():
        *numbers, turns = plain_report(want[conv])
        assert [r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256] == numbers, conv
        assert [made[conv][i] for i in range(len(made[conv]))] == turns
        turn = {x.turn for x in rows if x.conv_id == conv and x.copies and x.turn is not None}
        assert r.gaps == (max(turn) - min(turn) + 1 - len(turn) if turn else 0)
    assert repair.repairs(held.limit(0), False, span).isEmpty()


def test_dropped_and_long_conversations(spark):
    """A conversation whose rows are all dropped has zeros; one of many rows is the same whole and in spans that are combined twice."""
    shared.on_workers(spark)
    rng = random.Random(3)
    rows = [(1, i, rng.choice(["user", "assistant", "system"]), rng.choice(["Fine.", f"Text {i}.", "", "cut off"]), 1) for i in range(9000)] + [(2, 0, "user", "gone.", 0)]
    held = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies long")
    whole, spans = ({r.conv_id: tuple(r) for r in repair.repairs(held, False, n).collect()} for n in (10_000, 8_000))
    assert whole == spans and len(whole) == 2
    assert whole[2][4:] == (0, 0, 0, 0, 0, 0, "", EMPTY) and len(whole[1][10].replace("I", "")) == 9000


# ---- Vectors ------------------------------------------------------------------------------------


def plain_codes(rows):
    kept = sorted(((i, [int(np.floor(4096 * float(np.float32(x)))) for x in v], n) for i, v, n in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    size = len(kept[0][1]) // 8
    part = lambda v, p: v[p * size : (p + 1) * size]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books = [[part(v, p) for _, v, _ in kept[:16]] for p in range(8)]
    near = lambda v, p: min(range(len(books[p])), key=lambda k: (far(part(v, p), books[p][k]), k))
    for _ in range(6):
        of = [[near(v, p) for p in range(8)] for _, v, _ in kept]
        for p in range(8):
            for k in range(len(books[p])):
                mine = [part(v, p) for (_, v, _), o in zip(kept, of) if o[p] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = [(i, "".join(f"{near(v, p):02x}" for p in range(8)), sum(far(part(v, p), books[p][near(v, p)]) for p in range(8)), n) for i, v, n in kept]
    total = Counter()
    for _, _, e, n in out:
        total[n] += e
    return [(i, c, e, total[n], digest) for i, c, e, n in out]


def test_nearest_equals_a_loop():
    rng = np.random.default_rng(1)
    for width, spread in ((1, 3), (3, 2), (5, 50), (8, 1)):
        parts = np.unique(rng.integers(-spread, spread, (300, width)), axis=0)
        book = rng.integers(-spread, spread, (7, width))
        code, error = vector_codes.nearest(parts, book)
        far = ((parts[:, None] - book[None]) ** 2).sum(2)
        assert (code == far.argmin(1)).all() and (error == far.min(1)).all()


@pytest.mark.parametrize("few", [False, True])
def test_odd_vectors(spark, monkeypatch, few):
    """Nulls, non-finite components, repeated rows and ids, null labels, clashing names; sums of labels broadcast and salted."""
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0 if few else 100)
    shared.on_workers(spark)
    rng = random.Random(4)
    rows = [(rng.randint(0, 30), [rng.uniform(-1, 1) for _ in range(16)], rng.choice([1, 2, None])) for _ in range(10 if few else 60)]
    rows += [rows[0], rows[0], (None, [0.5] * 16, None), (70, None, 1), (71, [None] * 16, 1), (72, [float("nan")] * 16, 1), (73, [float("inf")] + [0.0] * 15, 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, error int")
    assert sorted(map(tuple, vector_codes.compressed(df).collect()), key=repr) == sorted(plain_codes(rows), key=repr)
    assert vector_codes.compressed(df.limit(0)).isEmpty() and vector_codes.compressed(df.where("vec_id > 69")).isEmpty()
    with pytest.raises(ValueError):
        vector_codes.compressed(df.select("vec_id", F.slice("embedding", 1, 5).alias("embedding"), "label").where("vec_id < 60")).collect()


# ---- Passages -----------------------------------------------------------------------------------


def plain_kept(texts):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def run_passages(spark, texts):
    shared.on_workers(spark)
    df = spark.createDataFrame([(i, t, "h", 0, 1) for i, t in enumerate(texts)], "doc_id long, text string, h string, n_words int, key int")
    rows = sorted(substring_dedup.without_repeats(df).collect())
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in rows)
    return [(r.n_words, r.n_removed, r.kept_sha256) for r in rows]


def test_passages_equal_a_loop(spark):
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randint(0, 400)}" for _ in range(n)]
    shared_ = fresh(120)
    texts = [" ".join(fresh(30) + shared_[a : a + n] + fresh(40)) for a, n in ((0, 35), (0, 34), (20, 60), (50, 70), (80, 36), (60, 35))]
    texts += [" \n".join(shared_), "\t".join(shared_[10:50]), " ".join(["la"] * 34), " ".join(["la"] * 36), " ".join(["ha", "ho"] * 200), None, "", " \n ", "x" * 300_000, " ".join(fresh(20_000))]
    texts += [" ".join(fresh(34)), "same words " * 17, "same words " * 17, " ".join(["é ü"] + ["日本"] * 40), " ".join(["y" * 5_000] * 40), " ".join(shared_[:35]).upper()]
    assert run_passages(spark, texts) == plain_kept(texts)


def test_small_shards_and_pieces(spark, monkeypatch):
    """Passages in many pieces and automata, rows of few hashes, and few rows a batch give the same."""
    for name, n in (("PIECE", 40), ("SHARD", 50), ("ROW", 7)):
        monkeypatch.setattr(substring_dedup, name, n)
    rng = random.Random(6)
    pool = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(90)) for _ in range(4)]
    texts = [" ".join(rng.choice(pool)[rng.randint(0, 40) :] for _ in range(3)) for _ in range(12)]
    import pyarrow as pa

    column = pa.array(texts)
    keys = pa.array(range(len(texts)), pa.int64())
    once = lambda batches, names: {h for h, n in Counter(h for b in batches for h in zip(*(b.column(c).flatten().to_pylist() for c in names))).items() if n == 1}
    batch = pa.RecordBatch.from_arrays([keys, column], ["key", "text"])
    single = once(list(substring_dedup._count_anchors(iter([batch]))), [1])
    held = pa.RecordBatch.from_arrays([keys, column, pa.array([[h for (h,) in single]] * len(texts), pa.list_(pa.int64()))], ["key", "text", "h"])
    rare = sorted(once(list(substring_dedup._count_windows(iter([held]))), [1, 2]))
    full = pa.RecordBatch.from_arrays([*held.columns, pa.array([[a for a, _ in rare]] * len(texts), pa.list_(pa.int64())), pa.array([[b for _, b in rare]] * len(texts), pa.list_(pa.int32()))], ["doc_id", "text", "h", "h1", "h2"])
    (out,) = substring_dedup._remove(pa.int64())(iter([full]))
    assert list(zip(*(out.column(i).to_pylist() for i in (1, 2, 3)))) == plain_kept(texts)


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"n{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (None, text + " more"), (None, None), (7, "other words")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.without_repeats(df).collect()), key=repr)
    assert got == sorted([(1, 40, 40, ""), (1, 40, 40, ""), (None, 41, 40, "more"), (None, 0, 0, ""), (7, 2, 0, "other words")], key=repr)
    assert substring_dedup.without_repeats(df.limit(0)).isEmpty() and df.count() == 5
    alone = substring_dedup.without_repeats(spark.read.parquet(f"{SMALL}/documents.parquet").limit(1))
    assert alone.first().n_words >= 0
