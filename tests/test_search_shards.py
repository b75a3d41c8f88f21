"""A search is made within shards of turns: what is written does not grow with the turns that hold a stem, and no more than the places asked for come back."""

import random
from collections import Counter
from itertools import groupby

import numpy as np

from quillspan.operators import registry
from quillspan.operators.registry import TurnIndex, first_places, stems_within


def test_turns_of_a_stem_are_not_written(spark, tmp_path, monkeypatch):
    written, stored = {}, registry.stored

    def counted(df, what):
        out = stored(df, what)
        written[what] = out.count()
        return out

    turns = spark.range(400).selectExpr("id DIV 2 as conv_id", "id % 2 as turn", "concat('common usual w', id DIV 8, 'zzz') as text")
    index = TurnIndex(spark, str(tmp_path)).add(turns).add(spark.sql("SELECT CAST(NULL AS BIGINT) AS conv_id, 5L AS turn, 'common' AS text"))
    assert spark.read.parquet(str(tmp_path)).count() == 401  # a turn is one row, its words are not dealt alone
    questions = spark.createDataFrame([(q, q) for q in ("common", "usual COMMON", "common usual", "mmo", "common w7zzz")], "query_id string, question string")
    monkeypatch.setattr(registry, "stored", counted)
    some = [tuple(r) for r in index.search(questions, 7).collect()]
    assert sum(written.values()) < 100
    every = [tuple(r) for r in index.search(questions).collect()]
    assert Counter(r[0] for r in every) == {"common": 401, "mmo": 401, "common usual": 400, "usual COMMON": 400, "common w7zzz": 8}
    assert {r[1:3] for r in every if None in r} == {(None, 5)}
    best = sorted(every, key=lambda r: (r[0], -round(r[3], 9), -r[2], r[1] or -1))
    assert sorted(map(str, some)) == sorted(str(r) for _, of in groupby(best, lambda r: r[0]) for r in list(of)[:7])


def test_first_places_hold_the_best():
    rng = random.Random(5)
    for _ in range(100):
        n = rng.randint(1, 60)
        score = np.array([rng.choice([1.0, 2.0, 2.0 + 1e-10, 2.0 + 6e-10, 3.3]) for _ in range(n)])
        turn, conv = np.array([rng.randint(0, 5) for _ in range(n)]), np.array(rng.sample(range(n), n))
        for limit in (1, 5, 20):
            got = first_places(score, turn, conv, limit).tolist()
            best = sorted(range(n), key=lambda i: (-round(score[i], 9), -turn[i], conv[i]))[:limit]
            assert set(best) <= set(got) and len(set(got)) == len(got) <= 5 * limit
    assert first_places(np.zeros(9), np.zeros(9), np.arange(9), None).tolist() == list(range(9))


def test_stems_within_words():
    long = "x" * 20
    words, stems = ["oiloil", "gas", long + "oil", "ababab", "é" + long], ["oil", "abab", long, long + "y", "zzz", "xoil"]
    want = [(i, j, sum(w.startswith(s, k) for k in range(len(w)))) for i, w in enumerate(words) for j, s in enumerate(stems)]
    assert sorted(map(tuple, stems_within(words, stems).tolist())) == [w for w in want if w[2]]
    assert stems_within(words, []).shape == stems_within([], stems).shape == (0, 3)
