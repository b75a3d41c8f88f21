"""Streams: restarts half-way, files that come twice, late turns, and histories of every prefix."""

import random

from quillspan.streaming import history, ingest


def test_restart_gives_the_same_store(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " * 400) for i in range(12)] + [(20, ""), (21, None)], "doc_id long, text string")
    for i, where in enumerate(("doc_id < 5", "doc_id >= 5", "doc_id BETWEEN 3 AND 6")):
        docs.where(where).coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
        store = ingest.ChunkStore(spark, str(tmp_path / "chunks"))
        ingest.ingest(spark, str(tmp_path / "docs"), store, str(tmp_path / "check"), 1)
        if i == 0:
            assert {r.doc_id for r in store.read().select("doc_id").distinct().collect()} == set(range(5))
    want = sorted(map(tuple, ingest.chunked(docs).collect()))
    assert sorted(map(tuple, store.read().collect())) == want == sorted(map(tuple, store.compact(9).read().collect()))
    again = ingest.ChunkStore(spark, str(tmp_path / "chunks"))
    ingest.ingest(spark, str(tmp_path / "docs"), again, str(tmp_path / "check"), 1)
    assert again.read().count() == len(want)
    # A batch that is written anew, as after a failure between the write and its commit, replaces itself.
    again.upsert(ingest.chunked(docs.where("doc_id = 7")), 2)
    again.upsert(ingest.chunked(docs.where("doc_id BETWEEN 3 AND 6")), 2)
    assert again.read().count() == len(want)


def test_histories_of_all_prefixes(spark, tmp_path):
    rng = random.Random(4)
    rows = [(c, t, "user", "x" * rng.randint(0, 1500)) for c in range(5) for t in range(12)]
    for part in range(4):
        spark.createDataFrame([r for r in rows if r[1] // 3 == part], history.TURNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        history.follow(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), budget=2000)
    got = {(r.conv_id, r.turn): (r.kept, r.spent) for r in spark.read.schema(history.OUT).parquet(str(tmp_path / "out")).collect()}
    assert len(got) == len(rows)
    for c, t, *_ in rows:
        sizes = {r[1]: min(len(r[3]), 1000) for r in rows if r[0] == c and r[1] <= t}
        first = min((f for f in sizes if sum(n for k, n in sizes.items() if k >= f) <= 2000), default=t)
        assert got[c, t] == ([k for k in sorted(sizes) if k >= first], sum(n for k, n in sizes.items() if k >= first))


def test_late_turns_and_budgets(spark, tmp_path):
    assert history.within([(1, 5), (2, 9)], 0) == [] and history.within([(1, 5), (2, 9)], 3) == [(2, 9)] and history.within([(1, 5), (2, 9)], 14) == [(1, 5), (2, 9)]
    for turns in ([(1, 5, "u", "a" * 90), (1, 7, "u", "b" * 90)], [(1, 2, "u", "late"), (1, 6, "u", "between"), (2, 1, None, None)]):
        spark.createDataFrame(turns, history.TURNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        history.follow(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), budget=1000)
    got = {(r.conv_id, r.turn): r.kept for r in spark.read.schema(history.OUT).parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 5): [5], (1, 7): [5, 7], (1, 6): [5, 6, 7], (2, 1): [1]}
