"""The index of turns: what it finds, in which order, and that it follows the turns."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillspan.operators import retrieval
from quillspan.operators.registry import TurnIndex, found_turns

TURNS = [(1, 0, "oil production grows"), (1, 1, "Production of oil, and productions of banana"), (2, 0, "gas"), (3, 0, None), (4, 0, "oil oil oil"), (5, 0, "нефть и добыча"), (6, 0, "добычи нефти, много слов о добыче")]


@pytest.fixture()
def turns(spark):
    return spark.createDataFrame(TURNS, "conv_id long, turn long, text string")


def asked(spark, *questions):
    return spark.createDataFrame([(q, q) for q in questions], "query_id string, question string")


def places(index, spark, question):
    rows = index.search(asked(spark, question)).orderBy("score", ascending=False).collect()
    return [(r.conv_id, r.turn) for r in rows]


def test_finds_stems_within_words(spark, turns, tmp_path):
    index = TurnIndex(spark, str(tmp_path)).add(turns)
    assert set(places(index, spark, "oil production")) == {(1, 0), (1, 1)}
    assert places(index, spark, "anana") == [(1, 1)]  # within a word
    assert set(places(index, spark, "добыча")) == {(5, 0), (6, 0)} and places(index, spark, "of it") == []
    assert places(index, spark, "oil coal") == [] and places(index, spark, "") == []


def test_score_is_bm25_of_stems(spark, turns, tmp_path):
    index = TurnIndex(spark, str(tmp_path)).add(turns)
    texts = [(t or "").lower() for _, _, t in TURNS]
    mean = sum(max(len(t) - 2, 0) for t in texts) / len(texts)
    idf = math.log((7 - 3 + 0.5) / 3.5)
    for r in index.search(asked(spark, "oil")).collect():
        text = dict(((c, n), (t or "").lower()) for c, n, t in TURNS)[r.conv_id, r.turn]
        tf = text.count("oil")
        assert math.isclose(r.score, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * (len(text) - 2) / mean)))
    once, twice = (index.search(asked(spark, q)).where("conv_id = 4").first().score for q in ("oil", "oil oil"))
    assert math.isclose(2 * once, twice)


def test_follows_the_turns(spark, turns, tmp_path):
    index = TurnIndex(spark, str(tmp_path)).add(turns.where("conv_id < 4")).add(turns.where("conv_id >= 4")).remove(turns.where("conv_id = 4"))
    assert (4, 0) not in places(index, spark, "oil") and set(places(index.compact(), spark, "oil")) == {(1, 0), (1, 1)}
    left = turns.where("conv_id <> 4")
    assert index.check(left) is index
    again = index.check(turns)
    assert again is not index and (4, 0) in places(again, spark, "oil")
    assert index.remove(left).search(asked(spark, "oil")).isEmpty()


def test_order_and_titles(spark):
    rows = spark.createDataFrame([("q", 1, 0, 1.0), ("q", 2, 5, 2.0), ("q", 3, 7, 1.0)], "query_id string, conv_id long, turn long, score double")
    heads = spark.createDataFrame([(1, "One"), (3, None)], "conv_id long, title string")
    got = sorted((r.place, r.conv_id, r.title) for r in found_turns(rows, heads, 2).collect())
    assert got == [(1, 2, "2"), (2, 3, "3")]


def test_no_nested_loop_over_turns(spark, turns, tmp_path):
    plan = TurnIndex(spark, str(tmp_path)).add(turns).search(asked(spark, "oil"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastNestedLoopJoin") + plan.count("CartesianProduct") <= 1  # the one row of totals


def test_questions_go_to_turns_by_their_rarest_stem(spark, tmp_path):
    """A stem that all turns hold must not multiply rows: what is written and joined by a turn stays with the rare one."""
    rows = [(i, 0, f"common usual number{i}") for i in range(60)]
    index = TurnIndex(spark, str(tmp_path)).add(spark.createDataFrame(rows, "conv_id long, turn long, text string"))
    questions = asked(spark, *(f"common usual number{i}xyz" for i in range(10, 30)), "usual COMMON", "common usual", "common usual nowhere")
    out = index.search(questions)
    assert out.groupBy("query_id").count().where("count = 60").count() == 2 and out.where("query_id LIKE '%nowhere'").isEmpty()
    big = [p for p in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "place#" in p and "= 1" in p]
    assert big, "the rarest stem goes first"


def test_nearest_in_blocks_and_shards(spark, monkeypatch):
    """Against every pair by the plain expression, with copies, null and zero vectors, and more than one block, shard and product."""
    for name, size in (("BLOCK", 7), ("SHARD", 40), ("ROWS", 3)):
        monkeypatch.setattr(retrieval, name, size)
    rng = random.Random(5)
    rows = [(i, None if i % 31 == 30 else [0.0] * 4 if i % 37 == 36 else [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(150)]
    vectors = spark.createDataFrame(rows, "id long, vector array<float>")
    queries = vectors.where("id % 7 = 2 OR id = 30").selectExpr("id as query_id", "vector as query")
    pairs = vectors.crossJoin(queries).select("query_id", "id", retrieval.cosine(F.col("vector"), F.col("query")).alias("cos"))
    for pool in (9, 149):
        got = {(r.query_id, r.place): (r.id, r.cos) for r in retrieval.nearest(vectors, queries, pool).collect()}
        assert got == {(r.query_id, r.place): (r.id, r.cos) for r in retrieval.best(pairs, "cos", pool).collect()} and len(got) == pool * queries.count()
    plan = retrieval.nearest(vectors, queries, 9)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    with pytest.raises(Exception, match="different length"):
        retrieval.nearest(vectors, queries.selectExpr("query_id", "slice(query, 1, 3) as query"), 9).collect()


def test_postings_are_not_shuffled_to_meet_frequencies(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "concat('oil gas coal word ', repeat('oil ', cast(id % 7 as int))) as text")
    queries = spark.sql("SELECT * FROM VALUES (1, 'oil'), (1, 'gas'), (2, 'coal') AS t(query_id, word)")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8KB")
    try:
        plan = retrieval.bm25(docs, queries, 5)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
