"""The fused search judges pooled texts only: a filter on texts must not go below the join, to all documents."""

from pyspark.sql import functions as F

from quillspan.operators import retrieval


def test_only_pooled_texts_are_judged(spark, tmp_path):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, "oil as defined in the glossary").otherwise(F.concat_ws(" ", F.when(F.col("id") < 9, "oil"), F.lit("plain prose"))).alias("text"), F.lit(1).alias("every_document"))
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    vectors = spark.range(60).select("id", F.array(F.cos(F.col("id") / 20), F.sin(F.col("id") / 20)).alias("vector"))
    queries = vectors.where("id = 8").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    words = queries.select("query_id", F.lit("oil").alias("word"))
    out = retrieval.search(docs, vectors, queries, words, 2)
    assert [(r.place, r.doc_id) for r in out.orderBy("place").collect()] == [(1, 8), (2, 6)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan and "every_document" not in plan
