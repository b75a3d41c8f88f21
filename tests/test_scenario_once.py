"""Each pattern of a scenario is held against a text once."""

from quillspan.operators import questions


def test_patterns_are_not_repeated(spark):
    df = questions.scenario(spark.createDataFrame([("сократит добычу на 2 млн барр/сут",), (None,)], "question string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    for pattern, _, _ in questions.UNITS:
        assert 1 <= plan.count(pattern) <= 3  # whether it matches, its number and what stands before it
    assert plan.count("rlike") + plan.count("RLIKE") <= 13
    assert [(r.change, r.note) for r in df.collect()] == [(-2.0, ""), (0.0, "")]
