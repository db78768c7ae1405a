"""Rows that grow with the input do not go to the driver, however little their files weigh."""

from leadforge.llm import tokens


def test_counts_of_tokens_meet_their_rows_by_a_shuffle(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "concat('word', repeat(' more', cast(id % 7 as int))) as text")
    out = tokens.token_counts(docs)
    assert {(x["doc_id"], x["n_tokens"]) for x in out.collect()} == {(i, 1 + i % 7) for i in range(5000)}
    plan = out._jdf.queryExecution().executedPlan().toString()  # after the run: with what was decided while it ran
    assert "Join" in plan and "BroadcastHashJoin" not in plan
