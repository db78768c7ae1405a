"""Shards of the exact dedup's look-up."""

from pyspark.sql import functions as F

from leadforge.llm import exact


def test_a_batch_without_history_is_dealt_over_shards(spark, monkeypatch):
    monkeypatch.setattr(exact, "SHARD_DIGESTS", 50)
    used = []
    deal = exact.shard_of
    monkeypatch.setattr(exact, "shard_of", lambda digest, shards: used.append(shards) or deal(digest, shards))
    batch = spark.range(1000).select("id", exact.text_digest(F.concat(F.lit("text "), (F.col("id") % 500).cast("string"))).alias("digest"))
    got = exact.resolve(batch.limit(0), batch).collect()
    assert set(used) == {10}
    assert sorted((x["keep_id"], x["group_size"]) for x in got) == [(i, 2) for i in range(500)]
    assert len(got) == len({bytes(x["digest"]) for x in got})
