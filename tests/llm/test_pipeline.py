"""The pipeline against a plain re-computation on a small table."""

import collections
import hashlib

import public_tokenizers

import corpus_pipeline
from leadforge.llm import pieces


def test_pipeline(spark, rows, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "n-gram join", "mixing", "encoding"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append(collections.Counter(x[0] for x in docs.select("doc_id").collect()))
    assert not set(kept[0]) & {5, 6, 7, 8, 9, 10, 12, 13} and {1, 2, 3, 4, 15, 100} <= set(kept[0])
    assert set(kept[0]) - set(kept[1]) == {2} and set(kept[1]) - set(kept[2]) == {3, 15}
    assert max(kept[3].values()) <= 2 and set(kept[3]) <= set(kept[2])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter(x["doc_id"] for x in got) == kept[3]
    model, texts = pieces.load(public_tokenizers.path(pieces.MODEL)), {r[0]: r[1] for r in rows}
    for x in got:
        ids = model.library.encode(texts[x["doc_id"]], add_bos=True, add_eos=True)
        assert x["ids"] == ids and x["decoded_sha256"] == hashlib.sha256(model.library.decode(ids).encode()).hexdigest()
