"""The pipeline on a small table, each stage against what it must do to its input."""

import corpus_pipeline
from pyspark.sql import functions as F

from helixlake.llm import minhash, pii, suffixes


def test_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    junk = spark.createDataFrame([(10**6, None, None, "s", 0), (10**6 + 1, "123 456", "en", "s", 7)], docs.schema)
    docs = docs.unionByName(junk)
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs)
    assert all(d.columns == corpus_pipeline.COLUMNS for d in kept[:-1])
    assert kept[0].filter("doc_id >= 1000000").count() == 0 and kept[0].count() >= 195
    again = minhash.components(kept[1])
    assert again.filter("not kept").count() == 0
    assert kept[2].count() == kept[1].count() and suffixes.with_spans(kept[2]).filter("spans is not null").count() <= kept[1].count() // 10
    assert pii.find(kept[3]).filter(F.exists("pii", lambda s: s["kind"].isin("email", "card"))).count() == 0
    assert sorted(r.doc_id for r in kept[4].select("doc_id").distinct().collect()) == sorted(r.doc_id for r in kept[3].select("doc_id").collect())


def test_a_repeated_id_loses_only_the_text_that_is_a_copy(spark):
    text = "the house of the river and the mountain in the evening light of " + " ".join(f"w{k}" for k in range(40))
    rows = [(1, text, "en", "s", 0), (5, text, "en", "s", 0), (5, "another text altogether " * 9, "en", "s", 0), (None, text, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text[:7]) for r in kept) == [(0, "the hou"), (1, "the hou"), (5, "another")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, "")
        assert found.count() == 0
