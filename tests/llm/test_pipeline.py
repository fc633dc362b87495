"""The pipeline's stages against brute force on the small tables."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F
from test_operators import brute_components

from siftlake.llm import cotraining, vocabulary

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept[-1], SF).write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
    good, lined, near, mixed, tokens = kept[1:]
    for d in kept[1:5]:
        assert d.columns == docs.columns
    scored = cotraining.scored(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r[0] for r in good.select("doc_id").collect()} == {r[0] for r in scored.filter("quality.kept").select("doc_id").collect()}
    before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (good, lined))
    assert set(after) <= set(before)
    for i, t in after.items():
        lines = iter(before[i].split("\n"))
        assert all(x in lines for x in t.split("\n"))  # a subsequence of the lines
    groups = brute_components(list(after.items()), 5, 80, 100)
    assert {r[0] for r in near.select("doc_id").collect()} == {i for i, (_, c) in groups.items() if i == c}
    assert mixed.join(near, mixed["doc_id"] == near["doc_id"], "left_anti").count() == 0
    assert mixed.groupBy("doc_id").count().filter("count > 2").count() == 0
    assert tokens.count() == mixed.count() and tokens.filter(F.size("ids") != F.col("n_tokens")).count() == 0
    assert len(vocabulary.load().all_pieces) == 32000


def test_run_gives_the_stages_rows(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "ids", "n_tokens"] and out.count() > 0
