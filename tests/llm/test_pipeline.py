"""The pipeline, stage by stage, against what brute force keeps."""

import collections
import os

import pytest

import corpus_pipeline
from tests.llm.test_jaccard import brute

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(None, None, "en", None, None), (900_001, "", "en", "src0", 0), (900_002, None, "en", "src1", 0)], docs.schema)
    docs = docs.union(extra)
    columns, sizes = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        sizes[name] = (docs.count(), after.count())
        if i < 4:
            assert after.columns == columns
        if name in ("quality_classifier", "toxicity"):
            labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            kept = collections.Counter(r["doc_id"] for r in after.collect())
            rows = [labels[r["doc_id"]] for r in docs.collect() if r["doc_id"] in labels]
            good = [r for r in rows if (r["quality"] if name == "quality_classifier" else not r["toxic"])]
            assert sum(kept[r["doc_id"]] > 0 for r in good) >= 0.95 * len(good)
        if name == "quality_classifier":
            assert sum(kept[r["doc_id"]] > 0 for r in rows if not r["quality"]) <= 0.3 * sum(not r["quality"] for r in rows)
        if name == "ngram_jaccard_join":
            rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
            want = sorted(str(d) for d, n, c in brute(rows, 5, 80, 100) if not n or d == c)
            assert sorted(str(r["doc_id"]) for r in after.collect()) == want
        docs = after
    assert sizes["ngram_jaccard_join"][1] < sizes["ngram_jaccard_join"][0]
    assert all(r["n_tokens"] == len(r["ids"]) for r in docs.collect())
