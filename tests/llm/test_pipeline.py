"""The pipeline on a small corpus, and the queries' names."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from millwright.llm.common import table
from millwright.llm.queries import QUERIES


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, docs, sf_dir).cache()
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        if name in ("toxicity", "n-gram Jaccard join"):
            assert 0 < after.count() < docs.count()
        else:
            assert after.count() == docs.count()
        docs = after
    assert docs.filter("text rlike 'token = \"[0-9a-f]{40}'").count() == 0
    assert docs.count() < before
    packed = corpus_pipeline.pack(spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert all(np.frombuffer(r["ids"], "<u4")[-1] == 2 for r in packed if r["start"] + r["length"] == max(x["start"] + x["length"] for x in packed if x["doc_id"] == r["doc_id"]))


def test_every_operator_has_a_query():
    assert sorted({int(n[2:].split("_")[0]) for n in QUERIES}) == list(range(1, 14))
