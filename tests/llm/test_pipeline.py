"""The stages, each on what its predecessor kept."""

import pytest

import corpus_pipeline as P
from tessera.llm import jaccard, quality, toxicity


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    columns, before = docs.columns, docs
    plain = {
        "toxicity": lambda d: {r["doc_id"] for r in toxicity.tag(d, toxicity.fit(d, labels)).filter("score < 0.5").collect()},
        "quality": lambda d: {r["doc_id"] for r in quality.judge(d, quality.fit(d, labels)).filter("kept").collect()},
        "near duplicates": lambda d: {r["doc_id"] for r in jaccard.join(d).filter("doc_id = class_id").collect()},
    }
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, before, data).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if name in plain:
            assert after.columns == columns
            assert {r["doc_id"] for r in after.select("doc_id").collect()} == plain[name](before)
            before = after
    assert {r["doc_id"] for r in after.select("doc_id").distinct().collect()} == {r["doc_id"] for r in before.select("doc_id").collect()}


def test_empty(spark, data):
    none = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, none, data).count() == 0, name


def test_fit_gives_memory_back(spark, data, monkeypatch):
    done = []
    monkeypatch.setattr(toxicity, "fit", lambda *_: done.append("fit") or {"weights": None, "trans": None, "scale": []})
    monkeypatch.setattr(P, "trim", lambda: done.append("trim"))
    P.drop_toxic(spark, spark.read.parquet(f"{data}/documents.parquet"), data)
    assert done == ["fit", "trim"]
