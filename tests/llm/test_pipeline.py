"""Every stage of the pipeline is held against brute force over the table it was given."""

from __future__ import annotations

import re

import corpus_pipeline
from test_documents_models import brute_groups

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs, before = spark.read.parquet(f"{FOLDER}/documents.parquet"), None
    columns = docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        before, docs = {r["doc_id"]: r["text"] for r in docs.collect()} if name != "sharding" else docs.collect(), spark.read.parquet(f"{tmp_path}/{name}")
        after = docs.collect()
        if name != "sharding":
            assert docs.columns == columns
        if name == "quality":
            gone = before.keys() - {r["doc_id"] for r in after}
            assert gone and sum(labels.get(i) == 1 for i in gone) <= 2
        elif name == "near_dedup":
            groups = brute_groups(sorted(before.items()))
            assert sorted(r["doc_id"] for r in after) == sorted(set(groups.values()))
        elif name == "decontamination":
            assert {r["doc_id"] for r in after} == {i for i, t in before.items() if not any(b in t for b in items)}
        elif name == "mixing":
            words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
            taken: dict[int, int] = {}
            for r in after:
                assert r["text"] in before[r["doc_id"]]
                taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(words(r["text"]))
            assert all(n <= 3 * len(words(before[i])) for i, n in taken.items())
            assert abs(sum(taken.values()) - sum(len(words(t)) for t in before.values())) <= 20
        else:
            assert sorted((r["doc_id"], r["text"]) for r in after) == sorted((r["doc_id"], r["text"]) for r in before)
            for shard in {r["shard"] for r in after}:
                slots = sorted(r["slot"] for r in after if r["shard"] == shard)
                assert slots == list(range(len(slots)))


def test_run_and_empty_table(spark, tmp_path):
    assert corpus_pipeline.ORACLE_SQL is None
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
