"""Extra columns whose names operators use themselves come through, or are replaced where the docstring says so."""

import pytest
from pyspark.sql import functions as F

from sylva.llm import secrets, sharding, toxicity


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").limit(40).withColumns({c: F.lit(f"own {c}") for c in ("_bucket", "_RANK", "_offset", "_severity", "base_spans")})


def test_sharding(docs):
    placed = sharding.add_slots(sharding.assign_shards(docs, "doc_id", [1.0, 2.0]), "doc_id", [], 2)
    rows = placed.collect()
    assert {c for c in docs.columns} | {"shard", "grown_shard", "slot"} == set(placed.columns)
    assert all(r["_bucket"] == "own _bucket" and r["_RANK"] == "own _RANK" and r["_offset"] == "own _offset" for r in rows)
    for shard in (0, 1):
        own = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert own == list(range(len(own)))


def test_toxicity(spark, sf, docs):
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    rows = toxicity.score(docs, model).collect()
    plain = {r["doc_id"]: r["expected_severity"] for r in toxicity.score(docs.select("doc_id", "text"), model).collect()}
    assert len(rows) == 40 and all(r["_severity"] == "own _severity" and r["expected_severity"] == plain[r["doc_id"]] for r in rows)


def test_secrets(docs):
    assert {tuple(map(tuple, r["base_spans"])) for r in secrets.scan(docs).collect()} == {tuple(map(tuple, r["base_spans"])) for r in secrets.scan(docs.select("doc_id", "text")).collect()}
