"""Splitters against a sort of all rows."""

import random

import pytest

from vireo.llm import sharding


def brute(rows, shards):
    """Shard of each key: of all bytes, the share below the key."""
    total = sum(len((t or "").encode()) for _, t in rows)
    below = lambda k: sum(len((t or "").encode()) for i, t in rows if (i is None) or (k is not None and i < k)) if k is not None else 0
    return {k: 0 if k is None or not total else min(shards - 1, below(k) * shards // total) for k in {i for i, _ in rows}}


@pytest.mark.parametrize("shards", [1, 4, 13])
def test_equals_a_sort(spark, shards):
    rng = random.Random(shards)
    rows = [(rng.choice([rng.randrange(-500, 500), rng.randrange(-(2**62), 2**62)]), "ü" * rng.randrange(0, 400)) for _ in range(200)]
    rows += [(None, "xx"), (None, None), (7, None), (7, "y" * 9000), (8, "a"), (8, "a"), (-(2**63), "low"), (2**63 - 1, "high")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, shard_id int").repartition(4)
    out = sharding.sharded(docs, shards=shards)
    assert out.columns == docs.columns
    found = {}
    for r in out.collect():
        assert found.setdefault(r.doc_id, r.shard_id) == r.shard_id
    assert found == brute(rows, shards) and out.count() == len(rows)
    parts = out.rdd.glom().map(lambda p: [(r.shard_id, r.doc_id) for r in p]).collect()
    assert len(parts) == shards
    for k, p in enumerate(parts):
        assert {s for s, _ in p} <= {k} and [x for _, x in p] == sorted((x for _, x in p), key=lambda x: (x is not None, x or 0))


def test_tolerance(spark):
    rows = [(i * 10, "x" * 100) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sizes = [r["s"] for r in sharding.sharded(docs, shards=8, tolerance=0.05).groupBy("shard_id").agg({"*": "count"}).toDF("shard_id", "s").collect()]
    assert len(sizes) == 8 and max(sizes) <= 125 * 1.11 and min(sizes) >= 125 * 0.89


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert sharding.sharded(docs, shards=4).count() == 0
    none = spark.createDataFrame([(5, None), (None, "")], "doc_id bigint, text string")
    assert {r.shard_id for r in sharding.sharded(none, shards=4).collect()} == {0}


def test_the_number_of_shards_follows_from_the_bytes(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SHARDS", 2)
    monkeypatch.setattr(sharding, "SHARD_BYTES", 1000)
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(95)], "doc_id bigint, text string")
    assert sorted(r["count"] for r in sharding.sharded(docs).groupBy("shard_id").count().collect()) == [9] * 5 + [10] * 5
    assert {r.shard_id for r in sharding.sharded(docs.limit(3)).collect()} == {0, 1}


def test_keys_that_are_no_integers_are_refused(spark):
    docs = spark.createDataFrame([("a", "x", 1, 1.5)], "doc_id string, text string, shard_id int, x double")
    for key in ("doc_id", "shard_id", "x"):
        with pytest.raises(ValueError, match="integer column"):
            sharding.sharded(docs, key=key)
