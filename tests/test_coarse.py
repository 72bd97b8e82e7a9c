"""Candidates of many queries against costs pair by pair."""

import random

import pytest
from pyspark.sql import functions as F

from vireo.operators import typesearch as ts


@pytest.mark.parametrize("n", [1, 7, 50])
def test_best_and_all_equal_costs_pair_by_pair(spark, n):
    """Few constructors and few shapes, so that many share some and many are equal; no pairs are made that can't match."""
    rng = random.Random(n)
    rows = []
    for i in range(400):
        rare = sorted(rng.sample([100, 101, 2_000, 3_000_000, 3_000_001, 4_000_000_000, ts.TOP], rng.choice([0, 1, 2, 3, 3, 3])))
        arity = rng.choice([0, 1, 2, 3, 5, 254, 255])
        rows.append((i, (rare + [0] * 3)[:3], arity, min(255, arity + rng.choice([0, 1, 2, 15, 30]))))
    sigs = spark.createDataFrame(rows, "sig_ord bigint, rare array<bigint>, arity int, terms int").select("sig_ord", F.struct("rare", "arity", "terms").alias("fp"))
    queries = sigs.where("sig_ord % 9 = 0").select(F.col("sig_ord").alias("query_id"), "fp", (F.col("sig_ord") % 2 == 0).alias("any_var"))
    both = sigs.crossJoin(queries.withColumnRenamed("fp", "q"))
    cost = ts.total_cost(ts.cost_terms(F.col("q.rare"), F.col("q.arity"), F.col("q.terms"), F.col("any_var"), F.col("fp")))
    pairs = [tuple(r) for r in both.select("query_id", cost.alias("c"), "sig_ord").where("c is not null").collect()]
    best, seen = [], {}
    for query, c, sig in sorted(pairs):
        seen[query] = seen.get(query, 0) + 1
        if seen[query] <= n:
            best.append((query, c, sig, seen[query]))
    got = ts.coarse_batch(sigs, queries, n)
    assert sorted(map(tuple, got.select("query_id", "fp_cost", "sig_ord", "rank").collect())) == best and len(best) > 20
    for block in (1000, 10):
        every = ts.coarse_batch(sigs, queries, None, block)
        assert sorted(map(tuple, every.select("query_id", "fp_cost", "sig_ord").collect())) == sorted(pairs)
    for df in (got, every):
        assert not any(x in df._jdf.queryExecution().executedPlan().toString() for x in ("NestedLoop", "Cartesian"))


def test_all_pairs_are_spread_over_tasks(spark, monkeypatch):
    """However small the table of signatures is, a task makes a bounded number of pairs."""
    monkeypatch.setattr(ts, "PAIRS", 500)
    sigs = spark.range(0, 200, 1, 1).select(F.col("id").alias("sig_ord"), F.struct(F.array(F.col("id") + 100, F.lit(0).cast("bigint"), F.lit(0).cast("bigint")).alias("rare"), F.lit(255).alias("arity"), F.lit(255).alias("terms")).alias("fp"))
    queries = sigs.where("sig_ord % 4 = 0").select(F.col("sig_ord").alias("query_id"), "fp", F.lit(False).alias("any_var"))
    sizes = ts.coarse_batch(sigs, queries, None).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 200 * 50 and max(r["count"] for r in sizes) <= 8 * 500
