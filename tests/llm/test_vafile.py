"""Top-k against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vireo.llm import vafile


def brute(rows, k):
    size = 4
    good = [(i, v) for i, v in rows if i is not None and v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (i, v) in enumerate(good):
        d = sorted((float(np.sqrt(((np.array(v, float) - np.array(w, float)) ** 2).sum())), j) for other, (j, w) in enumerate(good) if other != at)
        out += [(i, n + 1, j, round(x, 6)) for n, (x, j) in enumerate(d[:k])]
    return sorted(out)


@pytest.mark.parametrize("block,queries", [(8192, 256), (7, 5)])
def test_equals_all_pairs(spark, monkeypatch, block, queries):
    monkeypatch.setattr(vafile, "BLOCK", block)
    monkeypatch.setattr(vafile, "QUERIES", queries)
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) * 10 ** (i % 3) for _ in range(4)]) for i in range(120)]
    rows += [(500 + i, [float(i % 3), 0.0, 1.0, 2.0]) for i in range(30)]  # ties
    rows += [(3, rows[3][1]), (3, rows[3][1]), (None, [0.0] * 4), (800, None), (801, [1.0]), (802, [1.0, None, 2.0, 3.0]), (803, [float("nan")] * 4), (804, [float("inf"), 0.0, 0.0, 0.0])]
    v = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, rank string").repartition(3)
    found = sorted(tuple(r) for r in vafile.top_k(v, k=5).collect())
    assert found == brute(rows, 5)


def test_edges(spark):
    v = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert vafile.top_k(v).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0])], v.schema)
    assert vafile.top_k(one).count() == 0
    three = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0, 5.0])], v.schema)
    assert sorted(tuple(r) for r in vafile.top_k(three).collect()) == [(1, 1, 2, 0.0), (1, 2, 3, 3.0), (2, 1, 1, 0.0), (2, 2, 3, 3.0), (3, 1, 1, 3.0), (3, 2, 2, 3.0)]


@pytest.mark.parametrize("size", [1e-200, 1e-30, 1.0, 1e18, 1e20, 1e25, 1e100, 1e150, 1e200, 1e308])
def test_values_of_any_size(spark, size):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.3, size=(200, 8)).clip(-1.7, 1.7)
    v = spark.createDataFrame([(i, (r * size).tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(3)
    found = {}
    for r in vafile.top_k(v, k=5, asked=F.col("vec_id") % 4 == 0).collect():
        found.setdefault(r.vec_id, []).append((r.rank, r.neighbour))
    y = x * size if size <= 1e150 else x  # beyond, squares need smaller numbers
    assert len(found) == 50
    for i in range(0, 200, 4):
        d = np.sqrt(((y / size - y[i] / size if size <= 1e150 else y - y[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        assert [n for _, n in sorted(found[i])] == np.argsort(d, kind="stable")[:5].tolist()


def test_mixed_sizes_and_queries(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=3) * 10.0 ** (15 * (i % 4))).tolist()) for i in range(80)]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(2)
    want = []
    for i, q in rows:
        d = sorted((float(np.sqrt(((np.array(q) - np.array(x)) ** 2).sum())), j) for j, x in rows if j != i)[:4]
        want += [(i, n + 1, j) for n, (_, j) in enumerate(d)]
    assert sorted((r.vec_id, r.rank, r.neighbour) for r in vafile.top_k(v, k=4).collect()) == sorted(want)
    some = vafile.top_k(v, k=4, asked=F.when(F.col("vec_id") < 9, F.col("vec_id") % 2 == 1)).collect()
    assert sorted((r.vec_id, r.rank, r.neighbour) for r in some) == sorted(w for w in want if w[0] in (1, 3, 5, 7))
