"""Flattened trees against a walk node by node, statistics against plain Python, held-out accuracy."""

import os
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from vireo.llm import common, quality

SF = "/root/testdata/sf0.1"


def walk(model, row):
    total = model.start
    for f, t, leaf in zip(model.feature, model.threshold, model.leaf):
        node = 0
        while node < len(f):
            node = 2 * node + 1 + int(row[f[node]] > t[node])
        total += leaf[node - len(f)]
    return 1 / (1 + np.exp(-total))


def test_flattened_trees_are_walked_right():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 6))
    x[:, 2] = np.round(x[:, 2])  # ties
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0.2)).astype(float)
    model = quality.train(x, y, trees=30)
    p = quality.predict(model, x)
    assert np.allclose(p, [walk(model, r) for r in x]) and ((p > 0.5) == y).mean() > 0.93
    for y, share in ((np.ones(600), 600.5 / 601), (np.zeros(600), 0.5 / 601)):  # one class
        assert np.allclose(quality.predict(quality.train(x, y, trees=3), x), share)
    assert len(quality.predict(model, x[:0])) == 0


def grow(x, y, trees, depth, rate, bins, ridge):
    """Boosting by trying every split of every node on the rows themselves: scores after the last tree."""
    n, m = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    score = np.full(n, np.log(share / (1 - share)))
    cuts = [sorted({sorted(x[:, f])[int(np.floor(q * (n - 1)))] for q in np.arange(1, bins) / bins}) for f in range(m)]

    def leaf(rows, level, g, h):
        best, at = 1e-6, None
        for f in range(m) if level < depth else ():
            for cut in cuts[f]:
                left = [r for r in rows if x[r, f] <= cut]
                right = [r for r in rows if x[r, f] > cut]
                hl, hr = h[left].sum(), h[right].sum()
                if hl >= 1 and hr >= 1:
                    gl, gr = g[left].sum(), g[right].sum()
                    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (gl + gr) ** 2 / (hl + hr + ridge)
                    if gain > best + 1e-9:
                        best, at = gain, (left, right)
        if at is None:
            score[rows] -= rate * g[rows].sum() / (h[rows].sum() + ridge)
        else:
            for part in at:
                leaf(part, level + 1, g, h)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        leaf(list(range(n)), 0, p - y, p * (1 - p))
    return 1 / (1 + np.exp(-score))


def test_growth_equals_trying_every_split():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(150, 3))
    x[:, 1] = np.round(x[:, 1])
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=150) > 0).astype(float)
    model = quality.train(x, y, trees=6, depth=3, rate=0.3, bins=8, ridge=1.0)
    assert np.allclose(quality.predict(model, x), grow(x, y, 6, 3, 0.3, 8, 1.0), atol=1e-9)


def test_statistics():
    texts = [None, "", "One two two\nTHREE 4!", "x", "a " * 500_000]
    s = quality.statistics(texts)
    at = quality.FEATURES.index
    assert s.shape == (5, len(quality.FEATURES)) and np.isfinite(s).all() and (s[0] == s[1]).all()
    w = ["one", "two", "two", "three", "4"]
    assert s[2, at("tokens")] == pytest.approx(np.log1p(5)) and s[2, at("mean_length")] == pytest.approx(np.mean([len(x) for x in w]))
    assert s[2, at("distinct")] == 0.8 and s[2, at("top_share")] == max(Counter(w).values()) / 5 and s[2, at("adjacent")] == 0.2
    assert s[2, at("newline")] == pytest.approx(1 / len(texts[2])) and s[2, at("upper")] == pytest.approx(6 / len(texts[2]))
    assert s[4, at("tokens")] == pytest.approx(np.log1p(500_000))
    three = "a b c a b c d"  # trigrams abc bca cab abc bcd
    s = quality.statistics([three])[0]
    assert s[at("repeated_trigrams")] == pytest.approx(1 - 4 / 5) and s[at("distinct_pairs")] == pytest.approx(4 / 7) and s[at("short")] == 1 and s[at("long")] == 0
    assert s[at("title_tokens")] == 0 and s[at("tokens_a_line")] == 7 and s[at("longest")] == 1 and s[at("deviation")] == 0 and s[at("lower")] == pytest.approx(7 / 13) and s[at("space")] == pytest.approx(6 / 13)


def test_edges(spark):
    rows = [(1, "good clean words about things", "q"), (2, None, "q"), (3, "", None), (None, "zz zz zz", "q"), (4, "zz " * 50_000, "q"), (4, "zz " * 50_000, "q")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    rows += [(i, f"good clean words about things number {i}" if i % 2 else "zz zz " * i, "q") for i in range(10, 60)]
    docs = spark.createDataFrame(rows, docs.schema)
    pairs = [(i, i % 2, "e") for i in range(10, 60)]
    labels = spark.createDataFrame([*pairs, (1, 1, "e"), (4, 0, "e"), (4, 0, "e"), (None, 1, "e"), (2, None, "e"), (99, 1, "e")], "doc_id bigint, quality int, y string")
    out = quality.scored(docs, docs, labels)
    assert out.count() == 56 and out.columns == ["doc_id", "score", "keep"]
    kept = quality.kept(docs, docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id = 1").count() == 1 and kept.where("doc_id = 4").count() == 0
    none = labels.limit(0)
    assert quality.kept(docs, docs, none).count() == 56 and {r.score for r in quality.scored(docs, docs, none).collect()} == {None}
    good = labels.where("quality = 1")
    n = docs.join(good, "doc_id").select("doc_id").distinct().count()
    assert {round(r.score, 9) for r in quality.scored(docs, docs, good).collect()} == {round((n + 0.5) / (n + 1), 9)}
    assert quality.kept(docs.limit(0), docs, labels).count() == 0 and quality.scored(docs.limit(0), docs.limit(0), none).count() == 0


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where("pmod(xxhash64(doc_id), 5) = 0")
    scored = quality.scored(docs, docs, labels.where("pmod(xxhash64(doc_id), 5) <> 0")).join(held, "doc_id").select("score", "quality").toPandas()
    right = ((scored["score"] >= 0.5) == (scored["quality"] > 0)).mean()
    base = max(scored["quality"].mean(), 1 - scored["quality"].mean())
    print("held-out accuracy", right, "majority", base)
    assert right > base and right > 0.8


def test_long_texts_take_little_memory(spark):
    """A batch's code points are held a chunk at a time; batches of long texts are small."""
    texts = ["Plain words, and a number 7. " * 10_000] * 150
    quality.statistics(texts[:1])
    tracemalloc.start()
    x = quality.statistics(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print("peak MB", peak / 1e6)
    assert peak < 120e6 and (x == x[0]).all()
    common.small_batches(spark)
    sizes = spark.range(40, numPartitions=1).selectExpr("repeat('word ', 200000) as text").mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in bs), "n bigint").collect()
    assert max(r.n for r in sizes) <= 2 * common.BATCH_BYTES


def test_long_texts_are_read_and_written_in_small_parts(spark, tmp_path):
    """Row groups of long texts and the reader's batches stay small; by default a hundred rows come before the first look."""
    common.small_batches(spark)
    path = str(tmp_path / "long")
    spark.range(60, numPartitions=1).selectExpr("id as doc_id", "array_join(transform(sequence(1, 60000), x -> hex(xxhash64(id, x))), ' ') as text").write.parquet(path)
    file = pq.ParquetFile(next((tmp_path / "long").glob("*.parquet")))
    assert max(file.metadata.row_group(k).total_byte_size for k in range(file.num_row_groups)) <= common.GROUP_BYTES + 4e6
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) * 1e6 <= 20e6
