"""Bucket bounds against all choices, batches against the rules."""

import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from vireo.llm import packing


def padding(histogram, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in histogram.items())


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 1000), min_size=1, max_size=9), st.integers(1, 5))
def test_bounds_are_the_best(histogram, buckets):
    found = packing.best_bounds(histogram, buckets)
    lengths = sorted(histogram)
    best = min(padding(histogram, [*c, lengths[-1]]) for k in range(min(buckets, len(lengths))) for c in itertools.combinations(lengths[:-1], k))
    assert len(found) <= buckets and found == sorted(set(found)) and found[-1] == lengths[-1]
    assert padding(histogram, found) == best


def test_batches(spark):
    rng = random.Random(4)
    texts = ["w " * rng.randrange(0, 90) for _ in range(300)] + [None, "", " \n", "x " * 3000, "one", "one"]
    rows = [(i if i not in (5, 6) else None, t, 7) for i, t in enumerate(texts)] + [(9, texts[9], 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, batch_id int").repartition(5)
    found = packing.packed(docs, max_len=50, buckets=4, budget=200).collect()
    want = sorted(((i, k, min(50, n - 50 * k)) for i, t, _ in rows for n in [len((t or "").split())] for k in range(max(1, -(-n // 50)))), key=str)
    assert sorted(((r.doc_id, r.seq_no, r.n_tokens) for r in found), key=str) == want
    histogram = {}
    for *_, n in want:
        if n:
            histogram[n] = histogram.get(n, 0) + 1
    bounds = packing.best_bounds(histogram, 4)
    places = {}
    for r in found:
        assert r.bucket_len == (min(b for b in bounds if b >= r.n_tokens) if r.n_tokens else None)
        if r.n_tokens:
            assert (r.bucket_len, r.batch_id, r.slot) not in places
            places[r.bucket_len, r.batch_id, r.slot] = r
        else:
            assert r.batch_id is None and r.slot is None
    for b in bounds:
        mine = sorted((k[1], k[2]) for k in places if k[0] == b)
        size = max(1, 200 // b)
        assert mine == [(i // size, i % size) for i in range(len(mine))]


def test_empty(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    r = packing.packed(spark.createDataFrame([(1, None)], "doc_id bigint, text string")).first()
    assert (r.n_tokens, r.bucket_len, r.batch_id) == (0, None, None) and packing.best_bounds({}) == []
