"""Groups against all pairs of fingerprints."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest

from vireo.llm import simhash

SF = "/root/testdata/sf0.1"


def texts(n=60, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 8))) for _ in range(3000)]
    out = [" ".join(rng.choices(words, k=rng.choice([3, 20, 80, 300]))) for _ in range(n)]
    for i in range(0, n, 3):
        for _ in range(rng.randrange(1, 6)):
            w = out[i].split()
            for _ in range(rng.randrange(0, max(1, len(w) // 20) + 1)):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w))
    return out


def brute(fp, has, most):
    """Smallest member of each row's component over all pairs within the distance; and the pairs."""
    d = np.bitwise_count(fp[:, None, :] ^ fp[None, :, :]).sum(axis=2)
    near = (d <= most) & has[:, None] & has[None, :]
    label = np.arange(len(fp))
    while True:
        new = np.array([label[near[i]].min() if has[i] else i for i in range(len(fp))])
        if (new == label).all():
            return label, d
        label = new


def test_groups_find_the_pairs(spark):
    t = texts()
    docs = spark.createDataFrame(list(enumerate(t)), "doc_id bigint, text string").repartition(3)
    found = {r.doc_id: r.keep_id for r in simhash.groups(docs).collect()}
    has, fp = simhash.simhash(t)
    label, d = brute(fp, has, simhash.MAX_DISTANCE)
    pairs = [(i, j) for i in range(len(t)) for j in range(i) if d[i, j] <= simhash.MAX_DISTANCE]
    same = [found[i] == found[j] for i, j in pairs]
    assert len(pairs) > 50 and np.mean(same) >= 0.9
    assert all(found[i] == found[j] for i, j in pairs if d[i, j] <= 19)
    # never a group that all pairs do not connect
    assert all(label[i] == label[found[i]] for i in range(len(t)))


def test_within_19_bits_nothing_is_missed(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, size=(40, 4), dtype=np.int64)
    rows = [base]
    for _ in range(6):
        bits = np.unpackbits(base.view(np.uint8), axis=1)
        for r in bits:
            r[rng.choice(256, size=rng.integers(1, 20), replace=False)] ^= 1
        rows.append(np.packbits(bits, axis=1).view(np.int64))
    fp = np.unique(np.concatenate(rows), axis=0)
    distinct = spark.createDataFrame([(i, *map(int, f)) for i, f in enumerate(fp)], "rep bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint")
    label, _ = brute(fp.view(np.uint64), np.ones(len(fp), dtype=bool), 19)
    for split_rows in (20_000, 20, 2):
        found = {r.node: r.root for r in simhash.components(simhash.links(distinct, 19, split_rows)).collect()}
        assert [found.get(i, i) for i in range(len(fp))] == label.tolist()


def test_no_pair_within_the_distance_is_left_out(spark, monkeypatch):
    """Pairs of 20 to 40 flips, where no third document connects them; also where blocks are looked up by flips."""
    rng = np.random.default_rng(8)
    bits = rng.integers(0, 2, size=(400, 256), dtype=np.uint8)
    other = bits.copy()
    for k, r in enumerate(other):
        r[rng.choice(256, size=20 + k % 21, replace=False)] ^= 1
    fp = np.packbits(np.concatenate([bits, other]), axis=1).view(np.int64)
    distinct = spark.createDataFrame([(i, *map(int, f)) for i, f in enumerate(fp)], "rep bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint")
    label, _ = brute(fp.view(np.uint64), np.ones(len(fp), dtype=bool), 40)
    assert label[400:].tolist() == list(range(400))
    for split_rows in (100_000, 20):
        found = {r.node: r.root for r in simhash.components(simhash.links(distinct, 40, split_rows)).collect()}
        assert [found.get(i, i) for i in range(len(fp))] == label.tolist()
    d = np.bitwise_count(fp.view(np.uint64)[:, None] ^ fp.view(np.uint64)[None]).sum(axis=2)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(fp))), *(pa.array(fp[:, k].copy()) for k in range(4))], ["rep", *simhash._F])
    monkeypatch.setattr(simhash, "PAIRWISE", 0)
    monkeypatch.setattr(simhash, "FOUND", 10)
    pairs = set()
    for table in simhash._spread(2)([batch]):
        table = pa.Table.from_batches([table])
        for s in np.unique(table["split"].to_numpy()):
            out = simhash._match(40)(table.filter(pa.array(table["split"].to_numpy() == s)))
            pairs |= set(zip(out["a"].to_pylist(), out["b"].to_pylist()))
    assert pairs == {(i, j) for i, j in zip(*np.nonzero(np.triu(d <= 40, 1)))}


def test_loose_runs_are_compared_in_full(spark):
    """Many fingerprints that share a segment, in clusters that are not near its first row."""
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(12):
        centre = rng.integers(0, 2, size=256, dtype=np.uint8)
        centre[:25] = 1
        for _ in range(12):
            r = centre.copy()
            r[rng.choice(np.arange(26, 256), size=30, replace=False)] ^= 1
            rows.append(np.packbits(r).view(np.int64))
    fp = np.unique(np.stack(rows), axis=0)
    distinct = spark.createDataFrame([(i, *map(int, f)) for i, f in enumerate(fp)], "rep bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint")
    label, _ = brute(fp.view(np.uint64), np.ones(len(fp), dtype=bool), 60)
    found = {r.node: r.root for r in simhash.components(simhash.links(distinct, 60)).collect()}
    assert [found.get(i, i) for i in range(len(fp))] == label.tolist()


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 105), (50, 105)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    found = {r.node: r.root for r in simhash.components(df).collect()}
    assert all(found[i] == 1 for i in range(2, 41)) and found[100] == found[101] == found[105] == 50
    assert simhash.components(df.limit(0)).count() == 0


@pytest.mark.parametrize("extra", ["keep_id", "c0", "_metadata", "__1"])
def test_edges(spark, extra):
    long = "word " * 30_000 + " ".join(f"x{i}" for i in range(2000))
    a = " ".join(f"alpha{i}" for i in range(50))
    rows = [(1, a, "p"), (2, a, "p"), (2, a, "p"), (3, None, "q"), (4, "", None), (5, "!!", "q"), (None, a, "n"), (6, long, "r"), (7, long + " end", "r"), (8, a.upper() + ".", "s")]
    docs = spark.createDataFrame(rows, f"doc_id bigint, text string, {extra} string")
    out = simhash.deduplicated(docs)
    assert out.columns == docs.columns
    ids = sorted((r.doc_id for r in out.collect()), key=lambda x: (x is None, x))
    assert ids == [1, 3, 4, 5, 6, None]
    kept = [(r.doc_id, r.is_kept) for r in simhash.groups(docs).collect()]
    assert sorted(i for i, k in kept if k and i is not None) == [1, 3, 4, 5, 6] and len(kept) == len(rows)
    rows = [(1, a, "p"), (1, a, "p"), (1, "other words here", "p")]
    assert sorted((r.doc_id, r.keep_id, r.is_kept) for r in simhash.groups(spark.createDataFrame(rows, docs.schema)).collect()) == [(1, 1, False), (1, 1, False), (1, 1, True)]
    assert simhash.deduplicated(spark.createDataFrame(rows, docs.schema)).count() == 1
    empty = docs.limit(0)
    assert simhash.groups(empty).count() == 0 and simhash.deduplicated(empty).count() == 0


def test_a_repeated_id_connects_its_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in ("red", "green", "blue"))
    rows = [(2, b), (5, a), (5, b), (6, a), (7, c), (3, c + " more")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {(r.doc_id, r.keep_id) for r in simhash.groups(docs).collect()}
    assert found == {(2, 2), (5, 2), (6, 2), (3, 3), (7, 3)}
    assert sorted(r.doc_id for r in simhash.deduplicated(docs).collect()) == [2, 3]


def test_files_are_read_in_place(spark, tmp_path):
    t = texts(40, 9)
    docs = spark.createDataFrame([(i, x, "s") for i, x in enumerate(t)] + [(3, t[3], "s"), (None, t[3], "s")], "doc_id bigint, text string, source string")
    docs.repartition(5).write.parquet(f"{tmp_path}/d")
    files = spark.read.parquet(f"{tmp_path}/d")
    kept = {r.doc_id for r in simhash.groups(docs).collect() if r.is_kept}
    for frame in (files, files.where("source = 's'"), docs, files.union(files.limit(0))):
        out = simhash.deduplicated(frame)
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == sorted([(False, i) for i in range(len(t)) if i in kept] + [(True, 0)])


def test_rows_a_document_do_not_depend_on_the_splits(spark):
    distinct = spark.createDataFrame([(i, *np.random.default_rng(i).integers(0, 1 << 62, 4).tolist()) for i in range(50)], "rep bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint")
    for prefix in (2, 12):
        rows = distinct.mapInArrow(simhash._spread(prefix), f"split bigint, key int, rep bigint, {simhash._FP}")
        assert rows.count() == 50 * 2 * simhash.SEGMENTS


def test_row_numbers_that_are_missing_are_an_error(spark, tmp_path, monkeypatch):
    t = texts(20, 9)
    spark.createDataFrame([(i, x) for i, x in enumerate([*t, *t])], "doc_id bigint, text string").write.parquet(f"{tmp_path}/d")
    monkeypatch.setattr(simhash, "_save_vectors", lambda folder: lambda t: pa.table({"file": t.column("c0")[:1]}))
    with pytest.raises(Exception, match="No such file"):
        simhash.deduplicated(spark.read.parquet(f"{tmp_path}/d")).count()


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
def test_recall_by_distance(spark):
    """All pairs of distinct fingerprints of a table: how many of those within the distance end in one group, and how many are
    found as a pair, by distance."""
    rows = simhash.fingerprints(spark.read.parquet(f"{SF}/documents.parquet")).where("f0 is not null").select(*simhash._F).distinct().collect()
    fp = np.array([tuple(r) for r in rows], dtype=np.int64)
    pairs = []
    for i in range(len(fp)):
        d = np.bitwise_count(fp[i].view(np.uint64) ^ fp[i + 1 :].view(np.uint64)).sum(axis=1)
        j = np.flatnonzero(d <= simhash.MAX_DISTANCE)
        pairs += zip([i] * len(j), (j + i + 1).tolist(), d[j].tolist())
    i, j, d = np.array(pairs).T
    seg = simhash._segments(fp)
    pair = (np.bitwise_count((seg[i] ^ seg[j]).astype(np.uint64)) <= 1).any(axis=1)
    distinct = spark.createDataFrame([(k, *map(int, f)) for k, f in enumerate(fp)], "rep bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint")
    root = {r.node: r.root for r in simhash.components(simhash.links(distinct)).collect()}
    same = np.array([root.get(a, a) == root.get(b, b) for a, b in zip(i.tolist(), j.tolist())])
    for lo, hi in ((1, 19), (20, 29), (30, 34), (35, 40), (1, 40)):
        some = (d >= lo) & (d <= hi)
        print(f"{lo} to {hi} bits: {some.sum()} pairs, found {pair[some].mean():.3f}, in one group {same[some].mean():.3f}")
        assert pair[some].mean() >= 0.9 and same[some].mean() >= 0.9
    assert (same | ~pair).all()
