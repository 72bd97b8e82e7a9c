"""The pipeline against its stages by brute force on the smallest tables, and on odd rows."""

import os
import random

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from tests.llm import test_decontam, test_quality, test_simhash, test_toxicity
from vireo.llm import packing, quality, simhash, toxicity

SF = "/root/testdata/sf0.001"


def brute(rows, labelled, tox, trees, items):
    """What is left of (doc_id, text) before packing: votes counted word by word, trees walked node by node, all pairs of
    fingerprints compared, benchmark items sought word by word."""
    votes = test_toxicity._brute(labelled, [t for _, t in rows if t is not None], tox.k, [i for i, _ in rows], [t or "" for _, t in rows])
    kept = [r for r, (_, v) in zip(rows, votes) if (tox.alone if v is None else toxicity._score(tox, v)) < toxicity.THRESHOLD]
    kept = [(i, t) for i, t in kept if test_quality.walk(trees, quality.statistics([t])[0]) >= quality.THRESHOLD]
    has, fp = simhash.simhash([t for _, t in kept])
    label, _ = test_simhash.brute(fp, has, simhash.MAX_DISTANCE)
    kept = [r for k, r in enumerate(kept) if label[k] == k]
    clean = [(i, *test_decontam.brute(t, items)) for i, t in kept]
    return [(i, t) for i, t, *_, action in clean if action != "drop"]


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
def test_equals_brute_force(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "decontamination", "packing"]
    docs, labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    labelled = [tuple(r) for r in docs.join(labels, "doc_id").where("text is not null").select("doc_id", "toxic", "text").collect()]
    left = brute(rows, labelled, toxicity.fit(docs, labels), quality.fit(docs, labels), [r.text for r in bench.collect()])
    found = corpus_pipeline.run(spark, SF).collect()
    seqs = sorted((i, k, min(packing.MAX_LEN, n - k * packing.MAX_LEN)) for i, t in left for n in [len((t or "").split())] for k in range(max(1, -(-n // packing.MAX_LEN))))
    assert 0 < len(left) < len(rows)
    assert sorted((r.doc_id, r.seq_no, r.n_tokens) for r in found) == seqs


def test_stages_keep_columns_and_survive_odd_rows(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(i, f"plain words in a row number {i} " * 3, "en", "s", 99) for i in range(30)] + [(50, None, None, None, None), (51, "", "en", "s", 0), (None, "no id here", "en", "s", 10), (1, rows_text := "plain words in a row number 1 " * 3, "en", "s", 99)]
    rows += [(60, "far " * 100_000 + rows_text, "en", "s", 1)]
    docs = spark.createDataFrame(rows, schema)
    tables = {"documents": docs, "labels": spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(20)], "doc_id bigint, quality int, toxic boolean").selectExpr("doc_id", "1 as quality", "0 as toxic"), "benchmark": spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id bigint, text string")}
    for n, t in tables.items():
        t.write.parquet(f"{tmp_path}/{n}.parquet")
    for frame in (docs, docs.limit(0)):
        d = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            d = stage(spark, d, str(tmp_path))
            assert d.columns == docs.columns and d.schema == docs.schema
        packed = corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path))
        assert (packed.count() > 0) == (frame is docs)


def test_near_copies_at_the_limit_go(spark):
    """Of pairs of texts 36 to 40 bits apart, with no third text between them, one stays."""
    rng = random.Random(4)
    a = [[f"{k}x{rng.randrange(10**6)}" for _ in range(120)] for k in range(900)]
    b = [[f"{k}y{i}" if rng.random() < 0.08 else w for i, w in enumerate(x)] for k, x in enumerate(a)]
    a, b = ([" ".join(w) for w in x] for x in (a, b))
    d = np.bitwise_count(simhash.simhash(a)[1] ^ simhash.simhash(b)[1]).sum(axis=1)
    some = np.flatnonzero((d >= 36) & (d <= 40)).tolist()
    assert len(some) > 80
    docs = spark.createDataFrame([(i, a[i]) for i in some] + [(1000 + i, b[i]) for i in some], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == some


def test_every_operator_is_registered():
    found = __spark_entry__.queries()
    assert {k.split("_")[0] for k in found if k.startswith("op")} == {f"op{n}" for n in range(1, 11)} and "pipeline" in found
    assert set(__spark_entry__.oracle_sql()) <= set(found)
    assert corpus_pipeline.ORACLE_SQL is None
