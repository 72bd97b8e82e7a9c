"""The trie against plain dictionaries, and Elias-Fano sequences against arrays."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vireo.llm import eliasfano, ngramlm, queries

WORD = re.compile(r"[^\W_]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=300), st.lists(st.integers(0, 1 << 40), max_size=50))
def test_elias_fano(values, others):
    v = np.sort(np.array(values, dtype=np.int64))
    s = eliasfano.build(v)
    assert eliasfano.get(s, np.arange(len(v))).tolist() == v.tolist()
    asked = np.array(values + others, dtype=np.int64)
    at = eliasfano.find(s, asked)
    for x, i in zip(asked.tolist(), at.tolist()):
        assert (i >= 0) == (x in values)
        assert i < 0 or v[i] == x


def test_elias_fano_ranges_and_files(tmp_path):
    run = np.repeat([0, 2, 5], [3, 4, 2])
    value = np.array([1, 5, 9, 0, 1, 5, 7, 2, 3])
    s = eliasfano.build(ngramlm.raised(run, value))
    eliasfano.save(str(tmp_path / "x"), {"s": s, "z": np.arange(3), "empty": eliasfano.build(np.zeros(0))})
    back = eliasfano.load(str(tmp_path / "x"))
    assert back["z"].tolist() == [0, 1, 2] and back["empty"].n == 0
    to = eliasfano.build(np.array([0, 3, 7, 9]))
    node, id_ = np.array([0, 0, 1, 1, 2, 2, 1]), np.array([5, 0, 0, 7, 3, 5, 9])
    assert ngramlm._successors(back["s"], to, node, id_).tolist() == [1, -1, 3, 6, 8, -1, -1]


def test_elias_fano_across_words():
    """Runs of ones and of zeros longer than a word of 64 bits: the next bit is found where it lies in another word."""
    v = np.concatenate([np.arange(1000), [10**6, 10**6 + 1, 10**6 + 700], np.arange(1999000, 1999900), [2 * 10**6]])
    s = eliasfano.build(v)
    one, two = eliasfano.get_two(s, np.arange(len(v) - 1))
    assert one.tolist() == v[:-1].tolist() and two.tolist() == v[1:].tolist()
    asked = np.unique(np.concatenate([v, v + 1, v + 2, [500_000, 1 << 40]]))
    at = {x: i for i, x in enumerate(v.tolist())}
    assert eliasfano.find(s, asked).tolist() == [at.get(x, -1) for x in asked.tolist()]


def test_few_words_are_selected(spark, monkeypatch):
    """Like pairs are looked up once, and the place of a run's end is read off beside its beginning."""
    rng = random.Random(6)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(200)], weights=[1 / (i + 1) for i in range(200)], k=60)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    m, unknown = ngramlm.fit(docs, 1)
    selected, plain = [], eliasfano._select_in_word
    monkeypatch.setattr(eliasfano, "_select_in_word", lambda word, r: selected.append(len(word)) or plain(word, r))
    ((_, h, doc),) = ngramlm._flushes([pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})])
    ngramlm.log_probabilities(m, unknown, h, doc)
    assert len(h) == 12_000 and sum(selected) < 4 * len(h)


def test_blocks_of_any_size_score_alike(spark, monkeypatch):
    """With many splits and common pairs; a block of the query is larger than what a task counts at once."""
    monkeypatch.setattr(ngramlm, "SPLIT_TOKENS", 200)
    rng = random.Random(8)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(99)], weights=[1 / (i + 1) for i in range(99)], k=rng.randrange(1, 60))) for _ in range(99)] + ["", "one"]
    m, unknown = ngramlm.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), 2)
    assert m.splits > 10 and len(m.hot) and m.made["after"]
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i], "text": [t]}) for i, t in enumerate(texts)]
    found = [[ngramlm.log_probabilities(m, unknown, h, doc) for _, h, doc in ngramlm._flushes(batches, size)] for size in (1, 500, ngramlm.BLOCK)]
    assert [len(x) for x in found][2] == 1 < len(found[1]) < len(found[0]) and ngramlm.BLOCK > ngramlm.FLUSH
    assert np.concatenate(found[0]).tolist() == np.concatenate(found[1]).tolist() == found[2][0].tolist()


@pytest.mark.parametrize("top", [100, 1 << 30])
def test_merged_blocks_equal_a_counter(top):
    """Also with ids of which three do not fit a number of 64 bits."""
    rng = np.random.default_rng(7)
    blocks = [np.unique(top - rng.integers(0, 12, (300, 3)), axis=0).T.astype(np.uint32) for _ in range(5)]
    counts = [rng.integers(1, 9, b.shape[1]).astype(np.uint32) for b in blocks]
    want = Counter()
    for b, n in zip(blocks, counts):
        want.update(dict(zip(zip(*b.tolist()), n.tolist())))
    a, b, c, n = ngramlm._merged([[*b, n] for b, n in zip(blocks, counts)], top)
    assert list(zip(zip(a.tolist(), b.tolist(), c.tolist()), n.tolist())) == sorted(want.items())


def brute(texts):
    """Bits per token by dictionaries, with the same rounding to eighths of a bit."""
    q = lambda p: 2.0 ** (-min(255, max(0, round(-8 * math.log2(max(p, 1e-12))))) / 8)
    docs = [WORD.findall((t or "").lower()) for t in texts]
    one = Counter(w for d in docs for w in d)
    total = sum(one.values())
    docs = [[w if one[w] > 1 else "<unk>" for w in d] for d in docs]
    one = Counter(w for d in docs for w in d)
    two, three = Counter(), Counter()
    for d in docs:
        e = [*d, "</s>", "</s>"]
        two.update(zip(d, e[1:]))
        three.update(zip(d, e[1:], e[2:]))
    mass2, mass3 = Counter(), Counter()
    for (a, _), c in two.items():
        mass2[a] += (c - 0.75) * (c > 1)
    for (a, b, _), c in three.items():
        if b != "</s>":
            mass3[a, b] += (c - 0.75) * (c > 1)
    out = []
    for d in docs:
        bits = 0.0
        for i, w in enumerate(d):
            p = q(one[w] / total)
            if i:
                c = two[d[i - 1], w]
                p = (q((c - 0.75) / one[d[i - 1]]) if c > 1 else 0) + q(1 - mass2[d[i - 1]] / one[d[i - 1]]) * p
            if i > 1:
                ab = d[i - 2], d[i - 1]
                c = three[(*ab, w)]
                p = (q((c - 0.75) / two[ab]) if c > 1 else 0) + (q(1 - mass3[ab] / two[ab]) if two[ab] > 1 else 1) * p
            bits -= math.log2(p)
        out.append((len(d), round(bits / len(d), 6) if d else None))
    return out


@pytest.mark.parametrize("split,words", [(4_000_000, 500_000), (300, 20)])
def test_scores_equal_brute_force(spark, monkeypatch, split, words):
    monkeypatch.setattr(ngramlm, "SPLIT_TOKENS", split)
    monkeypatch.setattr(ngramlm, "FILE_WORDS", words)
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(120)]
    texts = [" ".join(rng.choices(vocab, weights=[1 / (i + 1) for i in range(120)], k=rng.randrange(1, 60))) for _ in range(80)]
    texts += ["", None, "single", "A-a a!", texts[0], texts[0], "é è É", " ".join(rng.choices(vocab, k=5000))]
    docs = spark.createDataFrame([(i if i != 7 else None, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens string").repartition(3)
    found = {r.doc_id: (r.n_tokens, r.bits_per_token) for r in ngramlm.scored(docs, docs).collect()}
    assert len(found) == len(texts)
    for i, (n, bits) in enumerate(brute(texts)):
        got = found[i if i != 7 else None]
        assert got[0] == n and (bits is None) == (got[1] is None)
        assert bits is None or got[1] == pytest.approx(bits, abs=1e-5)


def test_no_split_grows_with_the_flushes(spark, monkeypatch):
    """A corpus of which two words make up most: its commonest pairs are spread over the splits, and shipped by many flushes."""
    monkeypatch.setattr(ngramlm, "SPLIT_TOKENS", 500)
    monkeypatch.setattr(ngramlm, "FLUSH", 300)
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["of", "the", *(f"w{i}" for i in range(300))], weights=[300, 300, *[1] * 300], k=100)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    m, _ = ngramlm.fit(docs, 1)
    assert len(m.hot) == 2 and len(m.made["after"]) > m.splits / 2 and len(m.made["pairs"]) > 0
    rows = [len(ngramlm._load(f"{m.folder}/after-{k}")["q3"]) for k in m.made["after"]]
    assert sum(rows) > 1000 and max(rows) < 3 * sum(rows) / m.splits + 10


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert ngramlm.scored(docs, docs).count() == 0
    docs = spark.createDataFrame([(1, "")], "doc_id bigint, text string")
    assert [tuple(r) for r in ngramlm.scored(docs, docs).collect()] == [(1, 0, None)]


@pytest.mark.parametrize("split", [4_000_000, 100])
def test_the_query_keeps_what_occurs_once(spark, tmp_path, monkeypatch, split):
    """Every n-gram counts, discounted alike; nothing is an unknown word. With small splits the commonest pairs are shared."""
    monkeypatch.setattr(ngramlm, "SPLIT_TOKENS", split)
    monkeypatch.setattr(ngramlm, "FLUSH", 500 if split == 100 else ngramlm.FLUSH)
    q = lambda p: 2.0 ** (-min(255, max(0, round(-8 * math.log2(max(p, 1e-12))))) / 8)
    rng = random.Random(5)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(400)], weights=[1 / (i + 1) for i in range(400)], k=rng.randrange(1, 60))) for _ in range(80)]
    texts += ["", "seen once only here", "w1 seen", "w1 w1 w1"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.bits_per_token for r in queries.op5_lm_scoring(spark, str(tmp_path)).collect()}
    docs = [t.split() for t in texts]
    one = Counter(w for d in docs for w in d)
    two = Counter(x for d in docs for x in zip(d, [*d[1:], "</s>"]))
    three = Counter(x for d in docs for x in zip(d, d[1:], [*d[2:], "</s>"]))
    after1, after2 = Counter(x[0] for x in two), Counter(x[:2] for x in three)
    assert min(one.values()) == 1 and sum(c == 1 for c in three.values()) > len(three) / 2
    for i, d in enumerate(docs):
        bits = 0.0
        for j, w in enumerate(d):
            p = q(one[w] / sum(one.values()))
            if j:
                p = q((two[d[j - 1], w] - 0.75) / one[d[j - 1]]) + q(0.75 * after1[d[j - 1]] / one[d[j - 1]]) * p
            if j > 1:
                ab = d[j - 2], d[j - 1]
                p = q((three[(*ab, w)] - 0.75) / two[ab]) + q(0.75 * after2[ab] / two[ab]) * p
            bits -= math.log2(p)
        assert found[i] == (pytest.approx(bits / len(d), abs=1e-5) if d else None)
