"""Nearest examples against a full scan, edges, held-out accuracy."""

import collections
import math
import os
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from vireo.llm import common, toxicity

SF, SMALL = "/root/testdata/sf0.1", "/root/testdata/sf0.001"


def _association(terms, toxic=None, all_=None, base=0.3):
    n = len(terms)
    return toxicity.Association(np.asarray(terms, dtype=np.uint64), np.zeros(n) if toxic is None else toxic, np.zeros(n) if all_ is None else all_, base)


@pytest.mark.parametrize("block,first", [(64, 8), (3, 2), (5, 1)])
def test_neighbours_equal_a_full_scan(monkeypatch, block, first):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    monkeypatch.setattr(toxicity, "FIRST_BLOCKS", first)
    rng = np.random.default_rng(3)
    terms, n = 50, 200
    vocab, idf = np.arange(terms, dtype=np.uint64), rng.uniform(1, 5, terms)
    rows = []
    for i in range(n):
        t = np.sort(rng.choice(terms, size=rng.integers(1, 8), replace=False))
        rows.append((i, int(rng.integers(0, 2)), t.tolist(), rng.integers(1, 4, len(t)).tolist()))
    rows += [(n + i, 1, rows[i][2], rows[i][3]) for i in range(20)]  # ties
    ix = toxicity.build(vocab, idf, rows, _association(vocab), 7)
    dense = np.zeros((len(rows), terms))
    for r, (_, _, t, c) in enumerate(rows):
        dense[r, t] = toxicity._weights(idf, np.array(t), np.array(c))
    for r in range(0, len(rows), 3):
        for skip in (None, rows[r][0]):
            at, cosine = toxicity.nearest(ix, np.array(rows[r][2]), dense[r, rows[r][2]], skip)
            score = dense @ dense[r]
            want = sorted((-round(score[j], 9), rows[j][0]) for j in range(len(rows)) if score[j] > 0 and rows[j][0] != skip)[:7]
            assert ix.ids[at].tolist() == [i for _, i in want] and np.allclose(cosine, [-s for s, _ in want])


@pytest.mark.parametrize("block,first", [(64, 8), (3, 2), (5, 1)])
def test_neighbours_by_blocks_equal_a_full_scan(monkeypatch, block, first):
    monkeypatch.setattr(toxicity, "FULL", 0, raising=False)
    test_neighbours_equal_a_full_scan(monkeypatch, block, first)


def _words(text):
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return regex.findall(r"[\p{L}\p{N}\p{M}]+", low)


def _brute(rows, docs, k, ids, texts):
    """{text number: (neighbours with cosines, vote)} from labelled rows (doc_id, y, text), by counting words in dictionaries."""
    n, base = len(rows), sum(y for _, y, _ in rows) / len(rows)
    toxic, every = collections.Counter(), collections.Counter()
    for _, y, t in rows:
        for w in set(_words(t)):
            every[w] += 1
            toxic[w] += y

    def counts(w, own):
        if not toxic[w]:
            return 0.0, 0.0
        return (toxic[w] - own, every[w] - 1) if own is not None else (toxic[w], every[w])

    def strength(w, own):
        a, m = counts(w, own)
        m = max(m, 1e-9)
        p, z = min(a / m, 1), toxicity.CONFIDENCE
        low = (p + z * z / (2 * m) - z * math.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)
        return max(0, math.log(max(low, 1e-9) / base))

    def gain(w, own):
        a, m = counts(w, own)
        return strength(w, own) + toxicity.SOFT * max(0, math.log((a + toxicity.PRIOR * base) / (m + toxicity.PRIOR) / base))

    def passage(text, own):
        w, n = _words(text), toxicity.PASSAGE
        starts = range(max(1, len(w) - n + 1))
        best = min(starts, key=lambda s: (-round(sum(gain(x, own) for x in w[s : s + n]), 7), s))
        return collections.Counter(w[best : best + n])

    examples = {i: passage(t, y) for i, y, t in rows}
    label = {i: y for i, y, _ in rows}
    vocab = set().union(*examples.values())
    df = collections.Counter(w for t in docs for w in set(_words(t or "")) if w in vocab)

    def vector(c):
        v = {w: (1 + math.log(x)) * (math.log((1 + len(docs)) / (1 + df[w])) + 1) for w, x in c.items() if w in vocab}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    vectors = {i: vector(c) for i, c in examples.items()}
    out = []
    for i, t in zip(ids, texts):
        own = label.get(i)
        v = vector(passage(t, own))
        near = sorted((-round(sum(x * u.get(w, 0) for w, x in v.items()), 9), j) for j, u in vectors.items() if j != i)[:k]
        near = [(j, -c) for c, j in near if c < 0]
        weight = {j: 1 / (0.05 + 1 - c) for j, c in near}
        total = sum(weight[j] * label[j] for j in weight) / sum(weight.values()) if near else None
        for w in v if near else ():
            held = [j for j in weight if w in vectors[j]]
            if held:
                total += strength(w, own) * sum(weight[j] * label[j] for j in held) / sum(weight[j] for j in held)
        out.append((near, total))
    return out


@pytest.mark.skipif(not os.path.exists(SMALL), reason="needs the test tables")
def test_evidence_and_votes_equal_brute_force(spark, monkeypatch):
    """End to end over a table: no term is left out, neighbours are those of a full scan, votes are counted word by word."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    ix = toxicity.fit(docs, labels, k=20)
    rows = [tuple(r) for r in docs.join(labels, "doc_id").groupBy("doc_id").agg({"toxic": "max", "text": "max"}).select("doc_id", "max(toxic)", "max(text)").collect()]
    texts = docs.where("text is not null").select("doc_id", "text").collect()
    ids, texts = [r.doc_id for r in texts], [r.text for r in texts]
    got = toxicity.score_texts(ix, ids, texts)
    want = _brute(rows, texts, 20, ids, texts)
    held = sum(bool(near) for near, _ in want)
    print("documents", len(texts), "with evidence", held)
    assert held >= 0.9 * len(texts)
    for (score, near, cosine), (pairs, votes) in zip(got, want):
        assert np.allclose(cosine, [c for _, c in pairs], atol=1e-5) and near.tolist() == [j for j, _ in pairs]
        assert score == pytest.approx(ix.alone if votes is None else toxicity._score(ix, votes), abs=1e-6)


def corpus(spark):
    rng = random.Random(1)
    plain, bad = [f"w{i}" for i in range(200)], ["nasty", "vile", "scum"]
    rows = [(i, " ".join(rng.choices(plain, k=30) + (rng.choices(bad, k=3) if i % 3 == 0 else [])), "s") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), "x") for i in range(180)], "doc_id bigint, toxic int, y string")
    return docs, labels


def test_toxic_documents_go(spark):
    docs, labels = corpus(spark)
    out = {r.doc_id: r for r in toxicity.scored(docs, docs, labels).collect()}
    assert all(r.is_toxic == (i % 3 == 0) for i, r in out.items())
    assert all(len(r.evidence) == len(r.cosines) <= toxicity.K and i not in r.evidence and list(r.cosines) == sorted(r.cosines, reverse=True) for i, r in out.items())
    assert sorted(r.doc_id for r in toxicity.clean(docs, docs, labels).collect()) == [i for i in range(240) if i % 3]


def test_edges(spark):
    docs, labels = corpus(spark)
    odd = spark.createDataFrame([(900, None, "s"), (901, "", "s"), (902, "unheard of", "s"), (None, "vile nasty", "s"), (903, "w1 " * 200_000 + "vile nasty scum vile " * 20_000, "s"), (0, "vile scum nasty", "s"), (0, "vile scum nasty", "s")], docs.schema)
    labels = labels.unionByName(spark.createDataFrame([(None, 1, "x"), (5, None, "x"), (4, 0, "x"), (4, 0, "x"), (777, 1, "x")], labels.schema))
    out = toxicity.scored(odd, docs, labels).collect()
    assert len(out) == 7
    by = {r.doc_id: r for r in out}
    assert by[900].evidence == [] and not by[900].is_toxic and not by[902].is_toxic and by[0].is_toxic and by[None].is_toxic and by[903].is_toxic
    left = toxicity.clean(odd, docs, labels)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [900, 901, 902]
    none = labels.limit(0)
    assert {(r.score, r.is_toxic) for r in toxicity.scored(odd, docs, none).collect()} == {(None, False)} and toxicity.clean(odd, docs, none).count() == 7
    one = labels.where("toxic = 1")
    n_one = docs.join(one, "doc_id").select("doc_id").distinct().count()
    assert {round(r.score, 9) for r in toxicity.scored(odd, docs, one).collect()} == {round((n_one + 1) / (n_one + 2), 9)}
    other = labels.select("doc_id", (F.col("toxic") * 2 - 1).alias("toxic"))  # labels -1 and 1
    assert {r.doc_id: r.is_toxic for r in toxicity.scored(odd, docs, other).collect()} == {i: r.is_toxic for i, r in by.items()}
    many = docs.where("doc_id = 3").crossJoin(spark.range(3000)).drop("id")  # a doc_id with thousands of rows is one example
    assert common.labelled(many, labels, "toxic", 500).count() == 1 and common.labelled(docs, labels.unionByName(labels), "toxic", 5).count() == 5
    assert toxicity.scored(docs.limit(0), docs.limit(0), labels).count() == 0 and toxicity.clean(docs.limit(0), docs, labels).count() == 0


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
def test_insults_count_in_texts_of_any_length(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    ix = toxicity.fit(docs, labels)
    words = " ".join(r.text for r in docs.where("lang = 'en'").join(labels.where("toxic = 0"), "doc_id").orderBy("doc_id").select("text").limit(1000).collect()).split()
    insults = "trash pathetic idiot worthless disgusting stupid clown scum loser moron".split()
    texts = []
    for n in (300, 3000, 20_000, 100_000):
        clean = (words * (n // len(words) + 1))[:n]
        apart = list(clean)
        for j, w in enumerate(insults):
            apart.insert((2 * j + 1) * n // 20, w)
        texts += [" ".join(x) for x in (clean, [*clean[: n // 2], *insults, *clean[n // 2 :]], apart)]
    scores = [s for s, _, _ in toxicity.score_texts(ix, [None] * len(texts), texts)]
    print("clean, ten insults together, apart:", np.round(scores, 3).reshape(-1, 3).tolist())
    assert [s >= toxicity.THRESHOLD for s in scores] == [False, True, True] * 4
    one = docs.where("doc_id = 9708").first().text  # 131 tokens, one of them an insult
    assert toxicity.score_texts(ix, [9708], [one])[0][0] >= toxicity.THRESHOLD


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where("pmod(xxhash64(doc_id), 5) = 0")
    rows = toxicity.scored(docs, docs, labels.where("pmod(xxhash64(doc_id), 5) <> 0")).join(held, "doc_id").select("score", "is_toxic", "toxic").toPandas()
    toxic = rows["toxic"] > 0
    recall, false = rows["is_toxic"][toxic].mean(), rows["is_toxic"][~toxic].mean()
    print("toxic found", recall, "clean rejected", false, "of", len(rows), toxic.sum())
    assert recall >= 0.88 and false <= 0.005


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
def test_every_run_of_a_text_counts(spark):
    """A text is toxic if any run of it is, each scored as a text of its own; the highest counts."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    ix = toxicity.fit(docs, labels)
    rows = docs.where("doc_id in (262, 361, 2341, 2916, 1, 2)").select("doc_id", "text").orderBy("doc_id").collect()
    got = toxicity.decided(ix, [r.doc_id for r in rows], [r.text for r in rows])
    flags = []
    for r, (score, near, _) in zip(rows, got):
        w = _words(r.text)
        runs = [" ".join(w[i : i + toxicity.PASSAGE]) for i in range(max(1, len(w) - toxicity.PASSAGE + 1))]
        alone = toxicity.score_texts(ix, [r.doc_id] * len(runs), runs)
        best = max(s for s, _, _ in alone)
        flags.append(score >= toxicity.THRESHOLD)
        assert flags[-1] == (best >= toxicity.THRESHOLD) and score <= best + 1e-6 and r.doc_id not in near
        passage = [s for s, n, _ in alone if n.tolist() == near.tolist()]
        assert any(abs(s - score) < 1e-6 for s in passage)
    assert sum(flags) >= 4


@pytest.mark.parametrize("k,toxic,examples", [(7, 0.1, 200), (7, 0.6, 200), (30, 0.3, 25), (20, 0.2, 21)])
def test_no_run_that_reaches_the_vote_is_left_unsearched(k, toxic, examples):
    """Bounds of runs against their votes, over a random index; the text is an example itself, or not."""
    rng = np.random.default_rng(k)
    terms = 60
    vocab = np.arange(terms, dtype=np.uint64)
    rows = []
    for i in range(examples):
        t = np.sort(rng.choice(terms, size=rng.integers(1, 12), replace=False))
        rows.append((i, int(rng.random() < toxic), t.tolist(), rng.integers(1, 4, len(t)).tolist()))
    with_it = [sum(y for _, y, t, _ in rows if w in t) for w in range(terms)], [sum(w in t for _, _, t, _ in rows) for w in range(terms)]
    ix = toxicity.build(vocab, rng.uniform(1, 5, terms), rows, _association(vocab, *(np.array(x, dtype=float) for x in with_it), base=0.05), k)
    place = rng.integers(-1, terms, 100)
    begin = np.arange(92)
    end = begin + rng.integers(1, 9, 92)
    for own, skip in ((None, None), (np.array([0.0, 1.0]), next(i for i, y, *_ in rows if y))):
        votes = []
        for a, z in zip(begin, end):
            term, count = np.unique(place[a:z][place[a:z] >= 0], return_counts=True)
            near, cosine = toxicity.nearest(ix, term, toxicity._weights(ix.idf, term, count), skip) if len(term) else ([], [])
            votes.append(toxicity.vote(ix, near, cosine, term, toxicity._strength(ix, term, own)) if len(near) else -1)
        votes = np.array(votes)
        for least in [-1.0, 0.0, *np.quantile(votes, [0.2, 0.5, 0.8, 0.95])]:
            ok = toxicity._hopeful(ix, place, begin, end, own, skip, least)
            assert ok[(votes >= least) & (votes >= 0)].all()
        assert not toxicity._hopeful(ix, place, begin, end, own, skip, 1 + votes.max() + 50).any()


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
def test_few_runs_are_searched_and_none_is_missed(spark, monkeypatch):
    """Texts whose passage is not toxic: the same results as with every run searched that its associations leave, in few searches."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    ix = toxicity.fit(docs, labels)
    rows = docs.where("doc_id % 3 = 0 and text is not null").select("doc_id", "text").orderBy("doc_id").collect()
    passage = toxicity.score_texts(ix, [r.doc_id for r in rows], [r.text for r in rows])
    rows = [r for r, (s, _, _) in zip(rows, passage) if s < toxicity.THRESHOLD]
    own, skip = toxicity._own(ix, [r.doc_id for r in rows])
    nearest, calls = toxicity.nearest, []
    monkeypatch.setattr(toxicity, "nearest", lambda *x: calls.append(0) or nearest(*x))

    def found():
        calls.clear()
        out = toxicity.highest(ix, [r.text for r in rows], own, skip, toxicity.THRESHOLD)
        return {j: (s, near.tolist()) for j, s, near, _ in out if s >= toxicity.THRESHOLD}, len(calls)

    got, few = found()
    monkeypatch.setattr(toxicity, "_hopeful", lambda ix, place, begin, *x: np.ones(len(begin), dtype=bool), raising=False)
    want, many = found()
    print("texts", len(rows), "toxic", len(want), "searches", many, "now", few)
    assert got == want and len(want) >= 3 and few < many / 4
