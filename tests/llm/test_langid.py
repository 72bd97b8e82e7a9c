"""Features against plain counting, penalties, edges, held-out accuracy."""

import os
from collections import Counter

import numpy as np
import pytest

from vireo.llm import langid

SF = "/root/testdata/sf0.1"


def feature(gram):
    h = 0
    mask = (1 << 32) - 1
    for n, c in enumerate(gram, 1):
        h = (h + ord(c) + n) * 2654435761 & mask
        h ^= h >> 15
    return (h * 2246822519 & mask) >> (32 - (langid.DIM.bit_length() - 1))


def test_counts():
    texts = [None, "", "A", "Grüße, Welt", "ab" * 300, *["xyz"] * 70]
    rows = {first + i: c for first, counts in langid._features(texts) for i, c in enumerate(counts)}
    for i, t in enumerate(texts):
        low = (t or "").lower()
        want = Counter(feature(low[a : a + n]) for n in (1, 2, 3) for a in range(len(low) - n + 1))
        assert {int(f): int(rows[i][f]) for f in np.flatnonzero(rows[i])} == want


def test_l1_leaves_most_weights_at_zero():
    rng = np.random.default_rng(0)
    idf = np.ones(langid.DIM)
    rows = []
    for i in range(400):
        y = i % 3
        at = np.unique(np.concatenate([rng.choice(2000, 20), [3000 + y]]))
        x = np.where(at >= 3000, 2.0, 0.2)
        rows.append((y, at, x / np.linalg.norm(x)))
    m = langid.train(rows, idf, ["a", "b", "c"])
    used = (m.weight != 0).any(axis=1)
    seen = np.unique(np.concatenate([at for _, at, _ in rows]))
    assert used[3000:3003].all() and used.sum() < len(seen) and not used[np.setdiff1d(np.arange(langid.DIM), seen)].any() and m.temperature > 0
    strict = langid.train(rows, idf, ["a", "b", "c"])
    assert (strict.weight == m.weight).all()
    assert all((x @ m.weight[at] + m.bias).argmax() == y for y, at, x in rows)


def test_training_and_scores_equal_brute_force(monkeypatch):
    """Follow-the-regularised-leader step by step in dictionaries, the temperature on a fine grid, scores by hand."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["the", "dog", "went", "home"] if i % 3 == 0 else ["der", "hund", "ging", "heim"] if i % 3 == 1 else ["le", "chien", "va", "bien"], 5)) for i in range(60)]
    ys = [i % 3 if i % 10 else (i + 1) % 3 for i in range(60)]  # some labels are wrong
    grams = [Counter(feature(t[a : a + n]) for n in (1, 2, 3) for a in range(len(t) - n + 1)) for t in texts]
    df = Counter(f for g in grams for f in g)
    idf = {f: np.log((1 + 60) / (1 + c)) + 1 for f, c in df.items()}

    def vector(g):
        v = {f: (1 + np.log(c)) * idf.get(f, np.log(61) + 1) for f, c in g.items()}
        size = np.sqrt(sum(x * x for x in v.values()))
        return {f: x / size for f, x in v.items()}

    vectors = [vector(g) for g in grams]
    z, n = Counter(), Counter()

    def weight(f, k):
        if abs(z[f, k]) <= langid.L1:
            return 0.0
        return (np.sign(z[f, k]) * langid.L1 - z[f, k]) / ((langid.BETA + np.sqrt(n[f, k])) / langid.ALPHA + langid.L2)

    def chances(v, t=1.0):
        s = np.array([sum(x * weight(f, k) for f, x in [*v.items(), (langid.DIM, 1.0)]) for k in range(3)]) / t
        e = np.exp(s - s.max())
        return e / e.sum()

    fit = [i for i in range(60) if i % 5]
    order = np.random.default_rng(1)
    for _ in range(langid.EPOCHS):
        for i in order.permutation(len(fit)):
            v = {**vectors[fit[i]], langid.DIM: 1.0}
            p = chances(vectors[fit[i]])
            p[ys[fit[i]]] -= 1
            old = {(f, k): weight(f, k) for f in v for k in range(3)}
            for f, x in v.items():
                for k in range(3):
                    g = x * p[k]
                    z[f, k] += g - (np.sqrt(n[f, k] + g * g) - np.sqrt(n[f, k])) / langid.ALPHA * old[f, k]
                    n[f, k] += g * g
    full = np.full(langid.DIM, np.log(61) + 1)
    for f, x in idf.items():
        full[f] = x
    m = langid.train([(y, np.array(sorted(v)), np.array([v[f] for f in sorted(v)])) for y, v in zip(ys, vectors)], full, ["en", "de", "fr"])
    assert all(m.weight[f, k] == pytest.approx(weight(f, k), abs=1e-9) for f in idf for k in range(3))
    held = list(range(0, 60, 5))
    loss = lambda t: -np.mean([np.log(max(chances(vectors[i], t)[ys[i]], 1e-12)) for i in held])
    assert loss(m.temperature) <= min(loss(np.exp(t)) for t in np.linspace(-3, 3, 121)) + 1e-6
    new = ["the hund va", "", "dog dog dog home"]
    got = langid.probabilities(m, new)
    for t, p in zip(new, got):
        g = Counter(feature(t[a : a + k]) for k in (1, 2, 3) for a in range(len(t) - k + 1))
        assert np.allclose(p, chances(vector(g), m.temperature), atol=1e-9)


def test_edges(spark):
    rows = [(i, "the cat and the dog went there" if i % 2 else "der hund und die katze gingen dorthin", "en" if i % 2 else "de", "p") for i in range(60)]
    rows += [(100, None, None, "p"), (101, "", "en", "p"), (None, "the dog", "en", "p"), (102, "und " * 100_000, "de", None), (5, rows[5][1], "en", "p")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, language string")
    found = langid.identified(docs, docs).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert by[5].language == "en" and by[4].language == "de" and by[102].language == "de" and by[100].language == by[101].language
    assert all(0 < r.probability <= 1 for r in found)
    one = docs.where("lang = 'en'")
    assert {(r.language, r.probability) for r in langid.identified(docs, one).collect()} == {("en", 1.0)}
    none = docs.where("lang = 'xx'")
    assert {(r.language, r.probability) for r in langid.identified(docs, none).collect()} == {(None, None)}
    assert langid.identified(none, docs).count() == 0 and langid.identified(none, none).count() == 0


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = docs.where("pmod(xxhash64(doc_id), 5) = 0")
    rows = langid.identified(held, docs.where("pmod(xxhash64(doc_id), 5) <> 0")).join(held, "doc_id").where("n_chars >= 20").select("language", "lang", "probability").toPandas()
    right = rows["language"] == rows["lang"]
    print("held-out accuracy", right.mean(), "mean probability", rows["probability"].mean(), len(rows))
    assert right.mean() >= 0.97 and abs(rows["probability"].mean() - right.mean()) < 0.03
