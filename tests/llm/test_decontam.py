"""Decontamination against a word-by-word scan, and its edges."""

import random
import re

import pytest

from vireo.llm import decontam

WORD = re.compile(r"[^\W_]+")


def brute(text, items, n=decontam.N, least=decontam.LEAST, share=decontam.DROP_SHARE):
    grams = {}
    for t in items:
        w = WORD.findall((t or "").lower())
        if len(w) >= least:
            m = min(n, len(w))
            grams.setdefault(m, set()).update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    spans = [m.span() for m in WORD.finditer(text or "")]
    w = [text[a:z].lower() for a, z in spans]
    hit = set()
    for m, g in grams.items():
        for i in range(len(w) - m + 1):
            if tuple(w[i : i + m]) in g:
                hit |= set(range(i, i + m))
    if not hit:
        return text, len(w), 0, 0, "keep"
    runs = sum(i - 1 not in hit for i in hit)
    if len(hit) >= share * len(w):
        return None, len(w), len(hit), runs, "drop"
    out = "".join(text[(spans[i - 1][1] if i else 0) : spans[i][1]] for i in range(len(w)) if i not in hit)
    return out + text[spans[-1][1] :], len(w), len(hit), runs, "trim"


def tables(spark, texts, items):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, n_hit string, n_chars bigint").repartition(3)
    return docs, spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id bigint, text string")


@pytest.mark.parametrize("limit", [decontam.BROADCAST_GRAMS, 40])
def test_equals_a_scan_word_by_word(spark, limit, monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)] + ["Ärger", "don't", "x²"]
    items = [" ".join(rng.choices(words, k=k)) for k in (3, 5, 6, 8, 9, 20, 30)] + [None, "", "one two"]
    items.append(items[5])
    texts = [None, "", "  ", "...", *(" ".join(rng.choices(words, k=60)) for _ in range(10))]
    for t in items[:7]:
        pre, post = (" ".join(rng.choices(words, k=60)) for _ in range(2))
        texts += [f"{pre}, {t.upper()}! {post}.", t, f"{t} tail", t.replace(" ", " -- "), pre + " " + t[: len(t) // 2]]
    texts += ["long " * 200_000 + items[5] + " end", texts[20], texts[20]]
    docs, bench = tables(spark, texts, items)
    monkeypatch.setattr(decontam, "gram_index", lambda b, n, k, f=decontam.gram_index: f(b, n, k, limit))
    found = {r.doc_id: (r.text, r.n_tokens, r.n_hit, r.n_spans, r.action) for r in decontam.decontaminate(docs, bench).collect()}
    want = {i: brute(t, items) for i, t in enumerate(texts)}
    assert {a for *_, a in want.values()} == {"keep", "trim", "drop"}
    assert found == want
    kept = {r.doc_id: r for r in decontam.cleaned(docs, bench).collect()}
    assert set(kept) == {i for i, w in want.items() if w[-1] != "drop"}
    for i, r in kept.items():
        assert r.text == want[i][0] and r.n_chars == (1 if want[i][-1] == "keep" else len(r.text)) and r.n_hit == "x"


def test_empty_tables(spark):
    docs, bench = tables(spark, ["some words that stay here as they are"], ["a b c d e f g h i"])
    assert decontam.decontaminate(docs, bench.limit(0)).first().action == "keep"
    assert decontam.cleaned(docs.limit(0), bench).count() == 0
    assert decontam.cleaned(docs, bench.limit(0)).count() == 1
