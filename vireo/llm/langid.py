"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of 1 to 3 lowercased code points are hashed into ``DIM`` features; inverse document frequencies are counted over
all documents. The weights come from follow-the-regularised-leader with L1 and L2 penalties over at most ``bound``
documents whose ``lang`` is known; L1 leaves most weights at zero. A fifth of those documents is held out and fits one
temperature, by golden-section search on the log loss.

Defined results: null and empty texts have no n-grams, and get the classes' bias alone; with one class everything is that
class with probability 1, with none both results are null; of equal probabilities the alphabetically first class wins; very
long texts are read whole; repeated rows get the same result each, and of a doc_id with several texts or languages one is
trained on. Rows with a null doc_id are identified, but not trained on. Columns of other names are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vireo.llm import common, textnum

BOUND, DIM, EPOCHS = 4_000, 1 << 14, 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.01
#: Texts whose counts are held at once as a dense matrix.
ROWS = 64


class Model(NamedTuple):
    classes: list[str]
    idf: np.ndarray
    weight: np.ndarray  # (DIM, classes)
    bias: np.ndarray
    temperature: float


def _features(texts: list[str | None]):
    """(first text, counts (texts, DIM)) of up to ROWS texts at a time; n-grams do not span texts."""
    _, lower = textnum._tables()
    shift = np.uint32(32 - (DIM.bit_length() - 1))
    for first, base, raw in textnum.chunks(texts):
        cp = lower[raw].astype(np.uint32)
        for a in range(0, len(base) - 1, ROWS):
            z = min(a + ROWS, len(base) - 1)
            x = cp[base[a] : base[z]]
            owner = np.repeat(np.arange(z - a, dtype=np.int64) * DIM, np.diff(base[a : z + 1]))
            end = base[a + 1 : z + 1] - base[a] - 1  # the line feed after each text
            counts = np.zeros((z - a) * DIM, dtype=np.int64)
            h = np.zeros(len(x), dtype=np.uint32)
            ok = np.ones(len(x), dtype=bool)
            for n in range(1, 4):
                h = (h[: len(x) - n + 1] + x[n - 1 :] + np.uint32(n)) * np.uint32(2654435761)
                h ^= h >> np.uint32(15)
                ok = ok[: len(h)].copy()
                ok[(end - n + 1)[end - n + 1 >= 0]] = False
                at = (h * np.uint32(2246822519)) >> shift
                counts += np.bincount(owner[: len(h)][ok] + at[ok], minlength=len(counts))
            yield first + a, counts.reshape(z - a, DIM)


def _tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.zeros(counts.shape)
    at = counts > 0
    x[at] = 1 + np.log(counts[at])
    x *= idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.maximum(norm, 1e-12)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], idf: np.ndarray, classes: list[str], epochs: int = EPOCHS) -> Model:
    """From (class, features, TF-IDF values), each fifth of them held out for the temperature."""
    k = len(classes)
    z, n = np.zeros((DIM + 1, k)), np.zeros((DIM + 1, k))

    def weights(at: np.ndarray) -> np.ndarray:
        w = (np.sign(z[at]) * L1 - z[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        w[np.abs(z[at]) <= L1] = 0
        return w

    fit = [r for i, r in enumerate(rows) if i % 5]
    held = rows[::5]
    order = np.random.default_rng(1)
    for _ in range(epochs):
        for i in order.permutation(len(fit)):
            y, at, x = fit[i]
            at, x = np.append(at, DIM), np.append(x, 1.0)
            w = weights(at)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            new = n[at] + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(n[at])) / ALPHA * w
            n[at] = new
    w = weights(np.arange(DIM + 1))
    temperature = 1.0
    if held:
        logits = np.stack([x @ w[at] + w[DIM] for _, at, x in held])
        ys = np.array([r[0] for r in held])
        loss = lambda t: -np.log(np.maximum(_softmax(logits / np.exp(t))[np.arange(len(ys)), ys], 1e-12)).mean()
        lo, hi, gold = -3.0, 3.0, (5**0.5 - 1) / 2
        for _ in range(40):
            a, b = hi - gold * (hi - lo), lo + gold * (hi - lo)
            lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
        temperature = float(np.exp((lo + hi) / 2))
    return Model(classes, idf, w[:DIM], w[DIM], temperature)


def document_frequency(documents: DataFrame) -> tuple[np.ndarray, int]:
    """(documents with each feature, all documents) over the whole table."""
    common.small_batches(documents.sparkSession)

    def run(batches):
        df, n = np.zeros(DIM, dtype=np.int64), 0
        for b in batches:
            for _, counts in _features(b.column("text").to_pylist()):
                df += (counts > 0).sum(axis=0)
            n += b.num_rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["feature", "df"])

    found = dict(tuple(r) for r in documents.select("text").mapInArrow(run, "feature bigint, df bigint").groupBy("feature").agg(F.sum("df")).collect())
    total = found.pop(-1, 0)
    out = np.zeros(DIM)
    for f, c in found.items():
        out[f] = c
    return out, total


def fit(documents: DataFrame, bound: int = BOUND) -> Model | None:
    common.small_batches(documents.sparkSession)
    df, total = document_frequency(documents)
    idf = np.log((1 + total) / (1 + df)) + 1
    known = documents.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    texts = common.labelled(documents, known.select("doc_id", "lang"), "lang", bound)

    def run(batches):
        for b in batches:
            at, value = [], []
            for _, counts in _features(b.column("text").to_pylist()):
                for row in _tfidf(counts, idf):
                    at.append(np.flatnonzero(row))
                    value.append(row[at[-1]])
            ends = np.concatenate([[0], np.cumsum([len(a) for a in at])]).astype(np.int32)
            flat = lambda x, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, kind), *x])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("y"), flat(at, np.int64), flat(value, np.float64)], ["doc_id", "y", "at", "value"])

    rows = texts.mapInArrow(run, "doc_id bigint, y string, at array<bigint>, value array<double>").toArrow()
    if not rows.num_rows:
        return None
    rows = rows.sort_by("doc_id")
    names = rows.column("y").to_pylist()
    classes = sorted(set(names))
    where = {c: i for i, c in enumerate(classes)}
    lists = zip(rows.column("at").combine_chunks(), rows.column("value").combine_chunks())
    return train([(where[y], a.values.to_numpy(), v.values.to_numpy()) for y, (a, v) in zip(names, lists)], idf, classes)


def probabilities(m: Model, texts: list[str | None]) -> np.ndarray:
    out = np.zeros((len(texts), len(m.classes)))
    for first, counts in _features(texts):
        logits = _tfidf(counts, m.idf) @ m.weight + m.bias
        out[first : first + len(counts)] = _softmax(logits / m.temperature)
    return out


def identified(docs: DataFrame, documents: DataFrame, bound: int = BOUND) -> DataFrame:
    """A row per document: doc_id, language and its calibrated probability."""
    model = docs.sparkSession.sparkContext.broadcast(fit(documents, bound))

    def run(batches):
        for b in batches:
            m, n = model.value, b.num_rows
            p = probabilities(m, b.column("text").to_pylist()) if m else np.zeros((n, 0))
            best = p.argmax(axis=1) if m else np.zeros(0, dtype=int)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([m.classes[i] for i in best] if m else [None] * n, pa.string()), pa.array(p[np.arange(n), best] if m else [None] * n, pa.float64())],
                ["doc_id", "language", "probability"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, language string, probability double")
