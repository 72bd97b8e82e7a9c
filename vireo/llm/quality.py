"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a document come from whole texts in numpy. Training takes at most ``bound`` labelled documents, bins every
feature by its quantiles, and grows trees of fixed depth from gradient histograms. The trees are flattened into arrays:
scoring walks all documents of a batch down one level of a tree per step.

Defined results: labels above 0 are good, others bad, null ones ignored; null and empty texts have the same statistics and
are scored like any other; with labels of one class only no tree is grown and every score is that class's smoothed share
((rows + 0.5) / (rows + 1) or 1 less that), without labels scores are null and every document is kept; a value equal to a
threshold goes left, and of equally good splits the first feature and smallest threshold count, so ties do not depend on
order; very long texts are read whole; repeated rows get the same score each, and of a doc_id with several texts one is
trained on. Columns of other names are ignored by ``scored`` and pass through ``kept``.
"""

from __future__ import annotations

import functools
import unicodedata
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vireo.llm import common, textnum

BOUND, TREES, DEPTH, RATE, BINS, RIDGE, THRESHOLD = 12_000, 60, 4, 0.2, 64, 1.0, 0.5
FEATURES = (
    "chars tokens mean_length deviation longest lower upper digit space newline stop symbol other distinct top_share adjacent short long distinct_pairs tokens_a_line repeated_trigrams title_tokens"
).split()
_LOWER, _UPPER, _DIGIT, _SPACE, _NEWLINE, _STOP, _SYMBOL, _OTHER = range(8)


class Trees(NamedTuple):
    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, 2**depth)
    start: float


@functools.cache
def _classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, _OTHER, dtype=np.int64)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))
        if kind in ("Lu", "Lt"):
            out[i] = _UPPER
        elif kind[0] == "L":
            out[i] = _LOWER
        elif kind[0] == "N":
            out[i] = _DIGIT
        elif kind[0] == "Z" or chr(i) in "\t\r":
            out[i] = _SPACE
        elif kind[0] in "PS":
            out[i] = _SYMBOL
    out[[ord(c) for c in ".,;:'\"-()?¿¡"]] = _STOP
    out[ord("\n")] = _NEWLINE
    return out


def _per_doc(key: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, largest count of a key) of each document."""
    distinct, most = np.zeros(n), np.zeros(n)
    if len(key):
        order = np.argsort(key, kind="stable")
        order = order[np.argsort(doc[order], kind="stable")]
        k, d = key[order], doc[order]
        new = np.ones(len(k), dtype=bool)
        new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(k)))
        distinct = np.bincount(d[at], minlength=n).astype(float)
        np.maximum.at(most, d[at], size)
    return distinct, most


def statistics(texts: list[str | None]) -> np.ndarray:
    """(texts, FEATURES)"""
    out = np.zeros((len(texts), len(FEATURES)))
    kinds = _classes()
    for t, (_, _, raw) in zip(textnum.tokenize(texts), textnum.chunks(texts)):
        n = len(t.base)
        chars = np.diff(np.append(t.base, len(raw))) - 1
        kind = kinds[raw]
        owner = np.repeat(np.arange(n), chars + 1)
        kind_count = np.bincount(owner * 8 + kind, minlength=n * 8).reshape(n, 8).astype(float)
        kind_count[:, _NEWLINE] -= 1  # the line feed after each text
        tokens = np.bincount(t.doc, minlength=n).astype(float)
        length = (t.end - t.start).astype(float)
        some, c = np.maximum(tokens, 1), np.maximum(chars, 1)
        mean = np.bincount(t.doc, weights=length, minlength=n) / some
        square = np.bincount(t.doc, weights=length * length, minlength=n) / some
        longest = np.zeros(n)
        np.maximum.at(longest, t.doc, length)
        distinct, most = _per_doc(t.hash, t.doc, n)
        two = np.flatnonzero(t.doc[1:] == t.doc[:-1])
        same = np.bincount(t.doc[two[t.hash[two] == t.hash[two + 1]]], minlength=n)
        pair = t.hash[two] * np.uint64(31) + t.hash[two + 1]
        pairs, _ = _per_doc(pair, t.doc[two], n)
        three = np.flatnonzero(t.doc[2:] == t.doc[:-2])
        tri, _ = _per_doc((t.hash[three] * np.uint64(31) + t.hash[three + 1]) * np.uint64(31) + t.hash[three + 2], t.doc[three], n)
        n3 = np.bincount(t.doc[three], minlength=n)
        title = np.bincount(t.doc[kind[t.start] == _UPPER], minlength=n)
        block = out[t.first : t.first + n]
        block[:, 0:5] = np.stack([np.log1p(chars), np.log1p(tokens), mean, np.sqrt(np.maximum(0, square - mean * mean)), longest], axis=1)
        block[:, 5:13] = kind_count / c[:, None]
        block[:, 13:] = np.stack(
            [distinct / some, most / some, same / some, np.bincount(t.doc[length <= 2], minlength=n) / some, np.bincount(t.doc[length >= 15], minlength=n) / some, pairs / some, tokens / (kind_count[:, _NEWLINE] + 1), 1 - tri / np.maximum(n3, 1), title / some],
            axis=1,
        )
    return out


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, ridge: float = RIDGE) -> Trees:
    """Boosted trees for the logistic loss."""
    n, m = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    start = float(np.log(share / (1 - share)))
    inner, leaves = (1 << depth) - 1, 1 << depth
    out = Trees(np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), start)
    if y.min() == y.max():
        return Trees(*(x[:0] for x in out[:3]), start)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(m)]
    code = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(m)], axis=1)
    score, rows = np.full(n, start), np.arange(n)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            width, first = 1 << level, (1 << level) - 1
            cell = (((node - first)[:, None] * m + np.arange(m)) * bins + code).ravel()
            size = width * m * bins
            gh = np.bincount(cell, weights=np.repeat(g, m), minlength=size).reshape(width, m, bins)
            hh = np.bincount(cell, weights=np.repeat(h, m), minlength=size).reshape(width, m, bins)
            gl, hl = gh.cumsum(axis=2), hh.cumsum(axis=2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < 1) | (ht - hl < 1)] = 0
            for w in range(width):
                f, b = divmod(int(gain[w].argmax()), bins)
                if gain[w, f, b] > 1e-6 and b < len(cuts[f]):
                    out.feature[t, first + w], out.threshold[t, first + w] = f, cuts[f][b]
            node = 2 * node + 1 + (x[rows, out.feature[t, node]] > out.threshold[t, node])
        leaf = node - inner
        gs, hs = np.bincount(leaf, weights=g, minlength=leaves), np.bincount(leaf, weights=h, minlength=leaves)
        out.leaf[t] = -rate * gs / (hs + ridge)
        score += out.leaf[t, leaf]
    return out


def predict(model: Trees | None, x: np.ndarray) -> np.ndarray:
    """The probability of good quality of each row of statistics."""
    if model is None:
        return np.full(len(x), np.nan)
    total, rows = np.full(len(x), model.start), np.arange(len(x))
    trees, inner = model.feature.shape
    depth = (inner + 1).bit_length() - 1
    for t in range(trees):
        node = np.zeros(len(x), dtype=np.int64)
        feature, threshold = model.feature[t], model.threshold[t]
        for _ in range(depth):
            node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
        total += model.leaf[t, node - inner]
    return 1 / (1 + np.exp(-total))


def fit(documents: DataFrame, labels: DataFrame, bound: int = BOUND) -> Trees | None:
    """The trees, from at most ``bound`` labelled documents."""
    common.small_batches(documents.sparkSession)
    texts = common.labelled(documents, labels, "quality", bound)

    def run(batches):
        for b in batches:
            x = statistics(b.column("text").to_pylist())
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("y").cast(pa.int64()), flat], ["doc_id", "y", "x"])

    rows = sorted(map(tuple, texts.mapInArrow(run, "doc_id bigint, y bigint, x array<double>").collect()))
    if not rows:
        return None
    return train(np.array([r[2] for r in rows]), np.array([float(r[1] > 0) for r in rows]))


def scored(docs: DataFrame, documents: DataFrame, labels: DataFrame, bound: int = BOUND, threshold: float = THRESHOLD) -> DataFrame:
    """A row per document: doc_id, score (probability of good quality) and keep."""
    model = docs.sparkSession.sparkContext.broadcast(fit(documents, labels, bound))
    common.small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            p = predict(model.value, statistics(b.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p, pa.float64(), mask=np.isnan(p)), pa.array(~(p < threshold))], ["doc_id", "score", "keep"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double, keep boolean")


def kept(docs: DataFrame, documents: DataFrame, labels: DataFrame, bound: int = BOUND, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold; all columns stay."""
    model = docs.sparkSession.sparkContext.broadcast(fit(documents, labels, bound))

    def change(b: pa.RecordBatch) -> pa.RecordBatch:
        p = predict(model.value, statistics(b.column("text").to_pylist()))
        return b.filter(pa.array(~(p < threshold)))

    return common.pass_rows(docs, change)
