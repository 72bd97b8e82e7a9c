"""Toxicity by the nearest labelled examples.

The examples are a sample of at most ``bound`` labelled documents, each stood for by one passage of ``PASSAGE`` tokens.
Examples are TF-IDF vectors of length 1 over all their terms, none left out; document frequencies are counted over all
documents. They lie in an inverted index with the largest weight per term and block of examples. A query scores all examples
that hold a term of it; of more than ``FULL`` examples it bounds every block by those weights, scores the blocks of the highest
bounds, and then those whose bound reaches the kth result so far. Either way its ``k`` neighbours are exact. A neighbour's weight is 1 / (0.05 + cosine distance).

The vote is the neighbours' weighted share of toxic ones, plus, for every term of the query that goes with the label, its
association times the weighted toxic share of those neighbours that hold the term. The association is the logarithm of a
lower confidence bound (``CONFIDENCE`` standard errors) of the term's toxic share over that of all examples, at least 0. A
logistic fit on the examples' leave-one-out votes calibrates the vote, and nothing else, to a probability.

A text's passage is the run of PASSAGE tokens, of all such runs of the whole text, with the largest sum of associations (a
small share of the smoothed log-odds added, so that few runs are equal). Where its score does not reach the threshold, every
other run, at every position of the text, is searched too unless its vote is bound to be too low (a vote is at most 1 and the
associations of its terms; closer, what the toxic examples that can be neighbours allow); if any reaches the threshold, the
highest counts. What else a text holds, however long it is,
cannot lower its score; and words that go with the label by chance, here and there in a long text, do not add up.

Defined results: labels above 0 are toxic, others clean, null ones ignored; of a doc_id with several texts one is an
example. Null and empty texts, and texts without any term of the examples, have no neighbours and get the toxic share of
such examples, smoothed towards that of all; ties in cosine go to the smaller doc_id, ties between passages to the first; an example is no
neighbour of itself or of rows that repeat its doc_id, and its own terms do not count for it; very long texts are read
whole; repeated rows get the same result each; with labels of one class only every score is that class's smoothed share;
with no usable labels every score is null and nothing counts as toxic. Columns of other names are ignored by ``scored`` and
pass through ``clean``.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vireo.llm import common, textnum

BOUND, K, BLOCK, THRESHOLD, PASSAGE = 12_000, 50, 64, 0.5, 64
CONFIDENCE, SOFT, PRIOR = 3.0, 0.05, 8.0
#: Blocks that a query scores before it has a kth result to exclude others by.
FIRST_BLOCKS = 8
#: Examples up to which a query scores all of them, which is quicker than to bound blocks first.
FULL = 20_000
#: Runs up to which searching them is quicker than bounding them.
FEW = 5
#: Positions of a text whose runs are bounded together; examples, in multiples of k, whose cosines bound the kth best of all.
TOGETHER, POOL = 256, 6


class Association(NamedTuple):
    """How the terms of toxic examples go with the label."""

    terms: np.ndarray  # sorted hashes
    toxic: np.ndarray  # toxic examples that hold each term
    all: np.ndarray
    base: float  # toxic share of all examples

    def strength(self, toxic: np.ndarray, all_: np.ndarray) -> np.ndarray:
        """For terms that ``toxic`` of ``all_`` toxic examples hold."""
        n, z = np.maximum(all_, 1e-9), CONFIDENCE
        p = np.clip(toxic / n, 0, 1)
        low = (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        return np.maximum(0, np.log(np.maximum(low, 1e-9) / self.base))

    def counts(self, term: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(toxic examples, examples) that hold each term, 0 for terms of none; ``own`` (clean, toxic) per term to leave out."""
        toxic, all_ = np.zeros(len(term)), np.zeros(len(term))
        if len(self.terms):
            at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
            ok = self.terms[at] == term
            toxic[ok], all_[ok] = self.toxic[at[ok]], self.all[at[ok]]
            if own is not None:
                toxic[ok] -= own[ok, 1]
                all_[ok] -= own[ok].sum(axis=1)
        return np.maximum(toxic, 0), np.maximum(all_, 0)

    def gain(self, term: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """What each token adds to its passage."""
        toxic, all_ = self.counts(term, own)
        soft = np.log((toxic + PRIOR * self.base) / (all_ + PRIOR) / self.base)
        return self.strength(toxic, all_) + SOFT * np.maximum(0, soft)


class Index(NamedTuple):
    vocab: np.ndarray  # sorted hashes
    idf: np.ndarray
    ids: np.ndarray  # doc_id of each example
    toxic: np.ndarray
    ptr: np.ndarray  # (terms + 1) into the entries, one per term and block that holds it
    block: np.ndarray
    most: np.ndarray  # largest weight of the entry
    start: np.ndarray  # (entries + 1) into the postings
    example: np.ndarray
    weight: np.ndarray
    association: Association
    fit: np.ndarray  # weight of the vote and the shift
    alone: float  # score without neighbours
    k: int


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of all ranges [lo, hi) in a row, the range of each)."""
    size = hi - lo
    which = np.repeat(np.arange(len(lo)), size)
    return np.arange(len(which)) - np.repeat(np.cumsum(size) - size - lo, size), which


def _distinct(doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count), sorted, of tokens whose documents rise."""
    order = np.argsort(term, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    d, h = doc[order], term[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return d[at], h[at], np.diff(np.append(at, len(h)))


def _cat(parts: list, kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype=kind)


def passages(texts: list[str | None], a: Association, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count), sorted, of each text's passage, and the sum of each passage; ``own`` (clean, toxic) examples of each
    text to leave out."""
    docs, terms, counts, value_of = [], [], [], np.zeros(len(texts))
    for t in textnum.tokenize(texts):
        if not len(t.doc):
            continue
        first = np.searchsorted(t.doc, np.arange(len(t.base) + 1))
        gain = a.gain(t.hash, None if own is None else own[t.first + t.doc])
        total = np.concatenate([[0.0], np.cumsum(gain)])
        i = np.arange(len(t.doc))
        room = np.maximum(first[t.doc], first[t.doc + 1] - PASSAGE)  # no run starts later, lest it be short
        end = np.minimum(i + PASSAGE, first[t.doc + 1])
        value = np.where(i <= room, np.round(total[end] - total[:-1], 9), -1.0)
        some = np.flatnonzero(np.diff(first))
        best = np.maximum.reduceat(value, first[some])
        value_of[t.first + some] = best
        of = np.cumsum(np.diff(t.doc, prepend=t.doc[0]) > 0)
        hit = np.flatnonzero(value == best[of])
        begin = hit[np.unique(of[hit], return_index=True)[1]]
        inside = (i >= begin[of]) & (i < begin[of] + PASSAGE)
        d, h, c = _distinct(t.doc[inside], t.hash[inside])
        docs.append(d + t.first)
        terms.append(h)
        counts.append(c)
    return _cat(docs, np.int64), _cat(terms, np.uint64), _cat(counts, np.int64), value_of


def _term_labels(batches):
    for b in batches:
        y = np.array(b.column("y").to_pylist(), dtype=np.int64)
        docs, terms = [], []
        for t in textnum.tokenize(b.column("text").to_pylist()):
            d, h, _ = _distinct(t.doc, t.hash)
            docs.append(d + t.first)
            terms.append(h)
        u, at = np.unique(_cat(terms, np.uint64), return_inverse=True)
        toxic = np.bincount(at, weights=y[_cat(docs, np.int64)], minlength=len(u)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(toxic), pa.array(np.bincount(at, minlength=len(u)))], ["term", "toxic", "all"])


def _document_frequency(vocab: np.ndarray):
    def run(batches):
        df, n = np.zeros(len(vocab), dtype=np.int64), 0
        for b in batches:
            for t in textnum.tokenize(b.column("text").to_pylist()):
                if len(vocab):
                    at = np.minimum(np.searchsorted(vocab, t.hash), len(vocab) - 1)
                    ok = vocab[at] == t.hash
                    df += np.bincount(np.unique(t.doc[ok] * len(vocab) + at[ok]) % len(vocab), minlength=len(vocab))
            n += b.num_rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["term", "df"])

    return run


def _lists(at: np.ndarray, x: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x, kind))


def _example_passages(a: Association):
    def run(batches):
        for b in batches:
            y = np.array(b.column("y").to_pylist(), dtype=np.int64)
            doc, term, count, _ = passages(b.column("text").to_pylist(), a, np.stack([1 - y, y], axis=1))
            at = np.searchsorted(doc, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(y), _lists(at, term.view(np.int64)), _lists(at, count)], ["doc_id", "y", "terms", "counts"])

    return run


def _weights(idf: np.ndarray, term: np.ndarray, count: np.ndarray) -> np.ndarray:
    w = (1 + np.log(count)) * idf[term]
    return w / np.sqrt((w * w).sum()) if len(w) else w


def _edges(ix: Index, term: np.ndarray) -> tuple[list[int], list[int]]:
    """Where the postings of each term begin and end."""
    return ix.start[ix.ptr[term]].tolist(), ix.start[ix.ptr[term + 1]].tolist()


def _near(ix: Index, at: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those that reach the kth best score, about."""
    if len(score) > ix.k:
        near = np.flatnonzero(score >= np.partition(score, len(score) - ix.k)[len(score) - ix.k] - 1e-8)
        at, score = at[near], score[near]
    return at, score


def _best(ix: Index, at: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best, in order."""
    at, score = _near(ix, at, score)
    top = np.lexsort((ix.ids[at], -np.round(score, 9)))[: ix.k]
    return at[top], score[top]


def nearest(ix: Index, term: np.ndarray, w: np.ndarray, skip: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(examples, cosines) of the k nearest with a cosine over 0, exact; ``skip`` is a doc_id to leave out."""
    if len(ix.ids) <= FULL:
        score = np.zeros(len(ix.ids))
        for a, z, x in zip(*_edges(ix, term), w.tolist()):
            score[ix.example[a:z]] += x * ix.weight[a:z]
        if skip is not None:
            score[ix.ids == skip] = 0
        n = len(score)
        least = np.partition(score, n - ix.k)[n - ix.k] - 1e-8 if n > ix.k else 0
        at = np.flatnonzero(score >= least if least > 0 else score > 0)
        return _best(ix, at, score[at])
    entry, which = _ranges(ix.ptr[term], ix.ptr[term + 1])
    block = ix.block[entry]
    blocks = -(-len(ix.ids) // BLOCK)
    bound = np.bincount(block, weights=w[which] * ix.most[entry], minlength=blocks)
    todo = np.zeros(blocks, dtype=bool)
    todo[np.argpartition(-bound, FIRST_BLOCKS)[:FIRST_BLOCKS] if blocks > FIRST_BLOCKS else slice(None)] = True
    done = todo.copy()
    at, best = np.zeros(0, dtype=np.int64), np.zeros(0)
    for _ in range(2):
        some = todo[block]
        e = entry[some]
        p, of = _ranges(ix.start[e], ix.start[e + 1])
        score = np.bincount(ix.example[p], weights=w[which[some]][of] * ix.weight[p], minlength=1)
        new = np.flatnonzero(score > 0)
        if skip is not None:
            new = new[ix.ids[new] != skip]
        at, best = _near(ix, np.concatenate([at, new]), np.concatenate([best, score[new]]))
        todo = ~done & (bound > 0)
        if len(best) >= ix.k:
            todo &= bound >= best.min() - 1e-8
        if not todo.any():
            break
    return _best(ix, at, best)


def vote(ix: Index, at: np.ndarray, cosine: np.ndarray, term: np.ndarray, strength: np.ndarray) -> float:
    """Of the neighbours ``at`` of a query with these terms (positions in the vocabulary) of these associations."""
    w = 1 / (0.05 + np.maximum(0, 1 - cosine))
    total = float((w * ix.toxic[at]).sum() / w.sum())
    some = strength > 0
    every, toxic = np.zeros((2, len(ix.ids)))
    every[at], toxic[at] = w, w * ix.toxic[at]
    for a, z, s in zip(*_edges(ix, term[some]), strength[some].tolist()):
        holds = ix.example[a:z]
        if share := toxic[holds].sum():
            total += s * float(share / every[holds].sum())
    return total


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the columns and the shift of a logistic fit, by Newton steps with a small ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + 1e-2 * w)
        w = w - step * min(1, 5 / max(1e-12, abs(step).max()))
        if abs(step).max() < 1e-9:
            break
    return w


def _score(ix: Index, votes: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(ix.fit @ [votes, 1], -30, 30))))


def _strength(ix: Index, term: np.ndarray, own: np.ndarray | None) -> np.ndarray:
    h = ix.vocab[term]
    return ix.association.strength(*ix.association.counts(h, None if own is None else np.tile(own, (len(h), 1))))


def build(vocab: np.ndarray, idf: np.ndarray, rows: list[tuple], association: Association, k: int = K) -> Index | None:
    """The index of examples (doc_id, toxic, terms as positions in ``vocab``, counts), fitted to their own votes. They are
    ordered by their heaviest term, so that blocks hold like examples and their bounds are tight."""
    kept, alone, y_all = [], [2 * association.base, 2.0], []  # as if two more had the share of all
    for i, y, term, count in rows:
        term, count = np.asarray(term, dtype=np.int64), np.asarray(count, dtype=np.int64)
        y_all.append(y)
        if len(term):
            w = _weights(idf, term, count)
            kept.append((int(term[np.argmax(w)]), i, y, term, w))
        else:
            alone[0] += y
            alone[1] += 1
    if not y_all:
        return None
    kept.sort(key=lambda r: r[:2])
    term = _cat([r[3] for r in kept], np.int64)
    example = np.repeat(np.arange(len(kept)), [len(r[3]) for r in kept])
    weight = _cat([r[4] for r in kept], np.float64)
    order = np.lexsort((example, term))
    term, example, weight = term[order], example[order], weight[order]
    blocks = max(1, -(-len(kept) // BLOCK))
    cell = term * blocks + example // BLOCK
    start = textnum.runs(cell)
    ix = Index(
        vocab, idf, np.array([r[1] for r in kept], dtype=np.int64), np.array([r[2] for r in kept], dtype=np.float64), np.searchsorted(cell[start] // blocks, np.arange(len(vocab) + 1)), cell[start] % blocks,
        np.maximum.reduceat(weight, start) if len(start) else np.zeros(0), np.append(start, len(cell)), example, weight, association, np.array([1.0, 0.0]), alone[0] / alone[1], k,
    )
    if len(set(y_all)) == 1:
        share = (sum(y_all) + 1) / (len(y_all) + 2)
        return ix._replace(fit=np.array([0.0, np.log(share / (1 - share))]), alone=share)
    votes, ys = [], []
    for _, i, y, term, w in kept:
        at, cosine = nearest(ix, term, w, i)
        if len(at):
            votes.append(vote(ix, at, cosine, term, _strength(ix, term, np.array([1 - y, y]))))
            ys.append(y)
    return ix._replace(fit=_logistic(np.array(votes)[:, None], np.array(ys))) if votes else ix


def fit(documents: DataFrame, labels: DataFrame, bound: int = BOUND, k: int = K) -> Index | None:
    """The index, from labelled documents (at most ``bound``) and document frequencies over all documents."""
    common.small_batches(documents.sparkSession)
    sc = documents.sparkSession.sparkContext
    toxic = labels.select("doc_id", (F.col("toxic") > 0).cast("bigint").alias("toxic"))
    texts = common.written(common.labelled(documents, toxic, "toxic", bound), "labelled")
    size = dict(texts.groupBy("y").count().collect())
    n = sum(size.values())
    if not n:
        return None
    terms = texts.select("text", "y").mapInArrow(_term_labels, "term bigint, toxic bigint, all bigint").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("all").alias("all"))
    found = terms.where("toxic > 0").toArrow()  # the terms of the sample's toxic documents
    hashes = found.column("term").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    association = Association(hashes[order], found.column("toxic").to_numpy()[order], found.column("all").to_numpy()[order], max(size.get(1, 0), 0.5) / n)
    rows = texts.mapInArrow(_example_passages(association), "doc_id bigint, y bigint, terms array<bigint>, counts array<bigint>").toArrow().sort_by("doc_id")
    lists = [rows.column(c).combine_chunks() for c in ("terms", "counts")]
    at = np.concatenate([[0], np.cumsum(lists[0].value_lengths().to_numpy())])
    flat = [x.flatten().to_numpy() for x in lists]
    vocab, place = np.unique(flat[0].view(np.uint64), return_inverse=True)
    held = sc.broadcast(vocab)
    df = documents.select("text").mapInArrow(lambda batches: _document_frequency(held.value)(batches), "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    term, count = df.column("term").to_numpy(), df.column("df").to_numpy()
    total = int(count[term < 0].sum())
    counts = np.zeros(len(vocab))
    counts[term[term >= 0]] = count[term >= 0]
    idf = np.log((1 + total) / (1 + counts)) + 1
    examples = [(i, y, place[a:z], flat[1][a:z]) for i, y, a, z in zip(rows.column("doc_id").to_pylist(), rows.column("y").to_pylist(), at[:-1].tolist(), at[1:].tolist())]
    return build(vocab, idf, examples, association, k)


def _own(ix: Index, ids: list[int | None]) -> tuple[np.ndarray, list[int | None]]:
    """(examples (clean, toxic) that are the document itself, its doc_id if there are any) of each doc_id."""
    own = np.zeros((len(ids), 2))
    order = np.argsort(ix.ids, kind="stable")
    sorted_ids = ix.ids[order]
    known = np.array([-1 if i is None else i for i in ids], dtype=np.int64)
    at = np.minimum(np.searchsorted(sorted_ids, known), max(0, len(sorted_ids) - 1))
    mine = np.array([i is not None for i in ids], dtype=bool) & (sorted_ids[at] == known) if len(sorted_ids) else np.zeros(len(ids), dtype=bool)
    own[mine, ix.toxic[order[at[mine]]].astype(np.int64)] = 1
    return own, [i if m else None for i, m in zip(ids, mine.tolist())]


def _least(ix: Index, threshold: float) -> float:
    """The vote from which the score reaches the threshold."""
    if ix.fit[0] <= 0 or threshold <= 0:
        return -np.inf
    return np.inf if threshold >= 1 else float((np.log(threshold / (1 - threshold)) - ix.fit[1]) / ix.fit[0]) - 1e-9


def _hopeful(ix: Index, place: np.ndarray, begin: np.ndarray, end: np.ndarray, own: np.ndarray | None, skip: int | None, least: float) -> np.ndarray:
    """Which of a text's runs [begin, end) of tokens (positions in the vocabulary, -1 for others) can have a vote of ``least``.

    The kth best cosine with a few examples is at most that with all, so only toxic examples above it can be neighbours. The
    toxic share is at most theirs, the other neighbours being at least as near as that; and of the terms those alone count
    that they hold."""
    ok = np.zeros(len(begin), dtype=bool)
    low = int(begin.min())
    term, u = np.unique(place[low : int(end.max())], return_inverse=True)
    strange = len(term) and term[0] < 0
    at, run = _ranges(begin - low, end - low)
    count = np.bincount(run * len(term) + u[at], minlength=len(begin) * len(term)).reshape(len(begin), len(term))
    if strange:
        term, count = term[1:], count[:, 1:]
    strength = _strength(ix, term, own)
    strong = np.flatnonzero(strength > 0)
    strength = strength[strong]
    some = np.flatnonzero(1 + (count[:, strong] > 0) @ strength >= least - 1e-6)
    if len(some) <= FEW or not len(term):
        ok[some] = True
        return ok
    count = count[some]
    query = np.append(0, 1 + np.log(np.arange(1, count.max() + 1)))[count] * ix.idf[term]
    query /= np.maximum(np.sqrt(np.einsum("ij,ij->i", query, query)), 1e-300)[:, None]
    edge = list(zip(*_edges(ix, term)))
    example, weight = (np.concatenate([x[a:z] for a, z in edge]) for x in (ix.example, ix.weight))
    of = np.repeat(np.arange(len(term)), [z - a for a, z in edge])
    if skip is not None:
        weight[ix.ids[example] == skip] = 0
    most = np.bincount(example, weights=query.max(axis=0)[of] * weight, minlength=len(ix.ids))

    def cosines(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        column = np.full(len(ix.ids), -1)
        column[which] = np.arange(len(which))
        mine = np.flatnonzero(column[example] >= 0)
        x = np.zeros((len(term), len(which)))
        x[of[mine], column[example[mine]]] = weight[mine]
        return query @ x, x[strong] > 0

    kth = np.zeros(len(some))
    if len(most) > ix.k:
        pool = min(len(most), POOL * ix.k)
        near, _ = cosines(np.argpartition(-most, pool - 1)[:pool])
        kth = np.maximum(0, np.partition(near, pool - ix.k, axis=1)[:, pool - ix.k] - 1e-8)
    cosine, holds = cosines(np.flatnonzero((ix.toxic > 0) & (most > 0) & (most >= kth.min())))
    hit = (cosine >= kth[:, None]) & (cosine > 0)
    row, column = np.nonzero(hit)
    toxic = np.bincount(row, weights=1 / (0.05 + np.maximum(0, 1 - cosine[row, column])), minlength=len(some))
    clean = np.where(kth > 0, np.maximum(0, ix.k - hit.sum(axis=1)) / (0.05 + np.maximum(0, 1 - kth)), 0)
    held = (hit.astype(np.float32) @ holds.T.astype(np.float32) > 0) & (count[:, strong] > 0)
    ok[some] = toxic / np.maximum(toxic + clean, 1e-300) + held @ strength >= least - 1e-6
    return ok


def highest(ix: Index, texts: list[str], own: np.ndarray, skip: list[int | None], threshold: float):
    """(text, score, neighbours, cosines) of each text's run of PASSAGE tokens with the highest score, for texts where one can
    reach the threshold. A vote is at most 1 and the associations of its terms, so runs below that are left out unsearched, and
    so are those that are not ``_hopeful``."""
    least = _least(ix, threshold)
    for t in textnum.tokenize(texts) if len(ix.vocab) else ():
        if not len(t.doc):
            continue
        toxic, all_ = ix.association.counts(t.hash, own[t.first + t.doc])
        total = np.concatenate([[0.0], np.cumsum(ix.association.strength(toxic, all_))])
        last = np.searchsorted(t.doc, t.doc, side="right")
        end = np.minimum(np.arange(len(t.doc)) + PASSAGE, last)
        first = np.searchsorted(t.doc, t.doc)
        run = np.flatnonzero((np.arange(len(t.doc)) <= np.maximum(first, last - PASSAGE)) & (1 + total[end] - total[:-1] >= least))
        inside = np.flatnonzero(np.cumsum(np.bincount(run, minlength=len(t.doc) + 1) - np.bincount(end[run], minlength=len(t.doc) + 1))[:-1])
        place = np.full(len(t.doc), -1)
        place[inside] = np.minimum(np.searchsorted(ix.vocab, t.hash[inside]), len(ix.vocab) - 1)
        place[inside[ix.vocab[place[inside]] != t.hash[inside]]] = -1
        if ix.fit[0] > 0 and len(run):
            cut = np.append(textnum.runs(t.doc[run] * len(t.doc) + run // TOGETHER), len(run)).tolist()
            keep = []
            for a, z in zip(cut[:-1], cut[1:]):
                j = t.first + int(t.doc[run[a]])
                keep.append(_hopeful(ix, place, run[a:z], end[run[a:z]], None if skip[j] is None else own[j], skip[j], least))
            run = run[np.concatenate(keep)]
        run = run[np.lexsort((run, -np.round(total[end[run]] - total[run], 9), t.doc[run]))]
        edge = np.append(textnum.runs(t.doc[run]), len(run)).tolist()
        for a, z in zip(edge[:-1], edge[1:]):
            j = t.first + int(t.doc[run[a]])
            best, bar, seen = None, least, set()
            for i in run[a:z].tolist():
                if 1 + total[end[i]] - total[i] < bar:
                    break  # so are all that follow
                inside = place[i : end[i]]
                term, count = np.unique(inside[inside >= 0], return_counts=True)
                strength = _strength(ix, term, None if skip[j] is None else own[j])
                key = (term.tobytes(), count.tobytes())
                if not len(term) or 1 + strength.sum() < bar or key in seen:
                    continue
                seen.add(key)
                near, cosine = nearest(ix, term, _weights(ix.idf, term, count), skip[j])
                if len(near):
                    votes = vote(ix, near, cosine, term, strength)
                    score = _score(ix, votes)
                    if best is None or score > best[1]:
                        best = j, score, near, cosine
                        if ix.fit[0] > 0:
                            bar = max(bar, votes)
            if best:
                yield best


def score_texts(ix: Index | None, ids: list[int | None], texts: list[str | None]) -> list[tuple[float | None, np.ndarray, np.ndarray]]:
    """(score, doc_ids of the neighbours, their cosines) of each text's passage."""
    return _scored_passages(ix, ids, texts)[0]


def _scored_passages(ix: Index | None, ids: list[int | None], texts: list[str | None]) -> tuple[list[tuple[float | None, np.ndarray, np.ndarray]], np.ndarray]:
    """The same, and each passage's sum, which no run's associations exceed."""
    none = np.zeros(0, dtype=np.int64), np.zeros(0)
    if ix is None:
        return [(None, *none)] * len(texts), np.zeros(len(texts))
    own, skip = _own(ix, ids)
    doc, h, count, value = passages(texts, ix.association, own)
    if len(ix.vocab):
        term = np.minimum(np.searchsorted(ix.vocab, h), len(ix.vocab) - 1)
        ok = ix.vocab[term] == h
        doc, term, count = doc[ok], term[ok], count[ok]
    else:
        doc, term, count = doc[:0], doc[:0], count[:0]
    edge = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    for j, (a, z) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())):
        near, cosine = none
        if a < z:
            near, cosine = nearest(ix, term[a:z], _weights(ix.idf, term[a:z], count[a:z]), skip[j])
        if not len(near):
            out.append((ix.alone, *none))
            continue
        share = vote(ix, near, cosine, term[a:z], _strength(ix, term[a:z], None if skip[j] is None else own[j]))
        out.append((_score(ix, share), ix.ids[near], np.round(cosine, 6)))
    return out, value


def decided(ix: Index | None, ids: list[int | None], texts: list[str | None], threshold: float = THRESHOLD) -> list[tuple[float | None, np.ndarray, np.ndarray]]:
    """The same for whole texts: of the passage, or of the run that reaches the threshold with the highest score where the
    passage does not."""
    out, value = _scored_passages(ix, ids, texts)
    if ix is not None and ix.fit[0]:
        rest = [j for j, f in enumerate(out) if f[0] < threshold and 1 + value[j] >= _least(ix, threshold) - 1e-6]
        own, skip = _own(ix, [ids[j] for j in rest])
        for n, score, near, cosine in highest(ix, [texts[j] for j in rest], own, skip, threshold):
            if score >= threshold:
                out[rest[n]] = score, ix.ids[near], np.round(cosine, 6)
    return out


def scored(docs: DataFrame, documents: DataFrame, labels: DataFrame, bound: int = BOUND, k: int = K, threshold: float = THRESHOLD) -> DataFrame:
    """A row per document: doc_id, score, is_toxic and the evidence: the examples' doc_ids and cosines."""
    ix = docs.sparkSession.sparkContext.broadcast(fit(documents, labels, bound, k))
    common.small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            found = decided(ix.value, b.column("doc_id").to_pylist(), b.column("text").to_pylist(), threshold)
            edge = np.cumsum([0] + [len(f[1]) for f in found])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([f[0] for f in found], pa.float64()), pa.array([f[0] is not None and f[0] >= threshold for f in found]), _lists(edge, _cat([f[1] for f in found], np.int64), pa.int64()), _lists(edge, _cat([f[2] for f in found], np.float64), pa.float64())],
                ["doc_id", "score", "is_toxic", "evidence", "cosines"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double, is_toxic boolean, evidence array<bigint>, cosines array<double>")


def clean(docs: DataFrame, documents: DataFrame, labels: DataFrame, bound: int = BOUND, k: int = K, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that do not count as toxic; all columns stay."""
    ix = docs.sparkSession.sparkContext.broadcast(fit(documents, labels, bound, k))

    def change(b: pa.RecordBatch) -> pa.RecordBatch:
        found = decided(ix.value, b.column("doc_id").to_pylist(), b.column("text").to_pylist(), threshold)
        return b.filter(pa.array([f[0] is None or f[0] < threshold for f in found], pa.bool_()))

    return common.pass_rows(docs, change)
