"""Language-model scoring with an Elias-Fano n-gram trie.

The model is a trigram model of the whole corpus with interpolated absolute discounting. Every word, bigram and trigram
that occurs ``least`` times is kept; the query keeps those seen once. With a larger ``least``, words seen less often are
one unknown word, and the mass of bigrams and trigrams seen less often goes to the lower order:

    p(c | a b) = q3(a b c) + b3(a b) * p(c | b),  p(c | b) = q2(b c) + b2(b) * p1(c)

with q(n-gram) = (count - D) / count of its context, and b a context's mass that its kept n-grams leave. A document's
first token has no context and its second one word. q, b and p1 are kept as eighths of a bit, one byte each.

* Words: the 64-bit token hashes without the lowest bit, sorted, are Elias-Fano sequences; a word's rank is its id.
* The trie is split by a hash of (a, b). In a split, the a are one sequence; pointers, monotone and so again Elias-Fano,
  lead to the run of each a's successors b, and from each (a, b) to the run of its successors c. A run's values are
  raised by the last value of the run before, so that the level is monotone; a search looks for that base plus the id,
  within the run. Levels are files in the shared folder, memory-mapped by every worker.

What is gathered: each task ships its distinct trigrams with counts as compressed blocks, one per split; counts are
exact. Nothing but a few numbers per split goes to the driver. A pair of words that both occur more than ``SPLIT_TOKENS``
times may have more successors than a split should hold. The trigrams of such pairs are split by a hash of (a, b, c) instead:
their counts are summed there, the sums of a pair over all splits are added up, and then their successors are written
(``after-*``) and the pairs themselves, by their hash (``pairs-*``). So what one task merges does not grow with the corpus,
but for a row per block of tokens of each trigram that occurs everywhere.

Defined results: a null or empty text has 0 tokens and a null score; repeated rows count each time; very long texts are
scored whole; an empty corpus gives every document without tokens null; columns of other names are ignored. Two words whose hashes agree are one word (about V**2 / 2**64 pairs).
"""

from __future__ import annotations

import functools
import os
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vireo.llm import common, eliasfano, textnum

DISCOUNT, MIN_COUNT = 0.75, 2
#: Tokens that a task holds at once, that a split of the trie covers, and words of a vocabulary file, about.
FLUSH, SPLIT_TOKENS, FILE_WORDS = 1_000_000, 4_000_000, 500_000
#: Tokens that are looked up at once: each block calls on every split, and few tokens a call cost the most.
BLOCK = 2_000_000


class Model(NamedTuple):
    folder: str
    tokens: int
    unknown: int  # how often the unknown word occurs
    bases: np.ndarray  # id of the first word of each vocabulary file, and the number of words
    splits: int
    least: int  # how often an n-gram of the trie occurs at least
    hot: np.ndarray  # ids of the words that occur more than SPLIT_TOKENS times, at most as many as there are splits
    made: dict[str, frozenset]  # the numbers of the files of each kind: of these a missing one is an error


def quantise(p: np.ndarray) -> np.ndarray:
    """Eighths of a bit below 1; 255 also stands for anything less."""
    return np.clip(np.round(-8 * np.log2(np.maximum(p, 1e-12))), 0, 255).astype(np.uint8)


#: What a code stands for; beyond the codes of ``quantise`` there is one for no mass at all.
_NONE = 256
_VALUE = np.append(2.0 ** (-np.arange(256) / 8), 0.0)


def _flushes(batches, size: int | None = None):
    """(batches' doc ids, texts' token hashes, text of each token) until ``size`` tokens (FLUSH) are together."""
    ids, hashes, docs, n, rows = [], [], [], 0, 0
    for b in batches:
        ids += b.column("doc_id").to_pylist()
        for t in textnum.tokenize(b.column("text").to_pylist()):
            hashes.append(t.hash >> np.uint64(1))
            docs.append((t.doc + (t.first + rows)).astype(np.int32))
            n += len(t.hash)
        rows += b.num_rows
        if n >= (size or FLUSH):
            yield ids, np.concatenate(hashes), np.concatenate(docs)
            ids, hashes, docs, n, rows = [], [], [], 0, 0
    if rows:
        yield ids, np.concatenate([np.zeros(0, np.uint64), *hashes]), np.concatenate([np.zeros(0, np.int32), *docs])


def _word_counts(batches):
    for _, h, _ in _flushes(batches):
        word, count = np.unique(h, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(count)], ["word", "count"])


def _write(path: str, arrays: dict) -> None:
    from pyspark import TaskContext

    own = f"{path}.{TaskContext.get().taskAttemptId()}"
    eliasfano.save(own, arrays)
    os.replace(own, path)


def _write_words(folder: str, tokens: int):
    def run(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        word, count = t.column("word").to_numpy(), t.column("count").to_numpy()
        order = np.argsort(word)
        word, count = word[order], count[order]
        _write(f"{folder}/words-{part}", {"words": eliasfano.build(word), "p1": quantise(count / tokens), "count": count})
        return pa.table({"part": pa.array([part], pa.int32()), "words": [len(word)]})

    return run


@functools.lru_cache(maxsize=4096)
def _load(path: str) -> dict:
    return eliasfano.load(path)


def word_ids(m: Model, hashes: np.ndarray) -> np.ndarray:
    """Ids of sorted distinct hashes; the unknown word's is the number of words."""
    parts = len(m.bases) - 1
    out = np.full(len(hashes), m.bases[-1], dtype=np.int64)
    part = (hashes >> np.uint64(63 - (parts.bit_length() - 1))).astype(np.int64) if parts > 1 else np.zeros(len(hashes), dtype=np.int64)
    edge = np.searchsorted(part, np.arange(parts + 1))
    for p in range(parts):
        a, z = edge[p], edge[p + 1]
        if a < z and m.bases[p] < m.bases[p + 1]:
            f = _load(f"{m.folder}/words-{p}")
            at = eliasfano.find(f["words"], hashes[a:z].astype(np.int64))
            out[a:z] = np.where(at >= 0, at + m.bases[p], m.bases[-1])
    return out


def by_word(m: Model, ids: np.ndarray, prefix: str, key: str, unknown) -> np.ndarray:
    """A value of each word id from the vocabulary files; ``unknown`` for ids beyond."""
    order = np.argsort(ids, kind="stable")
    s = ids[order]
    edge = np.searchsorted(s, m.bases)
    out = np.full(len(ids), unknown, dtype=np.float64)
    for p in range(len(m.bases) - 1):
        a, z = edge[p], edge[p + 1]
        if a < z:
            out[order[a:z]] = _load(f"{m.folder}/{prefix}-{p}")[key][s[a:z] - m.bases[p]]
    return out


def _by_number(of: np.ndarray, below: int) -> np.ndarray:
    """The order of small numbers, like ones in their order; up to 16 bits numpy counts instead of comparing."""
    return np.argsort(of.astype(np.min_scalar_type(below)), kind="stable")


def split_of(m: Model, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (textnum.mix((a.astype(np.uint64) << np.uint64(32)) ^ b.astype(np.uint64)) % np.uint64(m.splits)).astype(np.int64)


def split_of_three(m: Model, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    pair = textnum.mix((a.astype(np.uint64) << np.uint64(32)) ^ b.astype(np.uint64))
    return (textnum.mix(pair ^ c.astype(np.uint64)) % np.uint64(m.splits)).astype(np.int64)


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One rising number of a pair of ids; ids are below 2**31."""
    return (a.astype(np.int64) << 31) | b.astype(np.int64)


def _ship(columns: list[np.ndarray]) -> bytes:
    """Columns of 32-bit values, bytes of like weight together, compressed; the first, which rises, as differences."""
    first = np.diff(columns[0], prepend=columns[0][:1])
    first[:1] = columns[0][:1]
    x = np.stack([first, *columns[1:]]).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1, 4).transpose(0, 2, 1)).tobytes())


def _unship(blob: bytes, n: int) -> list[np.ndarray]:
    x = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, 4, n).transpose(0, 2, 1)
    x = np.ascontiguousarray(x).view("<u4")[:, :, 0]
    return [np.cumsum(x[0], dtype=np.uint32), x[1], x[2], x[3]]


def _ids(m: Model, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the distinct words, rank of each token's word among them)."""
    word, at = np.unique(h, return_inverse=True)
    known = word_ids(m, word)
    ids, back = np.unique(known, return_inverse=True)
    return ids, back[at]


def _trigrams(m: Model):
    def run(batches):
        for _, h, doc in _flushes(batches):
            if not len(h):
                continue
            ids, w = _ids(m, h)
            ids = np.append(ids, m.bases[-1] + 1)  # the end of a text
            hot = np.isin(ids, m.hot)
            end = len(ids) - 1
            second, third = np.full(len(w), end), np.full(len(w), end)
            second[:-1] = np.where(doc[1:] == doc[:-1], w[1:], end)
            third[:-2] = np.where(doc[2:] == doc[:-2], w[2:], end)
            bits = len(ids).bit_length()
            if 3 * bits <= 63:
                key = (w << (2 * bits)) | (second << bits) | third
                key, count = np.unique(key, return_counts=True)
                mask = (1 << bits) - 1
                a, b, c = key >> (2 * bits), (key >> bits) & mask, key & mask
            else:
                (a, b, c), count = np.unique(np.stack([w, second, third]), axis=1, return_counts=True)
            both = np.flatnonzero(hot[a] & hot[b])
            a, b, c = ids[a], ids[b], ids[c]
            split = split_of(m, a, b)
            split[both] = split_of_three(m, a[both], b[both], c[both])
            order = _by_number(split, m.splits)
            a, b, c, count, split = a[order], b[order], c[order], count[order], split[order]
            edge = np.append(textnum.runs(split), len(split))
            blobs = [_ship([a[i:j], b[i:j], c[i:j], count[i:j]]) for i, j in zip(edge[:-1], edge[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(split[edge[:-1]]), pa.array(np.diff(edge)), pa.array(blobs, pa.binary())], ["split", "n", "blob"])

    return run


def raised(run: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Values of runs (rising inside each), raised by the last raised value of the run before: non-decreasing."""
    if not len(value):
        return value
    first = textnum.runs(run)
    last = value[np.append(first[1:], len(value)) - 1]
    base = np.concatenate([[0], np.cumsum(last)[:-1]])
    return value + np.repeat(base, np.diff(np.append(first, len(value))))


def _merged(parts: list[list[np.ndarray]], top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (a, b, c), sorted, with their counts added up; ids are at most ``top``."""
    a, b, c, count = (np.concatenate([p[k] for p in parts]) for k in range(4))
    parts.clear()
    bits = top.bit_length()
    if 3 * bits <= 63:  # the blocks are sorted, so one stable sort merges them
        key = (a.astype(np.int64) << (2 * bits)) | (b.astype(np.int64) << bits) | c
        order = np.argsort(key, kind="stable")
        del key
    else:  # pairs first, then their numbers and c
        pair = pair_key(a, b)
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        key = np.zeros(len(pair), dtype=np.int64)
        np.cumsum(pair[1:] != pair[:-1], out=key[1:])
        del pair
        key = (key << 31) | c[order]
        order = order[np.argsort(key, kind="stable")]
        del key
    a, b, c = a[order], b[order], c[order]
    count = count[order].astype(np.int64)
    del order
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
    at = np.flatnonzero(new)
    return a[at].astype(np.int64), b[at].astype(np.int64), c[at].astype(np.int64), np.add.reduceat(count, at)


def _contexts(m: Model, a: np.ndarray, b: np.ndarray, count: np.ndarray):
    """(where each pair begins, pair of each row, kept rows, the pairs' counts, the mass of their kept trigrams)"""
    pair = np.ones(len(a), dtype=bool)
    pair[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    of = np.cumsum(pair) - 1
    context = np.bincount(of, weights=count).astype(np.int64)
    kept = (count >= m.least) & (b <= m.bases[-1])  # nothing follows the end of a text
    return pair, of, kept, context, np.bincount(of[kept], weights=count[kept] - DISCOUNT, minlength=len(context)).astype(np.float64)


_SPLIT = "word bigint, second bigint, total bigint, mass double, split bigint"


def _write_split(m: Model):
    """One split of the trie. Gives the mass that each first word's kept bigrams take; of the pairs that other splits share,
    what this split has of them; and a row with the split's number alone."""

    def run(batches):
        parts, split = [], 0
        for t in batches:
            split = t.column("split")[0].as_py()
            parts += [_unship(blob, n) for n, blob in zip(t.column("n").to_pylist(), t.column("blob").to_pylist())]
        if not parts:
            return
        a, b, c, count = _merged(parts, int(m.bases[-1]) + 1)
        if len(m.hot):
            hot = np.isin(a, m.hot) & np.isin(b, m.hot)
            if hot.any():
                x = [v[hot] for v in (a, b, c, count)]
                a, b, c, count = (v[~hot] for v in (a, b, c, count))
                _write(f"{m.folder}/hot-{split}", dict(zip("abcn", x)))
                pair, _, _, context, mass = _contexts(m, x[0], x[1], x[3])
                yield pa.RecordBatch.from_arrays([pa.array(x[0][pair]), pa.array(x[1][pair]), pa.array(context), pa.array(mass), pa.array(np.full(len(context), split))], _NAMES)
        pair, of, kept, context, mass3 = _contexts(m, a, b, count)
        keep2 = context >= m.least
        node = np.cumsum(keep2) - 1
        of3, c3, q3 = node[of[kept]], c[kept], quantise((count[kept] - DISCOUNT) / context[of[kept]])
        a2, b2, n2 = a[pair][keep2], b[pair][keep2], context[keep2]
        del a, b, c, count, of, kept, pair
        firsts = textnum.runs(a2)
        _write(
            f"{m.folder}/split-{split}",
            {
                "a": eliasfano.build(a2[firsts]), "to2": eliasfano.build(np.append(firsts, len(a2))), "b": eliasfano.build(raised(a2, b2)),
                "q2": quantise((n2 - DISCOUNT) / by_word(m, a2, "words", "count", m.unknown)), "b3": quantise(1 - mass3[keep2] / n2),
                "to3": eliasfano.build(np.searchsorted(of3, np.arange(len(a2) + 1))), "c": eliasfano.build(raised(of3, c3)), "q3": q3,
            },
        )
        mass = np.add.reduceat(n2 - DISCOUNT, firsts) if len(firsts) else np.zeros(0)
        none = pa.nulls(len(firsts) + 1, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([*a2[firsts].tolist(), None], pa.int64()), none, none, pa.array(np.append(mass, 0.0)), pa.array([*[None] * len(firsts), split], pa.int64())], _NAMES)

    return run


_NAMES = ["word", "second", "total", "mass", "split"]


def _write_pairs(m: Model):
    """The shared pairs (word, second, total, mass of kept trigrams) of one split by hash."""

    def run(t: pa.Table) -> pa.Table:
        home = t.column("home")[0].as_py()
        a, b, n, mass = (t.column(c).to_numpy() for c in ("word", "second", "total", "mass"))
        key = pair_key(a, b)
        order = np.argsort(key)
        count = by_word(m, a[order], "words", "count", m.unknown)
        _write(f"{m.folder}/pairs-{home}", {"key": eliasfano.build(key[order]), "q2": quantise((n[order] - DISCOUNT) / count), "b3": quantise(1 - mass[order] / n[order])})
        return pa.table({"split": pa.array([home], pa.int64())})

    return run


def _write_after(m: Model):
    """The successors of shared pairs that one split has, with the pairs' totals over all splits."""

    def run(t: pa.Table) -> pa.Table:
        split = t.column("split")[0].as_py()
        key = pair_key(t.column("word").to_numpy(), t.column("second").to_numpy())
        order = np.argsort(key)
        key, total = key[order], t.column("total").to_numpy()[order]
        f = _load(f"{m.folder}/hot-{split}")
        of = np.searchsorted(key, pair_key(f["a"], f["b"]))
        kept = f["n"] >= m.least
        of, c, n = of[kept], f["c"][kept], f["n"][kept]
        _write(f"{m.folder}/after-{split}", {"key": eliasfano.build(key), "to3": eliasfano.build(np.searchsorted(of, np.arange(len(key) + 1))), "c": eliasfano.build(raised(of, c)), "q3": quantise((n - DISCOUNT) / total[of])})
        return pa.table({"split": pa.array([split], pa.int64())})

    return run


def _home(m: Model):
    @F.pandas_udf("bigint")
    def home(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(split_of(m, a.to_numpy(), b.to_numpy()))

    return home


def _write_backoff(m: Model):
    def run(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        word, mass = t.column("word").to_numpy() - m.bases[part], t.column("mass").to_numpy()
        count = _load(f"{m.folder}/words-{part}")["count"]
        taken = np.zeros(len(count))
        taken[word] = mass
        _write(f"{m.folder}/backoff-{part}", {"b2": quantise(1 - taken / count)})
        return pa.table({"part": pa.array([part], pa.int32())})

    return run


def fit(documents: DataFrame, least: int = MIN_COUNT) -> tuple[Model, float]:
    """(the model, the unknown word's back-off weight); its files lie in the shared folder."""
    spark = documents.sparkSession
    common.small_batches(spark)
    folder = common.local_path(common.shared_path(spark, "trie"))
    os.makedirs(folder, exist_ok=True)
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    words = docs.mapInArrow(_word_counts, "word bigint, count bigint").groupBy("word").agg(F.sum("count").alias("count"))
    words = common.written(words, "words")
    tokens, known, size = words.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("count") >= least, F.col("count"))), F.lit(0)), F.count(F.when(F.col("count") >= least, 1))).first()
    bits = max(0, int(np.ceil(np.log2(max(1, size / FILE_WORDS)))))
    part = F.shiftright("word", 63 - bits).cast("int") if bits else F.lit(0)
    done = dict(tuple(r) for r in words.where(F.col("count") >= least).withColumn("part", part).groupBy("part").applyInArrow(_write_words(folder, max(1, tokens)), "part int, words bigint").collect())
    bases = np.concatenate([[0], np.cumsum([done.get(p, 0) for p in range(1 << bits)])]).astype(np.int64)
    m = Model(folder, tokens, tokens - known, bases, max(1, -(-tokens // SPLIT_TOKENS)), least, np.zeros(0, dtype=np.int64), {})
    hot = np.sort(np.array([r[0] for r in words.where(F.col("count") > SPLIT_TOKENS).select("word").collect()], dtype=np.int64)).astype(np.uint64)
    m = m._replace(hot=word_ids(m, hot) if len(hot) else m.hot)  # at most one for SPLIT_TOKENS tokens
    if m.unknown > SPLIT_TOKENS:
        m = m._replace(hot=np.append(m.hot, bases[-1]))
    shipped = docs.mapInArrow(_trigrams(m), "split bigint, n bigint, blob binary").repartitionById(m.splits, F.col("split").cast("int"))
    found = common.written(shipped.mapInArrow(_write_split(m), _SPLIT), "mass")
    made = {"split": frozenset(r[0] for r in found.where("word is null").select("split").collect())}
    mass = found.where("word is not null and second is null").select("word", "mass")
    if len(m.hot):
        shared = found.where("second is not null")
        totals = common.written(shared.groupBy("word", "second").agg(F.sum("total").alias("total"), F.sum("mass").alias("mass")).where(F.col("total") >= least), "totals")
        made["pairs"] = frozenset(r[0] for r in totals.withColumn("home", _home(m)("word", "second")).groupBy("home").applyInArrow(_write_pairs(m), "split bigint").collect())
        parts = shared.select("split", "word", "second").join(totals.select("word", "second", "total"), ["word", "second"])
        made["after"] = frozenset(r[0] for r in parts.groupBy("split").applyInArrow(_write_after(m), "split bigint").collect())
        mass = mass.unionByName(totals.select("word", (F.col("total") - DISCOUNT).alias("mass")))
    mass = common.written(mass.groupBy("word").agg(F.sum("mass").alias("mass")), "masses")
    unknown = mass.where(F.col("word") == int(bases[-1])).first()

    @F.pandas_udf("int")
    def part_of(word: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bases, word, side="right") - 1, dtype="int32")

    parts = mass.where(F.col("word") < int(bases[-1])).withColumn("part", part_of("word")).groupBy("part").applyInArrow(_write_backoff(m), "part int").collect()
    made["backoff"] = frozenset(r[0] for r in parts)
    m = m._replace(made=made)
    return m, 1 - (unknown["mass"] / m.unknown if unknown and m.unknown else 0.0)


def _backoff(m: Model, words: np.ndarray, unknown: float) -> np.ndarray:
    order = np.argsort(words, kind="stable")
    s = words[order]
    edge = np.searchsorted(s, m.bases)
    out = np.full(len(words), 0, dtype=np.int64)
    out[order[edge[-1] :]] = quantise(np.array([unknown]))[0]
    for p in range(len(m.bases) - 1):
        a, z = edge[p], edge[p + 1]
        if a < z and p in m.made["backoff"]:
            out[order[a:z]] = _load(f"{m.folder}/backoff-{p}")["b2"][s[a:z] - m.bases[p]]
    return _VALUE[out]


def _once(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each run of rows with like keys begins, how many rows it has): what is looked up of a run is looked up once."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = functools.reduce(np.logical_or, [k[1:] != k[:-1] for k in keys])
    first = eliasfano.where(new)
    size = np.empty_like(first)
    size[:-1] = first[1:] - first[:-1]
    size[-1:] = len(new) - first[-1:]
    return first, size


def _successors(level: eliasfano.Sequence, to: eliasfano.Sequence, node: np.ndarray, id_: np.ndarray) -> np.ndarray:
    """Position in ``level`` of each id among the successors of its node; -1 where it is none."""
    first, size = _once(node)
    lo, hi = eliasfano.get_two(to, node[first])
    base = np.zeros(len(lo), dtype=np.int64)
    some = np.flatnonzero(lo > 0)
    base[some] = eliasfano.get(level, lo[some] - 1)
    return eliasfano.find(level, np.repeat(base, size) + id_, np.repeat(lo, size), np.repeat(hi, size))


def _pairs(f: dict, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Position of each pair in the second level of a split; -1 where it is none."""
    first, size = _once(a)
    node = np.repeat(eliasfano.find(f["a"], a[first]), size)
    out = np.full(len(a), -1, dtype=np.int64)
    some = np.flatnonzero(node >= 0)
    out[some] = _successors(f["b"], f["to2"], node[some], b[some])
    return out


def _by_split(m: Model, kind: str, split: np.ndarray):
    """(rows, file) of each split that has a file, the rows of each in order."""
    order = _by_number(split, m.splits)
    edge = np.append(textnum.runs(split[order]), len(split))
    for i, j in zip(edge[:-1], edge[1:]):
        k = int(split[order[i]])
        if k in m.made.get(kind, ()):
            yield order[i:j], _load(f"{m.folder}/{kind}-{k}")


def pair_values(m: Model, a: np.ndarray, b: np.ndarray, c: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each (a, b), ``hot`` if both are, and the c after it (-1: none), the codes of q2(a b), b3(a b) or 1, q3(a b c). Like
    pairs should be neighbours."""
    n = len(a)
    q2, b3, q3 = np.full(n, _NONE, dtype=np.uint16), np.zeros(n, dtype=np.uint16), np.full(n, _NONE, dtype=np.uint16)
    cold = np.flatnonzero(~hot).astype(np.int32)
    for at, f in _by_split(m, "split", split_of(m, a[cold], b[cold])):
        rows = cold[at]
        first, size = _once(a[rows], b[rows])
        pos = np.repeat(_pairs(f, a[rows[first]], b[rows[first]]), size)
        rows, pos = rows[pos >= 0], pos[pos >= 0]
        q2[rows], b3[rows] = f["q2"][pos], f["b3"][pos]
        some = np.flatnonzero(c[rows] >= 0)
        at = _successors(f["c"], f["to3"], pos[some], c[rows[some]])
        q3[rows[some[at >= 0]]] = f["q3"][at[at >= 0]]
    hot = np.flatnonzero(hot)
    for at, f in _by_split(m, "pairs", split_of(m, a[hot], b[hot])):
        rows = hot[at]
        pos = eliasfano.find(f["key"], pair_key(a[rows], b[rows]))
        rows, pos = rows[pos >= 0], pos[pos >= 0]
        q2[rows], b3[rows] = f["q2"][pos], f["b3"][pos]
    hot = hot[c[hot] >= 0]
    for at, f in _by_split(m, "after", split_of_three(m, a[hot], b[hot], c[hot])):
        rows = hot[at]
        node = eliasfano.find(f["key"], pair_key(a[rows], b[rows]))
        rows, node = rows[node >= 0], node[node >= 0]
        at = _successors(f["c"], f["to3"], node, c[rows])
        q3[rows[at >= 0]] = f["q3"][at[at >= 0]]
    return q2, b3, q3


def log_probabilities(m: Model, unknown: float, h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """log2 of each token's probability."""
    ids, w = _ids(m, h)
    w = w.astype(np.int32)  # a block is large, so little is kept of each token
    p1_unknown = max(m.unknown, 1) / max(1, m.tokens)
    p1 = by_word(m, ids, "words", "p1", 0)
    p1 = np.where(ids < m.bases[-1], _VALUE[p1.astype(np.int64)], _VALUE[quantise(np.array([p1_unknown]))[0]])
    p = p1[w]
    two = np.flatnonzero(doc[1:] == doc[:-1]).astype(np.int32)  # token t and t+1
    if not len(two):
        return np.log2(p)
    b2 = _backoff(m, ids, unknown)
    two = two[np.argsort(w[two] * np.int64(len(ids)) + w[two + 1])]  # like pairs and their neighbours lie close in the levels
    third = np.minimum(two + 2, len(w) - 1)
    has = (two + 2 < len(w)) & (doc[third] == doc[two])
    word, hot = ids.astype(np.int32), np.isin(ids, m.hot)
    q2, b3, q3 = pair_values(m, word[w[two]], word[w[two + 1]], np.where(has, word[w[third]], np.int32(-1)), hot[w[two]] & hot[w[two + 1]])
    del third
    p[two + 1] = _VALUE[q2] + b2[w[two]] * p1[w[two + 1]]
    t = two[has] + 2
    p[t] = _VALUE[q3[has]] + _VALUE[b3[has]] * p[t]
    return np.log2(np.maximum(p, 1e-12))


def scored(docs: DataFrame, documents: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """A row per document: doc_id, n_tokens and bits_per_token under the model of ``documents``."""
    m, unknown = fit(documents, least)
    common.small_batches(docs.sparkSession)

    def run(batches):
        for ids, h, doc in _flushes(batches, BLOCK):
            n = np.bincount(doc, minlength=len(ids))
            bits = -np.bincount(doc, weights=log_probabilities(m, unknown, h, doc), minlength=len(ids)) if len(h) else np.zeros(len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(np.round(bits / np.maximum(n, 1), 6), mask=n == 0)], ["doc_id", "n_tokens", "bits_per_token"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, bits_per_token double")
